"""Every stage against a plain version on its own input."""

import pytest

import corpus_pipeline as C
from tests.llm import brute
from tidemark.llm import mixing, quality, secrets
from tidemark.llm.common import trainable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for i, (_, f) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(i))
        f(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(stages[0], labels, trainable())
    want = [r for r in stages[0].collect() if quality.score_texts([r["text"]], model)[0] >= 0.7]
    assert rows(stages[1]) == sorted(map(tuple, want), key=repr) and 0 < len(want) < stages[0].count()


def test_dedup_stage(stages):
    before = stages[1].collect()
    found = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before])
    want = [tuple(r) for r in before if found[r["doc_id"]][1] == r["doc_id"]]
    assert rows(stages[2]) == sorted(want, key=repr) and len(want) < len(before)


def test_secrets_stage(stages):
    model = secrets.train(stages[2])
    for old, new in zip(sorted(stages[2].collect()), sorted(stages[3].collect()), strict=True):
        base, added = secrets.scan(old["text"], model)
        assert new["text"] == secrets.redact(old["text"], base + added) and new["n_chars"] == len(new["text"])
        assert (new["doc_id"], new["source"]) == (old["doc_id"], old["source"])
        assert not [s for s in brute.secret_spans(new["text"]) if "[SECRET]" not in new["text"][s[1] : s[2]]]


def test_mix_stage(stages):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect() if r["taken"]}
    words: dict = {}
    for r in stages[4].collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
    assert words == taken


def test_tokens_stage(stages):
    out = stages[5].collect()
    assert len(out) == stages[4].count() and all(r["exact"] for r in out)


def test_run_and_empty(spark, empty, tmp_path):
    got = C.run(spark, SF)
    assert got.count() > 0 and "n_tokens" in got.columns
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
