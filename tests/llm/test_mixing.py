import math
import random

import duckdb
import pytest

from tests.llm import brute
from tidemark.llm import mixing as X


def test_targets():
    for seed in range(200):
        drawn = random.Random(seed)
        sizes = {i: drawn.choice([0, 1, 10, 1000, drawn.randrange(10**6)]) for i in range(drawn.randint(1, 12))}
        weights = {i: (5, 2, 1)[i % 3] for i in sizes}
        total = sum(sizes.values())
        got = X.water_fill(sizes, weights, total, 3)
        assert math.isclose(sum(got.values()), total, rel_tol=1e-9, abs_tol=1e-6)
        assert all(got[i] <= 3 * sizes[i] * (1 + 1e-12) for i in sizes)
        free = [got[i] / weights[i] for i in sizes if got[i] < 3 * sizes[i] * (1 - 1e-9)]
        assert not free or max(free) - min(free) <= 1e-6 * max(free)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_its_contract(spark, table):
    path = f"/root/testdata/{table}"
    rows = X.query(spark, path).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = {r[0]: r for r in c.execute(X.SQL).fetchall()}
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"], r["position"]) == (w[1], w[2], w[4], w[6])
        assert r["target"] == pytest.approx(w[3]) and r["v_finish"] == (None if w[5] is None else pytest.approx(w[5]))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    taken: dict = {}
    for r in rows:
        assert r["size"] == len(brute.WORD.findall(docs[r["doc_id"]]["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        taken.setdefault((docs[r["doc_id"]]["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 1 for (_, target), t in taken.items())


def test_queues_interleave(spark):
    """At any point of the mix each source has been served about its share."""
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["position"], r["source"]) for r in X.mix(df, {"a": 3, "b": 1}).filter("taken > 0").collect())
    first = [s for p, s in got if p < 400]
    assert first.count("a") > 1.6 * first.count("b")


def test_mix_itself(spark, documents):
    mixed = X.mix(documents)
    words: dict = {}
    out = X.mixed_rows(documents, mixed)
    assert out.columns == documents.columns and out.schema == documents.schema
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}


def test_reruns_agree_on_any_partitions(spark, documents):
    a = sorted(map(tuple, X.mix(documents).collect()))
    assert a == sorted(map(tuple, X.mix(documents.repartition(13)).collect()))


def test_edges(spark, odd, empty):
    rows = X.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    assert {r["source"] for r in rows} == {"a", "b", "c", None}
    assert X.mix(empty).count() == 0 and X.mixed_rows(empty, X.mix(empty)).count() == 0
    out = X.mixed_rows(odd, X.mix(odd))
    assert out.columns == odd.columns and out.count() > 0
    assert X.cyclic_weights([None, "é", "b"]) == {"b": 5, "é": 2, None: 1}
