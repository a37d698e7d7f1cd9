import numpy as np

from tests.llm import brute
from tidemark.llm import language_id as L
from tidemark.llm.common import trainable


def test_codewords():
    for n in (2, 3, 4, 7, 12, 40):
        code = L.code_matrix(n)
        assert len({tuple(r) for r in code}) == n
        columns = {tuple(c * c[0]) for c in code.T}
        assert len(columns) == code.shape[1] and all(abs(sum(c)) < n for c in columns)
    apart = [(a != b).sum() for i, a in enumerate(L.code_matrix(12)) for b in L.code_matrix(12)[:i]]
    assert min(apart) >= 5


def test_held_out_accuracy(spark, documents):
    got = {r["doc_id"]: r for r in L.query(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d["doc_id"]]["held_out"] == brute.held_out(d["doc_id"]) for d in docs)
    tested = [d for d in docs if brute.held_out(d["doc_id"])]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in tested]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_decoding_survives_a_wrong_bit():
    drawn = np.random.default_rng(1)
    words = {s: ["".join(drawn.choice(list(a), 5)) for _ in range(40)] for s, a in (("aa", "abcde"), ("bb", "fghij"), ("cc", "klmno"), ("dd", "pqrst"), ("ee", "uvwxy"))}
    texts = [(s, " ".join(drawn.choice(words[s], 30))) for s in words for _ in range(30)]
    model = L.Model.fit(np.array([L.counts(t) for _, t in texts]), [s for s, _ in texts])
    margins = model.code.astype(float)
    assert [model.languages[i] for i in model._losses(margins).argmin(axis=1)] == model.languages
    flipped = margins.copy()
    flipped[:, 0] *= -1
    assert [model.languages[i] for i in model._losses(flipped).argmin(axis=1)] == model.languages
    half = " ".join(words["aa"][:20] + words["bb"][:20])
    assert model.predict(np.array([L.counts(half)]))[2][0]
    assert model.predict(np.array([L.counts(" ".join(words["cc"]))]))[0] == ["cc"]


def test_learns_from_allowed_rows_alone(spark, documents):
    """Held-out labels don't matter."""
    from pyspark.sql import functions as F

    changed = documents.withColumn("lang", F.when(trainable(), F.col("lang")).otherwise("xx"))
    a, b = (L.train(d, trainable()) for d in (documents, changed))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_edges(spark, odd, empty):
    model = L.train(odd, per_language=5)
    rows = L.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {"und"}
    assert all(r["lang_pred"] in ("en", "de", "fr") for r in rows if r["doc_id"] in (5, 8, 9))
    assert L.train(empty) is None
    assert {r["lang_pred"] for r in L.identify(odd, None).collect()} == {"und"}
    one = odd.filter("lang = 'en'")
    assert {(r["lang_pred"], r["score"]) for r in L.identify(one.filter("doc_id = 5"), L.train(one)).collect()} == {("en", 1.0)}
    assert L.identify(empty, model).count() == 0


def test_whole_table_equals_plain_decoding(spark):
    """Every prediction by its definition: trigrams counted one by one, each bit's margin, each codeword's weighted loss."""
    import math
    from collections import Counter

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = L.train(docs, trainable())
    got = {r["doc_id"]: r for r in L.query(spark, path).collect()}
    for r in docs.collect():
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (r["text"] or "").lower().encode())
        raw = b" " + b" ".join(raw.split()) + b" "
        have = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (have["lang_pred"], have["score"]) == ("und", 0.0)
            continue
        grams = Counter(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 20 for i in range(len(raw) - 2))
        n = sum(grams.values())
        margins = [sum(math.sqrt(k / n) * model.weights[g, bit] for g, k in grams.items()) for bit in range(model.code.shape[1])]
        losses = [sum(t * math.log1p(math.exp(-4 * m * c)) for m, c, t in zip(margins, word, trust, strict=True)) for word, trust in zip(model.code.tolist(), model.trust, strict=True)]
        soft = [math.exp(-model.scale * (x - min(losses))) for x in losses]
        order = sorted(losses)
        if order[1] - order[0] > 1e-4:
            assert have["lang_pred"] == model.languages[losses.index(order[0])]
        assert abs(have["score"] - max(soft) / sum(soft)) < 1e-2
        if abs(order[1] - order[0] - L.MARGIN * model.gap) > 1e-4:
            assert have["ambiguous"] == (order[1] - order[0] < L.MARGIN * model.gap)


def test_fit_equals_refitting_without_each_text():
    """Weights by the normal equations; a language's trust by really leaving each of its texts out."""
    drawn = np.random.default_rng(4)
    texts = [(s, " ".join("".join(drawn.choice(list(a), 4)) for _ in range(12))) for s, a in (("aa", "abcdef"), ("bb", "defghi"), ("cc", "ghiabc")) for _ in range(8)]
    x, names = np.array([L.counts(t) for _, t in texts]), [s for s, _ in texts]
    model = L.Model.fit(x, names)
    rows = np.sqrt(x / x.sum(axis=1, keepdims=True)).astype(np.float32).astype(float)
    rows = rows[:, x.any(axis=0)]  # the other weights are zero
    y = np.array([model.code[model.languages.index(s)] for s in names], float)

    def solved(some):
        return np.linalg.solve(rows[some].T @ rows[some] + L.RIDGE * np.eye(rows.shape[1]), rows[some].T @ y[some])

    every = np.arange(len(rows))
    assert np.allclose(model.weights[x.any(axis=0)], solved(every), atol=1e-8) and not model.weights[~x.any(axis=0)].any()
    right = np.array([np.sign(rows[i] @ solved(every != i)) == y[i] for i in every])
    trust = np.array([right[[s == k for s in names]].mean(axis=0) for k in model.languages])
    assert np.allclose(model.trust, trust / trust.sum(axis=1, keepdims=True))


def test_the_sample_is_bounded_in_all(spark, monkeypatch):
    monkeypatch.setattr(L, "IN_ALL", 60)
    rows = [(i, f"words of language number {i % 50} and {i}", f"l{i % 50:02}") for i in range(2000)]
    seen = []
    fit = L.Model.fit.__func__
    monkeypatch.setattr(L.Model, "fit", classmethod(lambda cls, x, names: seen.append(len(names)) or fit(cls, x, names)))
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 50 and seen == [50]
