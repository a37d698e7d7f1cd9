import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import quality as Q


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in Q.query(spark, path).collect()}
    labels = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if brute.held_out(r["doc_id"])]
    assert len(got) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) >= 0.98
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())


def test_scores_are_those_of_the_densities():
    drawn = np.random.default_rng(3)
    x = np.vstack([drawn.normal(0, 1, (300, 4)), drawn.normal(1, 2, (200, 4))])
    y = np.repeat([0, 1], [300, 200])
    order = drawn.permutation(500)
    model = Q.Model.fit(x[order], y[order])
    z = (np.clip(x, model.low, model.high) - model.centre) / model.scale
    want = []
    for row in z:
        logs = []
        for k in (0, 1):
            cov = model.factors[k] @ model.factors[k].T
            d = row - model.means[k]
            logs.append(model.prior[k] - 0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * np.linalg.slogdet(cov)[1])
        want.append(1 / (1 + np.exp(-(logs[1] - logs[0]) / model.temperature)))
    assert model.score(x) == pytest.approx(np.array(want))
    assert np.mean((model.score(x) > 0.5) == y) > 0.75


def test_edges(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 1), (8, 1), (4, 0), (7, 0), (10, 0), (10, None), (None, 1), (99, 1), (5, 7)], "doc_id long, quality int")
    model = Q.train(odd, labels)
    assert isinstance(model, Q.Model)
    rows = {r["doc_id"]: r["score"] for r in Q.classify(odd, model).collect()}
    assert rows[1] == rows[2] == rows[3] and all(0 <= s <= 1 for s in rows.values())
    assert Q.keep(odd, model).columns == odd.columns
    assert Q.train(odd, labels.filter("quality = 1")) == 1.0 and Q.train(odd, labels.limit(0)) == 0.5
    assert Q.classify(empty, model).count() == 0 and Q.train(empty, labels) == 0.5
    assert {r["score"] for r in Q.classify(odd.filter("doc_id = 5"), 0.5).collect()} == {0.5}


def test_the_model_scores_empty_texts_too(spark):
    rows = [(i, "" if i % 2 else "some words of a plain text and more of them " * (1 + i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for good in (0, 1):
        model = Q.train(df, spark.createDataFrame([(i, good if i % 2 else 1 - good) for i in range(200)], "doc_id long, quality int"))
        scores = {r["doc_id"]: r["score"] for r in Q.classify(df, model).collect()}
        assert all((scores[i] > 0.9) == bool(good if i % 2 else 1 - good) for i in range(200))


def test_repeated_ids_are_bounded_and_equal_rows_count_once(spark):
    rows = [(i, f"{'ab'[i % 2] * (3 + i)} and more 12 words, {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, again = Q.train(df, labels), Q.train(df.unionAll(df).unionAll(df.filter("doc_id < 7")), labels)
    assert np.array_equal(once.means, again.means) and np.array_equal(once.factors, again.factors)
    hot = spark.range(5000).selectExpr("1L AS doc_id", "concat('text of the same id ', id) AS text").unionAll(df.filter("doc_id <> 1"))
    assert isinstance(Q.train(hot, labels, bound=200), (Q.Model, float))


def test_whole_table_equals_plain_densities(spark):
    """Every score by the covariances' inverses and determinants, one text at a time."""
    import math

    from tidemark.llm.common import trainable

    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels, trainable())
    parts = [(np.linalg.inv(f @ f.T), math.log(np.linalg.det(f @ f.T))) for f in model.factors]
    got = {r["doc_id"]: r for r in Q.query(spark, path).collect()}
    for r in docs.collect():
        z = (np.minimum(np.maximum(Q.statistics(r["text"]), model.low), model.high) - model.centre) / model.scale
        logs = [p - 0.5 * (z - m) @ inverse @ (z - m) - 0.5 * size for p, m, (inverse, size) in zip(model.prior, model.means, parts, strict=True)]
        odds = max(-30.0, min(30.0, (logs[1] - logs[0]) / model.temperature))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-5, abs=1e-9)
