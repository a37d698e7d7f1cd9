import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.operators import report as R


@pytest.fixture(scope="module")
def rows():
    drawn = random.Random(4)
    return [(i, drawn.choice("ab"), drawn.choice([None, 1, 2]), float(drawn.randint(-5, 20))) for i in range(1, 301)]


def expected(rows):
    """Row by row: first change, and running totals by the outer group, the inner group and none."""
    out, before, sums = [], None, {}
    for seq, g, h, v in rows:
        level = 1 if before is None or before[0] != g else 2 if before[1] != h else 0
        if level == 1:
            sums["outer"] = []
        if level:
            sums["inner"] = []
        for k in ("outer", "inner", "all"):
            sums.setdefault(k, []).append(v)
        out.append((seq, level, sum(sums["outer"]), len(sums["inner"]), max(sums["inner"]), sum(sums["all"]) / len(sums["all"])))
        before = g, h
    return out


def test_running_totals_and_breaks(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "_seq long, g string, h int, v double")
    # blocks of a few rows, so that runs cross many of them
    monkeypatch.setattr(R.with_previous, "__defaults__", ("_seq", 16))
    monkeypatch.setattr(R.running, "__defaults__", (None, "_seq", 16))
    groups = [R.Group("outer", F.col("g")), R.Group("inner", F.col("h"))]
    totals = [R.Total("a", "sum", F.col("v"), "outer"), R.Total("b", "count", None, "inner"), R.Total("c", "max", F.col("v"), "inner"), R.Total("d", "average", F.col("v"))]
    got = R.Report(df, groups, totals).with_running().orderBy("_seq").collect()
    assert [(r["_seq"], r["first_change"], r["a"], r["b"], r["c"], pytest.approx(r["d"])) for r in got] == expected(rows)


def test_tables_of_runs_and_lookahead(spark, rows):
    df = spark.createDataFrame(rows, "_seq long, g string, h int, v double")
    groups = [R.Group("outer", F.col("g"))]
    totals = [R.Total("s", "sum", F.col("v"), "outer"), R.Total("n", "count", None, "outer"), R.Total("so_far", "sum", F.col("v"))]
    got = R.Report(df, groups, totals).table("outer", ["g"]).orderBy("_seq").collect()
    want, run = [], []
    for i, row in enumerate(rows):
        run.append(row)
        if i + 1 == len(rows) or rows[i + 1][1] != row[1]:
            want.append((row[0], row[1], sum(r[3] for r in run), len(run), sum(r[3] for r in rows[: i + 1])))
            run = []
    assert [tuple(r) for r in got] == want
    ahead = R.Report(df, groups, totals[:1]).with_lookahead().orderBy("_seq").collect()
    assert [r["s"] for r in ahead] == [next(w[2] for w in want if w[0] >= r["_seq"]) for r in ahead]


def test_conditions(spark):
    rows = [(1, "x", 1.0), (2, "x", 2.0), (3, "y", 4.0), (4, "x", 8.0), (5, "x", 16.0)]
    df = spark.createDataFrame(rows, "_seq long, g string, v double")
    totals = [R.Total("t", "sum", F.col("v"), None, F.col("v") > 2), R.Total("c", "sum", F.col("v"), None, F.col("g"), "change")]
    assert tuple(R.Report(df, [], totals).summary().first()) == (28.0, 13.0)
    assert [tuple(r) for r in R.Report(df, [], totals).with_running().orderBy("_seq").select("t", "c").collect()] == [(0.0, 1.0), (0.0, 1.0), (4.0, 5.0), (12.0, 13.0), (28.0, 13.0)]


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], "_seq long, v double")
    totals = [R.Total(k, k, F.col("v")) for k in R.KINDS]
    assert tuple(R.Report(df, [], totals).summary().first()) == (0.0, 0, 0.0, R.LEAST, R.MOST)
    with pytest.raises(EngineError):
        R.Report(df, [], [R.Total("x", "median", F.col("v"))])
    with pytest.raises(EngineError):
        R.Report(df, [R.Group("g", F.col("v"))], [R.Total("x", "sum", F.col("v"), "g")]).table(None, [])


def test_sorted_groups_need_no_window(spark, rows):
    df = spark.createDataFrame(rows, "_seq long, g string, h int, v double")
    table = R.Report(df, [R.Group("outer", F.col("g"))], [R.Total("s", "sum", F.col("v"), "outer")], sorted_by_groups=True).table("outer", ["g"])
    assert "Window" not in table._jdf.queryExecution().executedPlan().toString()
    assert {r["g"]: r["s"] for r in table.collect()} == {g: sum(r[3] for r in rows if r[1] == g) for g in "ab"}


def test_running_totals_of_keys(spark, monkeypatch):
    """Runs that are keys, a null and a long one among them, over blocks of a few rows."""
    monkeypatch.setattr(R.running_in_keys, "__defaults__", ("_seq", 16))
    keys = [None] * 5 + ["a"] * 100 + ["b"] * 3 + ["c"]
    rows = [(i, g, h, float(i % 7)) for i, (g, h) in enumerate(((g, j // 10) for g in [None, "a", "b", "c"] for j in range(keys.count(g))), 1)]
    df = spark.createDataFrame(rows, "_seq long, g string, h int, v double")
    groups = [R.Group("outer", F.col("g")), R.Group("inner", F.col("h"))]
    totals = [R.Total("a", "sum", F.col("v"), "outer"), R.Total("b", "count", None, "inner"), R.Total("c", "max", F.col("v"), "inner"), R.Total("d", "average", F.col("v"))]
    report = R.Report(df, groups, totals, sorted_by_groups=True)
    got = report.with_running().orderBy("_seq").collect()
    assert [(r["_seq"], r["a"], r["b"], r["c"], pytest.approx(r["d"])) for r in got] == [(s, a, b, c, d) for s, _, a, b, c, d in expected(rows)]
    assert [(r["run_outer"], r["run_inner"]) for r in got] == [(g, h) for _, g, h, _ in rows]


def test_totals_of_all_levels(spark, rows):
    df = spark.createDataFrame([(i, g, h, v) for i, (_, g, h, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0)), 1)], "_seq long, g string, h int, v double")
    groups = [R.Group("outer", F.col("g")), R.Group("inner", F.col("h"))]
    got = R.Report(df, groups, [R.Total("s", "sum", F.col("v")), R.Total("n", "count")], sorted_by_groups=True).levels().collect()
    want = [(0, None, None)] + [(1, g, None) for g in "ab"] + [(2, g, h) for g in "ab" for h in (None, 1, 2)]
    assert {(r["level"], r["outer"], r["inner"]): (r["s"], r["n"]) for r in got} == {
        (k, g, h): (sum(r[3] for r in rows if (k < 1 or r[1] == g) and (k < 2 or r[2] == h)), sum((k < 1 or r[1] == g) and (k < 2 or r[2] == h) for r in rows)) for k, g, h in want
    }
    with pytest.raises(EngineError):
        R.Report(df, groups, [R.Total("s", "sum", F.col("v"), "outer")], sorted_by_groups=True).levels()
