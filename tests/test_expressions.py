import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tests.evaluator import Trimmed, evaluate
from tidemark.errors import ExpressionError
from tidemark.operators.table import Table
from tidemark.plans.explain import pushed_filters
from tidemark.plans.syntax import Binary, Literal, Name, Not, parse

WIDTHS = {"C1": 6, "C2": 4}
ROWS = [
    {"ID": 1, "C1": "AAA", "C2": "AA", "N1": 5, "N2": 2.5, "D1": dt.date(2020, 2, 28), "L1": True},
    {"ID": 2, "C1": "AAAA", "C2": "AAAA", "N1": 0, "N2": -1.5, "D1": dt.date(1999, 12, 31), "L1": False},
    {"ID": 3, "C1": "", "C2": "", "N1": -7, "N2": 0.0, "D1": None, "L1": False},
    {"ID": 4, "C1": None, "C2": "zz", "N1": None, "N2": None, "D1": None, "L1": None},
    {"ID": 5, "C1": "abcdef", "C2": "cd", "N1": 100, "N2": 100.0, "D1": dt.date(2024, 2, 29), "L1": True},
]
SCHEMA = "ID int, C1 string, C2 string, N1 int, N2 double, D1 date, L1 boolean"


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA)
    return Table.of(df, "T", recno=["ID"], widths={k: (v, 0) for k, v in WIDTHS.items()})


def check(table, texts):
    columns = [table.expr(t).alias(f"x{i}") for i, t in enumerate(texts)]
    got = {r["ID"]: r for r in table.df.select("ID", *columns).collect()}
    for record in ROWS:
        for i, text in enumerate(texts):
            want, have = evaluate(text, record, WIDTHS), got[record["ID"]][f"x{i}"]
            if isinstance(want, Trimmed):
                want = str(want)
            elif isinstance(want, str) and isinstance(have, str):
                want, have = want.rstrip(), have.rstrip()
            assert have == pytest.approx(want) if isinstance(want, float) else have == want, (text, record, want, have)
    # A filter keeps exactly the rows for which the value is true.
    logical = [t for t in texts if isinstance(evaluate(t, ROWS[0], WIDTHS), bool)]
    for text in logical:
        kept = {r["ID"] for r in table.filter(text).df.select("ID").collect()}
        assert kept == {r["ID"] for r in ROWS if evaluate(text, r, WIDTHS) is True}, text


def test_comparisons_of_texts(table):
    check(table, [f"{a} {op} {b}" for op in ("=", "<>", "<", ">", "<=", ">=") for a, b in (("C1", "'AAA'"), ("C1", "C2"), ("C2", "C1"), ("'AAAA'", "C1"), ("C1", "'AAA   '"), ("C1", "'abcdefgh'"), ("C2", "''"))])


def test_comparisons_of_numbers_and_dates(table):
    check(table, [f"{a} {op} {b}" for op in ("=", "<>", "<", ">", "<=", ">=") for a, b in (("N1", "N2"), ("N1", "5"), ("2.5", "N2"), ("D1", "D1"), ("D1", "D1 + 1"))])


def test_arithmetic(table):
    check(table, ["N1 + N2", "N1 - N2", "N1 * 2 + 1", "N1 / N2", "N1 / 0", "2 ^ 3 ^ 2", "-N1", "D1 + 30", "D1 - 1", "D1 - D1", "1 + D1"])


def test_texts(table):
    check(table, ["C1 + C2", "C1 - C2", "UPPER(C1)", "LEFT(C1, 2)", "RIGHT(C1, 2)", "SUBSTR(C1, 2, 3)", "PADL(C1, 8)", "PADR(C2, 2)", "C2 $ C1", "STR(N1)", "STR(N1, 2)", "DTOS(D1)"])


def test_conditions(table):
    check(table, ["EMPTY(C1)", "EMPTY(N1)", "EMPTY(D1)", "EMPTY(L1)", "IIF(N1 > 0, C1, C2)", "IIF(L1, 1, 0)", ".NOT. N1 > 0", "N1 > 0 .AND. C1 = 'AAA' .OR. L1", "DAY(D1)", "YEAR(D1)"])


leaf = st.sampled_from(["C1 = 'AAA'", "C1 > C2", "N1 > N2", "N1 = 0", "N2 <> 2.5", "L1", "D1 > STOD('20000101')", "EMPTY(C1)", "C2 $ C1", "5 > N1", "'B' <= C1", ".T."])
trees = st.recursive(leaf, lambda x: st.one_of(x.map(lambda a: f".NOT. ({a})"), st.tuples(x, st.sampled_from([".AND.", ".OR."]), x).map(lambda t: f"({t[0]}) {t[1]} ({t[2]})")), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(trees)
def test_random_filters_equal_a_scan(table, text):
    import tests.evaluator as e

    real = e._call
    e._call = lambda name, args: dt.date(int(args[0][:4]), int(args[0][4:6]), int(args[0][6:8])) if name == "STOD" else real(name, args)
    try:
        check(table, [text])
    finally:
        e._call = real


def test_syntax():
    assert parse("2 + 3 * 4") == Binary("+", Literal(2.0), Binary("*", Literal(3.0), Literal(4.0)))
    assert parse("a->b") == Name("b", "a") == parse("a.b")
    assert parse(".not. x .and. y") == Binary(".AND.", Not(Name("x")), Name("y"))
    assert parse("5 => a") == Binary(">=", Literal(5.0), Name("a"))
    for bad in ("", "1 +", "(1", "a b", "1 ? 2", "x->", "f(1,)"):
        with pytest.raises(ExpressionError):
            parse(bad)


@pytest.mark.parametrize("text", ["NOPE", "LOWER(C1)", "C1 + N1", "C1 > 5", "SUBSTR(C1, N1)", "IIF(N1, 1, 2)", "DAY(C1)", "X->C1"])
def test_refusals(table, text):
    with pytest.raises(Exception, match=r"."):
        table.compiler().compile(text)


def test_unknown_width_counts_as_wider(spark):
    t = Table.of(spark.createDataFrame([(1, "S"), (2, "SA"), (3, "R")], "id int, s string"), "t", recno=["id"])
    assert [r["id"] for r in t.filter("s > 'S'").df.orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in t.filter("s = 'S'").df.orderBy("id").collect()] == [1, 2]


def test_filters_reach_the_scan(spark):
    t = Table.open(spark, "/root/testdata/sf0.001/orders.parquet", "orders", widths={"o_orderstatus": (1, 0)})
    found = pushed_filters(t.filter("o_totalprice > 1000 .AND. o_orderstatus = 'F' .AND. o_custkey = 7").df)
    assert {"GreaterThan(o_totalprice,1000.0)", "StringStartsWith(o_orderstatus,F)", "EqualTo(o_custkey,7)"} <= set(found)


def test_calculations(spark, table):
    t = table.with_calc("TWICE", "N1 * 2")
    assert [r[0] for r in t.df.orderBy("ID").select(t.expr("TWICE() + 1")).collect()] == [11.0, 1.0, -13.0, None, 201.0]
    with pytest.raises(ExpressionError):
        table.with_calc("LOOP", "LOOP() + 1")
