"""Every type of lookup with every action, against a nested loop written apart."""

import itertools

import pytest

from tidemark.errors import EngineError, RelationTerminated
from tidemark.operators.relation import Relation
from tidemark.operators.table import RECNO, Table, Tag

MASTERS = [(1, 10), (2, 20), (3, 25), (4, 99), (5, 10)]
FIRST = [(1, 10, 7), (2, 10, 8), (3, 20, 7), (4, 30, 9)]
SECOND = [(1, 7, 10), (2, 8, 25), (3, 7, 20), (4, 7, 10)]


@pytest.fixture(scope="module")
def tables(spark):
    def make(rows, name, columns, *tags):
        t = Table.of(spark.createDataFrame(rows, f"_recno long, {columns}"), name)
        for tag in tags:
            t = t.with_tag(tag)
        return t

    return make(MASTERS, "m", "k long"), make(FIRST, "a", "ak long, al long", Tag("k", "ak"), Tag("d", "ak", descending=True)), make(SECOND, "b", "bl long, bk long", Tag("l", "bl"), Tag("k", "bk"))


def naive(rows, slaves, key, slave_key, type_, action):
    """Rows are dicts of alias to record; a blank record is None."""
    out = []
    for r in rows:
        k = key(r)
        ordered = sorted(slaves, key=lambda s: (slave_key(s), s[0]))
        if type_ == "approx":
            match = [s for s in ordered if slave_key(s) >= k][:1] or [None]
        else:
            match = [s for s in ordered if slave_key(s) == k]
            match = match[:1] if type_ == "exact" else match
            if not match:
                if action == "skip":
                    continue
                if action == "terminate":
                    break
                match = [None]
        out += [(r, s) for s in match]
    return out


def numbers(df, *aliases):
    return sorted(tuple(r[f"{a}__{RECNO}"] or 0 for a in aliases) for r in df.collect())


@pytest.mark.parametrize(("type_", "action"), [(t, a) for t in ("exact", "scan", "approx") for a in ("blank", "skip", "terminate")])
def test_one_slave(tables, type_, action):
    m, a, _ = tables
    r = Relation(m)
    r.slave(a, "k", "k", type=type_, action=action)
    want = naive([{"m": x} for x in MASTERS], FIRST, lambda x: x["m"][1], lambda s: s[1], type_, action)
    assert numbers(r.composites(), "m", "a") == sorted((x["m"][0], s[0] if s else 0) for x, s in want)


@pytest.mark.parametrize(("t1", "a1", "t2", "a2"), list(itertools.product(("exact", "scan"), ("blank", "skip"), ("exact", "scan", "approx"), ("blank", "skip"))))
def test_chain(tables, t1, a1, t2, a2):
    m, a, b = tables
    r = Relation(m)
    r.slave(a, "k", "k", type=t1, action=a1).slave(b, "a->al", "l", type=t2, action=a2)
    first = [{"m": x["m"], "a": s} for x, s in naive([{"m": x} for x in MASTERS], FIRST, lambda x: x["m"][1], lambda s: s[1], t1, a1)]
    want = naive(first, SECOND, lambda x: x["a"][2] if x["a"] else 0, lambda s: s[1], t2, a2)
    assert numbers(r.composites(), "m", "a", "b") == sorted((x["m"][0], x["a"][0] if x["a"] else 0, s[0] if s else 0) for x, s in want)


@pytest.mark.parametrize("action", ["blank", "skip"])
def test_two_scans_take_turns(tables, action):
    m, a, b = tables
    r = Relation(m)
    r.slave(a, "k", "k", type="scan", action=action)
    r.slave(b, "k", "k", type="scan", action=action)
    want = []
    for n, k in MASTERS:
        hits = [(n, s[0], 0) for s in FIRST if s[1] == k] + [(n, 0, s[0]) for s in SECOND if s[2] == k]
        want += hits or ([(n, 0, 0)] if action == "blank" else [])
    assert numbers(r.composites(), "m", "a", "b") == sorted(want)
    ordered = [tuple(x[f"{c}__{RECNO}"] or 0 for c in "mab") for x in r.ordered().collect()]
    assert ordered[:3] == [(1, 1, 0), (1, 2, 0), (1, 0, 1)]
    assert [x["_seq"] for x in r.sequenced().orderBy("_seq").collect()] == list(range(1, len(want) + 1))


def test_descending_tag_takes_its_first(tables):
    m, a, _ = tables
    r = Relation(m)
    r.slave(a, "k", "d")
    assert (1, 2) in numbers(r.composites(), "m", "a")


def test_approx_with_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    m = Table.of(spark.range(500).selectExpr("id + 1 AS _recno", "id * 7 % 3001 AS k"), "m")
    s = Table.of(spark.range(800).selectExpr("id + 1 AS _recno", "id * 13 % 2503 AS k"), "s").with_tag(Tag("k", "k"))
    r = Relation(m)
    r.slave(s, "k", "k", type="approx")
    keys = sorted((i * 13 % 2503, i + 1) for i in range(800))
    want = sorted((i + 1, next((n for k, n in keys if k >= i * 7 % 3001), 0)) for i in range(500))
    assert numbers(r.composites(), "m", "s") == want


def test_approx_with_a_hot_key(spark):
    """Most masters have one key, some none, some are beyond the last; only distinct keys go through the window."""
    keys = [5] * 3000 + [None] * 10 + [99] * 5 + list(range(40))
    m = Table.of(spark.createDataFrame([(i + 1, k) for i, k in enumerate(keys)], "_recno long, k int"), "m")
    s = Table.of(spark.range(20).selectExpr("id + 1 AS _recno", "id * 3 AS k"), "s").with_tag(Tag("k", "k"))
    r = Relation(m)
    r.slave(s, "k", "k", type="approx")
    want = sorted((i + 1, next((n + 1 for n in range(20) if k is not None and n * 3 >= k), 0)) for i, k in enumerate(keys))
    assert numbers(r.composites(), "m", "s") == want


def test_filters_see_blanks(tables):
    m, a, _ = tables
    r = Relation(m)
    r.slave(a, "k", "k")
    assert numbers(r.query("a->al = 0").composites(), "m") == [(3,), (4,)]
    assert numbers(r.query("EMPTY(a->al)").composites(), "m") == [(3,), (4,)]
    assert numbers(r.query("a->al < 8 .AND. m->k > 5").composites(), "m") == [(1,), (2,), (3,), (4,), (5,)]
    assert r.query(None).count() == 5


def test_terminate_and_strict(tables):
    m, a, _ = tables
    r = Relation(m)
    r.slave(a, "k", "k", action="terminate")
    assert numbers(r.composites(), "m") == [(1,), (2,)]
    with pytest.raises(RelationTerminated):
        r.strict()


def test_definitions_and_navigation(tables):
    m, a, b = tables
    r = Relation(m)
    r.slave(a, "k", "k", type="scan", action="skip").slave(b, "a->al", "l")
    r.query("m->k < 50").sort("DESCEND(m->k)")
    again = Relation.load(r.save(), {"m": m, "a": a, "b": b})
    assert again.save() == r.save()
    assert [tuple(x[f"{c}__{RECNO}"] for c in "ma") for x in r.ordered().collect()] == [(2, 3), (1, 1), (1, 2), (5, 1), (5, 2)]
    assert r.top().first()[f"m__{RECNO}"] == 2 and r.bottom().first()[f"a__{RECNO}"] == 2 and r.skip(1).first()[f"a__{RECNO}"] == 1
    assert numbers(r.distinct_masters(), "m", "a") == [(1, 1), (2, 3), (5, 1)]
    assert numbers(r.do_all(4), "m") == [] and numbers(r.do_one(1, "a"), "a") == [(1,), (2,)]
    assert numbers(r.semi("a"), "m") == [(1,), (2,), (5,)] and numbers(r.anti("a"), "m") == [(3,), (4,)]
    with pytest.raises(EngineError):
        r.slave(a, "k", "k")


def test_a_relation_can_be_cancelled(tables):
    m, a, _ = tables
    r = Relation(m)
    r.slave(a, "k", "k", type="scan", action="blank")
    every, asked = [x[f"m__{RECNO}"] for x in r.rows()], []
    assert [x[f"m__{RECNO}"] for x in r.rows(cancel=lambda n: asked.append(n) or n >= 4, every=2)] == every[:4]
    assert asked == [0, 2, 4] and list(r.rows(cancel=lambda n: True)) == []
    assert [x[f"m__{RECNO}"] for x in r.rows(cancel=lambda n: False)] == every


def test_count_without_lookups(tables):
    m, a, _ = tables
    r = Relation(m)
    r.slave(a, "k", "k")
    assert r.count() == 5
    assert not r.is_empty()
    assert len(list(r.rows())) == 5
