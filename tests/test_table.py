import pytest

from tidemark.errors import EngineError, Status, UniqueError
from tidemark.operators import dml
from tidemark.operators.recordset import RecordSet
from tidemark.operators.table import DELETED, RECNO, Table, Tag

# A table's text keys by record number, in key order.
KEYS = {
    6: "", 18: "", 14: "AARDVARK", 8: "AB", 9: "ABC", 10: "ABCDEFGHIJKLMNOPQRST", 32: "CHARLIE", 1: "CUSTOMER", 2: "CUSTOMER-ALPHA", 13: "CUSTOMER-ALPHA", 3: "CUSTOMER-ALPHA-TWO",
    4: "CUSTOMER-BETA", 5: "CUSTOMER-BETAX", 31: "DELTA", 30: "ECHO", 29: "FOXTROT", 28: "GOLF", 27: "HOTEL", 26: "INDIA", 25: "JULIETT", 24: "KILO", 23: "LIMA", 16: "M", 11: "MIDDLE",
    12: "MIDDLE", 17: "MIDDLE-EARTH", 22: "NOVEMBER", 21: "OSCAR", 20: "PAPA", 19: "QUEBEC", 7: "ZEBRA", 15: "ZEBRA CROSSING",
}


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(sorted(KEYS.items()), "_recno long, K_C string")
    t = Table.of(df, "base", widths={"K_C": (20, 0)})
    for tag in (Tag("T", "K_C"), Tag("TD", "K_C", descending=True), Tag("TU", "K_C", unique="continue"), Tag("TF", "K_C", filter="K_C > 'M'")):
        t = t.with_tag(tag)
    return t.select_tag("T")


def recnos(df):
    return [r[RECNO] for r in df.collect()]


def test_walks(table):
    assert recnos(table.walk()) == list(KEYS)
    assert recnos(table.walk("TD")) == list(KEYS)[::-1]
    assert recnos(table.walk("TU")) == [k for k in KEYS if k not in (18, 13, 12)]
    assert table.tag_count("TU") == 29
    assert recnos(table.walk("TF"))[0] == 16
    assert recnos(table.top()) == [6] and recnos(table.bottom()) == [15] and recnos(table.top("TD")) == [15]


@pytest.mark.parametrize(
    ("value", "status", "recno"),
    [("GOLF", Status.FOUND, 28), ("GOLF      ", Status.FOUND, 28), ("GOLF               !", Status.AFTER, 27), ("\x00", Status.AFTER, 6), ("", Status.FOUND, 6), (" " * 20, Status.FOUND, 6), ("ZEBRA CROSSING      ", Status.FOUND, 15), ("ZZ", Status.EOF, None), ("CUSTOMER-A", Status.FOUND, 2)],
)
def test_seeks(table, value, status, recno):
    got, df = table.seek(value)
    assert got == status
    assert recnos(df) == [recno]


def test_other_seeks(table):
    assert recnos(table.seek_exact("CUSTOMER")) == [1]
    assert recnos(table.seek_exact("CUSTOME")) == []
    assert recnos(table.seek_at_or_after("CUSTOMERX")) == [31]
    assert recnos(table.seek_at_or_before("CUSTOMERX")) == [5]
    assert recnos(table.seek_at_or_after("H", "TD")) == [28]
    assert recnos(table.seek_next("MIDDLE", 11)) == [12] and recnos(table.seek_next("MIDDLE", 12)) == [] and recnos(table.seek_next("MIDDLE", 99)) == [11]
    assert recnos(table.seek_nth("CUSTOMER-ALPHA", -1)) == [13]
    assert recnos(table.seek_entry("", 18)) == [18]


def test_moves(table):
    status, df = table.skip(6, 3)
    assert status == Status.FOUND and recnos(df) == [8]
    assert recnos(table.skip(8, -2)[1]) == [18]
    assert table.skip(15, 1)[0] == Status.EOF and table.skip(6, -1)[0] == Status.BOF
    assert recnos(table.skip(15, 2, "TD")[1]) == [19]
    assert recnos(table.position_set(0.5)) == [list(KEYS)[15]]
    assert table.skip(99, 0)[0] == Status.NO_RECORD


def test_seek_many(spark, table):
    keys = spark.createDataFrame([("MIDDLE",), ("NONE",), ("ECHO",)], "k string")
    assert {r["k"]: r[RECNO] for r in table.seek_many(keys, "k").collect()} == {"MIDDLE": 11, "NONE": None, "ECHO": 30}


def test_unique(table):
    with pytest.raises(UniqueError):
        table.with_tag(Tag("X", "K_C", unique="error"))
    assert table.check() == {"T": True, "TD": True, "TU": True, "TF": True}
    with pytest.raises(EngineError):
        table.select_tag("NONE")


def test_changes(spark, table):
    gone = dml.delete(table, "K_C = 'MIDDLE'")
    assert gone.record_count() == 32 and gone.filter(".NOT. DELETED()").record_count() == 29
    packed = dml.pack(gone)
    assert packed.record_count() == 29 and sorted(recnos(packed.df)) == list(range(1, 30))
    assert [r["K_C"] for r in packed.df.orderBy(RECNO).collect()] == [KEYS[i] for i in range(1, 33) if i not in (11, 12, 17)]
    assert dml.rollback(gone).filter("DELETED()").record_count() == 0
    assert sorted(recnos(dml.zap(table, 1, 30).df)) == [1, 2]
    unique = dml.zap(table, 11, 18).with_tag(Tag("U", "K_C", unique="error"))
    with pytest.raises(UniqueError):
        dml.append(unique, spark.createDataFrame([("ECHO",)], "K_C string"))
    assert dml.append(unique, spark.createDataFrame([("NEW",)], "K_C string")).record_count() == 25
    assert dml.append_blank(table).go(33).first()["K_C"] == ""
    with pytest.raises(EngineError):
        dml.rollback(table)


def test_renumbering_in_blocks(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", RECNO).filter(f"{RECNO} % 3 <> 0")
    out = dml.renumbered(df.withColumn("old", df[RECNO]), block=64)
    rows = out.orderBy(RECNO).collect()
    assert [r[RECNO] for r in rows] == list(range(1, 668)) and [r["old"] for r in rows] == [i for i in range(1, 1001) if i % 3]


def test_record_sets(table):
    a, b = RecordSet.where(table, "K_C > 'M'"), RecordSet.range(table, 1, 16)
    members = lambda s: {r[0] for r in s.numbers.collect()}
    x, y, everything = members(a), members(b), set(KEYS)
    assert members(a.and_(b)) == x & y and members(a.or_(b)) == x | y and members(a.not_()) == everything - x
    assert a.count() == len(x) and b.next(4) == 5 and b.next(16) is None
    assert members(a.not_().or_(b.not_())) == members(a.and_(b).not_())


def test_physical_numbers_of_many_files(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    t = Table.open(spark, str(tmp_path / "t"), "t")
    assert sorted(recnos(t.df)) == list(range(1, 1001))
    assert t.df.filter(DELETED).count() == 0
