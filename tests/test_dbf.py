import datetime as dt
import decimal
import struct

import pytest

from tidemark.sources.dbf import open_dbf
from tidemark.sources.files import create_table, import_text, read_table, write_table
from tidemark.types import FieldInfo

FIELDS = [("ID", "I", 4, 0, 0), ("NAME", "C", 10, 0, 0), ("AMT", "N", 8, 2, 2), ("BORN", "D", 8, 0, 2), ("OK", "L", 1, 0, 0), ("MONEY", "Y", 8, 4, 0), ("AT", "T", 8, 0, 0), ("X", "B", 8, 2, 0), ("NOTE", "M", 4, 0, 0), ("_NullFlags", "0", 1, 0, 1)]


def build(folder, records, memos, mark=0x03):
    """A table with its memo file, as bytes."""
    width = 1 + sum(f[2] for f in FIELDS)
    start = 32 + 32 * len(FIELDS) + 1 + 263
    head = struct.pack("<BBBBIHH", 0x30, 24, 1, 1, len(records), start, width) + bytes(16) + bytes([2, mark, 0, 0])
    for name, letter, length, decimals, flags in FIELDS:
        head += name.encode().ljust(11, b"\0") + letter.encode() + bytes(4) + bytes([length, decimals, flags]) + bytes(13)
    (folder / "t.dbf").write_bytes(head + b"\r" + bytes(263) + b"".join(records) + b"\x1a")
    body = struct.pack(">I", 8) + bytes(2) + struct.pack(">H", 64) + bytes(504)
    for text in memos:
        data = struct.pack(">II", 1, len(text)) + text
        body += data + bytes(-len(data) % 64)
    (folder / "t.fpt").write_bytes(body)


def record(n, name, amount, born, ok, money, at, x, memo, flags=0, deleted=False, encoding="cp1252"):
    return (b"*" if deleted else b" ") + struct.pack("<i", n) + name.encode(encoding).ljust(10) + amount.rjust(8).encode() + born.encode().ljust(8) + ok + struct.pack("<q", money) + struct.pack("<ii", *at) + struct.pack("<d", x) + struct.pack("<i", memo) + bytes([flags])


def test_reading(spark, tmp_path):
    records = [
        record(1, "Zoë", "12.50", "19810101", b"T", -123456789, (2444606, 3_661_000), 1.5, 8),
        record(-2, "", "", "        ", b" ", 0, (0, 0), -0.0, 0, deleted=True),
        record(3, "x", "-1.00", "20240229", b"y", 10000, (2460370, 86_399_999), 2.25, 9, flags=0b11),
    ]
    build(tmp_path, records, ["größe".encode("cp1252"), b"second"])
    t = open_dbf(spark, str(tmp_path / "t.dbf"), "t", rows_per_partition=2)
    rows = t.df.orderBy("_recno").collect()
    assert [f.name for f in t.fields] == ["ID", "NAME", "AMT", "BORN", "OK", "MONEY", "AT", "X", "NOTE"]
    assert rows[0].asDict() == {"ID": 1, "NAME": "Zoë", "AMT": decimal.Decimal("12.50"), "BORN": dt.date(1981, 1, 1), "OK": True, "MONEY": decimal.Decimal("-12345.6789"), "AT": dt.datetime(1981, 1, 1, 1, 1, 1), "X": 1.5, "NOTE": "größe", "_recno": 1, "_deleted": False}
    assert rows[1]["NAME"] == "" and rows[1]["AMT"] is None and rows[1]["BORN"] is None and rows[1]["OK"] is False and rows[1]["AT"] is None and rows[1]["NOTE"] == "" and rows[1]["_deleted"]
    assert rows[2]["AMT"] is None and rows[2]["BORN"] is None and rows[2]["NOTE"] == "second" and rows[2]["AT"] == dt.datetime(2024, 3, 1)
    assert t.field("name").width == 10
    assert [r["ID"] for r in t.filter("NAME = 'x'").df.collect()] == [3]
    assert t.filter(".NOT. DELETED()").record_count() == 2


def test_code_page_and_empty(spark, tmp_path):
    build(tmp_path, [record(1, "Привет", "", "", b"F", 0, (0, 0), 0, 0, encoding="cp1251")], [], mark=0xC9)
    assert open_dbf(spark, str(tmp_path / "t.dbf"), "t").df.first()["NAME"] == "Привет"
    build(tmp_path, [], [])
    assert open_dbf(spark, str(tmp_path / "t.dbf"), "t2").df.count() == 0


def test_columns_decode_like_cells():
    """Every type, on well-formed, blank, malformed and random bytes."""
    import random

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from tidemark.sources import dbf

    drawn = random.Random(6)
    some = {
        "C": [b"abc   ", b"      ", b"  x   ", b"a\x00b   ", "é ß ".encode("cp1252").ljust(6)], "N": [b"  1.50", b"      ", b" -2.00", b"\x00\x00\x00\x00\x00\x00", b"   7  ", b"  +3.1"],
        "D": [b"20240229", b"        ", b"19991231", b"00010101", b"99991231"], "L": [b"T", b"t", b"Y", b"?", b" ", b"F"],
    }
    odd = {"C": [bytes([200] * 6)], "N": [b"  oops", b" 1.555", b"   .5 ", b"   1e2", b"******"], "D": [b"20240631", b"2024 2 3", b"00000000", b"abcdefgh"], "L": []}
    sizes = {"I": 4, "B": 8, "H": 4, "Y": 8, "T": 8, "7": 8, "P": 4, "Q": 2, "R": 2, "1": 8, "6": 8, "Z": 5}
    for letter in [*some, *sizes]:
        random_ = [drawn.randbytes(sizes.get(letter, 4)) for _ in range(50)]
        if letter in "T7":
            random_ = [struct.pack("<ii", drawn.choice([0, -5, 2444606, 1721426, 5373484, 5373485]), drawn.randrange(86_400_000)) for _ in range(50)]
        for cells in ([*some[letter]], some[letter] + odd[letter], []) if letter in some else (random_, []):
            size = len((some.get(letter) or random_)[0])
            slot = dbf.Slot(FieldInfo("X", letter, size, 2 if letter == "N" else 0), 1, size, None)
            kind = to_arrow_type(slot.info.spark_type())
            block = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, size)
            got = dbf.decode_column(slot, block, kind, "cp1252", None)
            want = pa.array([dbf.decode(slot, c, "cp1252", None) for c in cells], kind)
            assert got.type == kind and (got.equals(want) or repr(got.to_pylist()) == repr(want.to_pylist())), letter


def test_written_tables_read_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources.dbf import write_dbf

    fields = [FieldInfo("NAME", "C", 300), FieldInfo("AMT", "N", 12, 3), FieldInfo("ID", "I"), FieldInfo("X", "B"), FieldInfo("MONEY", "Y"), FieldInfo("OK", "L"), FieldInfo("BORN", "D"), FieldInfo("AT", "T"), FieldInfo("NOTE", "M")]
    made = create_table(spark, fields, "made")
    rows = [("Zoë" + "x" * i, decimal.Decimal(f"{i}.125"), -i, i / 3, decimal.Decimal("-1.5000"), i % 2 == 0, dt.date(2024, 2, 28 + i % 2), dt.datetime(2024, 1, 1, 23, 59, i % 60), "note\n" * (i % 40), i + 1, i % 7 == 0) for i in range(250)]
    rows += [(None,) * 9 + (251, False), ("", decimal.Decimal("0"), 0, 0.0, decimal.Decimal(0), False, None, None, "", 252, False)]
    df = spark.createDataFrame(rows, made.df.schema).repartitionByRange(3, "_recno")
    for f in fields:
        df = df.withMetadata(f.name, f.metadata())
    from tidemark.operators.table import Table

    path = str(tmp_path / "out")
    for _ in range(2):  # the second write replaces the first
        write_dbf(Table(df, "made"), path)
        back = open_dbf(spark, path, "made", rows_per_partition=40)
        got = [tuple(r) for r in back.df.orderBy("_recno").collect()]
        assert got == rows
    write_dbf(Table(df.limit(5), "made"), path, mode="append")
    assert open_dbf(spark, path, "made").df.count() == 257
    assert not [x for x in (tmp_path / "out").iterdir() if x.name.endswith(".undone")]
    assert [(f.letter, f.width, f.decimals) for f in back.fields] == [("C", 300, 0), ("N", 12, 3), ("I", 4, 0), ("B", 8, 0), ("Y", 8, 0), ("L", 1, 0), ("D", 8, 0), ("T", 8, 0), ("M", 4, 0)]
    plain = spark.range(3).select("id", F.lit("text").alias("t"), (F.col("id") / 2).alias("half"), F.lit(True).alias("b"))
    plain.write.format("dbf").mode("overwrite").save(str(tmp_path / "plain"))
    assert sorted((int(r["id"]), r["t"], r["half"], r["b"]) for r in open_dbf(spark, str(tmp_path / "plain"), "p").df.collect()) == [(i, "text", i / 2, True) for i in range(3)]
    with pytest.raises(Exception, match="too wide"):
        write_dbf(Table(spark.createDataFrame([("abcdef",)], "C string").withMetadata("C", FieldInfo("C", "C", 3).metadata()), "x"), str(tmp_path / "bad"))


def test_created_tables_keep_their_structure(spark, tmp_path):
    t = create_table(spark, [FieldInfo("A", "C", 5), FieldInfo("B", "N", 8, 2)], "made")
    write_table(t, str(tmp_path / "made"))
    again = read_table(spark, str(tmp_path / "made"), "made")
    assert [(f.letter, f.width, f.decimals) for f in again.fields] == [("C", 5, 0), ("N", 8, 2)]


def test_text_import(spark, tmp_path):
    (tmp_path / "x.txt").write_text("AB   12.5 20240229T\n     oops          \n")
    t = import_text(spark, str(tmp_path / "x.txt"), [FieldInfo("C", "C", 5), FieldInfo("N", "B", 5), FieldInfo("D", "D", 8), FieldInfo("L", "L", 1)], "x")
    rows = t.df.orderBy("_recno").collect()
    assert tuple(rows[0])[:4] == ("AB", 12.5, dt.date(2024, 2, 29), True)
    assert tuple(rows[1])[:4] == ("", 0.0, None, False)


def test_text_files_are_numbered_one_after_the_other(spark, tmp_path):
    """Whatever their sizes, and though a task reads several, or only part of one."""
    want = []
    for name, n in (("a", 3), ("b", 2000), ("c", 0), ("d", 1), ("e", 700)):
        lines = [f"{name}{i:04}" for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    for size in ("128m", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            t = import_text(spark, str(tmp_path), [FieldInfo("C", "C", 5)], "x")
            assert [r["C"] for r in t.df.orderBy("_recno").collect()] == want
            assert sorted(r["_recno"] for r in t.df.collect()) == list(range(1, len(want) + 1))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_shared_folders_are_required_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidemark.errors import EngineError
    from tidemark.plans.storage import shared_dir

    unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", _jsc=SimpleNamespace(sc=lambda: unset)))
    with pytest.raises(EngineError, match="shared"):
        shared_dir(cluster)
    assert shared_dir(spark)


@pytest.mark.parametrize("n", [0, 1])
def test_streams_take_filters_and_lookups(spark, tmp_path, n):
    from tidemark.operators.relation import Relation
    from tidemark.operators.table import Table, Tag
    from tidemark.streaming.lookups import stream_relation, stream_table

    spark.range(20).selectExpr("id AS k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    side = Table.of(spark.range(5).selectExpr("id AS k", "id * 10 AS v"), "side", recno=["k"]).with_tag(Tag("k", "k", unique="error"))
    r = Relation(stream_table(stream, "s"))
    r.slave(side, "k", "k", action="skip")
    out = stream_relation(r.query(f"k > {n}"))
    q = out.selectExpr("side__v AS v").writeStream.format("memory").queryName(f"out{n}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["v"] for r in spark.table(f"out{n}").collect()) == [10 * i for i in range(n + 1, 5)]
