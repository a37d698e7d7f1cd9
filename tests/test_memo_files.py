"""Memos as files of their own, one each."""

from pathlib import Path

import pytest

from tidemark.catalog.changes import _through_files
from tidemark.errors import EngineError
from tidemark.sources import files
from tidemark.sources.memos import MemoFileReader, MemoFileSource, MemoFileWriter

ODD = [(1, "a"), (1, "a"), (1, "b\r\nc\n"), (2, ""), (3, None), (None, "no id"), (None, None), (4, "ä \0😀"), (-5, " x ")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    """Equal and missing ids, missing and empty memos, line ends."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    want = sorted(((k, None if v is None else len(v)) for k, v in ODD), key=repr)
    assert rows(_through_files(spark, df.coalesce(1))) == want
    assert rows(_through_files(spark, df.repartition(5))) == want


def test_a_file_a_memo_and_little_else(spark, tmp_path):
    df = spark.range(3000, numPartitions=3).selectExpr("id AS k", "repeat(cast(id AS string), 5) AS memo")
    files.write_memo_files(df, path := str(tmp_path / "memos"), "k", "memo")
    assert rows(files.open_memo_files(spark, path)) == rows(df)
    found = list(Path(path).rglob("*"))
    assert sum(p.suffix == ".txt" for p in found) == 3000 and len(found) <= 3000 + 3 * 3 + 1  # a folder, its names and a batch a task; the list
    listed = files.read_memo_files(spark, f"{path}/part-*/*/name=*.txt").selectExpr("regexp_extract(path, 'name=([0-9]+)[.]txt', 1)", "cast(content AS string)")
    assert rows(listed) == rows(df.selectExpr("cast(k AS string)", "memo"))


def test_names_and_bytes(spark, tmp_path):
    """Names that no file can have, a long one among them; memos that are no text, cut into several batches, with an equal name in each."""
    memos = [(n, bytes([i, 255]) * 9) for i, n in enumerate(["a/b", "..", "", "%2F", "é" * 300, "é" * 300 + "!", "same", "same", "same"])]
    df = spark.createDataFrame(memos, "n string, memo binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        files.write_memo_files(df, path := str(tmp_path / "memos"), "n", "memo")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = files.open_memo_files(spark, path)
    assert back.dtypes == df.dtypes and back.rdd.getNumPartitions() == 3
    assert rows(back) == rows(df)
    files.write_memo_files(df, path, "n", "memo")  # more files beside the first
    assert rows(files.open_memo_files(spark, path)) == rows(df.union(df))


def test_batches_by_bytes(spark, tmp_path, monkeypatch):
    files.write_memo_files(spark.range(10).selectExpr("id AS k", "repeat('x', 100) AS memo").coalesce(1), path := str(tmp_path), "k", "memo")
    monkeypatch.setattr(MemoFileReader, "BYTES", 250)
    source = MemoFileSource({"path": path})
    reader = source.reader(source.schema())
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [len(b) for b in batches] == [3, 3, 3, 1]
    assert [k for b in batches for k in b.column(0).to_pylist()] == list(range(10))


def test_only_committed_attempts_stay(spark, tmp_path):
    df = spark.range(3).selectExpr("id AS k", "'x' AS memo")
    writer = MemoFileWriter(df.schema, str(tmp_path))
    for attempt in ("000000.1", "000000.2"):
        (tmp_path / f"part-{writer.job}-{attempt}" / "000000").mkdir(parents=True)
    (tmp_path / "part-other-000000.1").mkdir()
    writer.abort([])
    assert [p.name for p in tmp_path.iterdir()] == ["part-other-000000.1"]
    with pytest.raises(EngineError):
        MemoFileSource({"path": str(tmp_path)}).schema()


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "k long, memo string")
    files.write_memo_files(df, path := str(tmp_path / "memos"), "k", "memo")
    assert files.open_memo_files(spark, path).dtypes == df.dtypes and files.open_memo_files(spark, path).count() == 0
