"""Directories, text files and memo files as sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import DELETED, RECNO, Table
from ..plans.storage import remove
from ..types import FieldInfo, blank
from .memos import MemoFileSource


def list_tables(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet and DBF tables of a directory: name, path. Only names are listed, through the file system of the path."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    rows = []
    for status in found:
        name = status.getPath().getName()
        stem, dot, kind = name.rpartition(".")
        if dot and kind.lower() in ("parquet", "dbf"):
            rows.append((stem, status.getPath().toString()))
    return spark.createDataFrame(rows, "name string, path string")


def create_table(spark: SparkSession, fields: list[FieldInfo], name: str, **options) -> Table:
    """An empty table of a structure."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.spark_type(), f.nullable, f.metadata()) for f in fields] + [T.StructField(RECNO, T.LongType()), T.StructField(DELETED, T.BooleanType())])
    return Table(spark.createDataFrame([], schema), name, **options)


def write_table(table: Table, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    """Stores a table with its record numbers and deletion marks; field metadata goes with the schema."""
    table.df.write.mode(mode).option("compression", compression).parquet(path)


def read_table(spark: SparkSession, path: str, name: str, **options) -> Table:
    """A table that write_table stored."""
    return Table(spark.read.parquet(path), name, **options)


def remove_table(spark: SparkSession, path: str) -> bool:
    """Deletes a stored table; whether there was one."""
    return remove(spark, path)


def import_text(spark: SparkSession, path: str, fields: list[FieldInfo], name: str, **options) -> Table:
    """Text files of fixed-width records as a table; a value that can't be read is the type's blank.

    Records are numbered by file, in the order of their paths, and by place in the file.
    """
    lines = spark.read.text(path).select("value", *_places())
    columns, at = [], 1
    for f in fields:
        raw = F.rtrim(F.substring("value", at, f.width))
        kind = f.spark_type()
        value = raw if f.kind == "str" else F.try_to_date(raw, "yyyyMMdd") if f.kind == "date" else raw.isin(*"TtYy") if f.kind == "log" else F.trim(raw).try_cast(kind)
        columns.append(F.coalesce(value.cast(kind), blank(f.kind, kind).cast(kind)).alias(f.name, metadata=f.metadata()))
        at += f.width
    return Table.of(_numbered(lines.select(*columns, "_file", "_split", "_line")), name, **options)


def _places() -> list[Column]:
    """Of a line: its file, the beginning of its part of the file, and its place in the task."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line")]


def _numbered(df: DataFrame) -> DataFrame:
    """Record numbers by file, part of the file and place: one row a part, with its first place and its size, goes to the driver.

    A part of a file is read by one task in the order of its lines, whatever other parts the task reads.
    """
    parts = df.groupBy("_file", "_split").agg(F.min("_line").alias("_least"), F.count(F.lit(1)).alias("n")).collect()
    before, total = [], 0
    for r in sorted(parts, key=lambda r: (r["_file"], r["_split"])):
        before.append((r["_file"], r["_split"], r["_least"], total))
        total += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_file string, _split long, _least long, _before long"))
    return df.join(offsets, ["_file", "_split"]).withColumn(RECNO, F.col("_before") + F.col("_line") - F.col("_least") + 1).drop("_file", "_split", "_line", "_least", "_before")


def read_memo_files(spark: SparkSession, path: str) -> DataFrame:
    """Any whole files as memos: path, content, length. The driver lists them; open_memo_files needs no listing."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def write_memo_files(df: DataFrame, path: str, name: str, memo: str) -> None:
    """A file for each row, named by one column and holding another (binary, or as text) byte for byte; rows whose memo is null have none.

    The files are added to those that the folder holds. All of the rows are found again by open_memo_files.
    """
    df.sparkSession.dataSource.register(MemoFileSource)
    held = F.col(memo) if dict(df.dtypes)[memo] == "binary" else F.col(memo).cast("string").alias(memo)
    df.select(F.col(name), held).write.format("memo_files").mode("append").save(path)


def open_memo_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows that write_memo_files stored: their names, and their memos read from the files."""
    spark.dataSource.register(MemoFileSource)
    return spark.read.format("memo_files").load(path)
