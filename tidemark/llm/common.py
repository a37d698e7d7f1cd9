"""Shared plumbing of the corpus operators.

Conventions that hold for every operator of this subpackage:

* An operator takes a DataFrame and the names of the columns it needs, selects only those, and returns
  its own columns.  Other columns of the input, whatever their names, are neither read nor returned.
* A null text counts as the empty text unless the operator says otherwise.  Rows are never merged: equal
  rows stay separate rows, with equal results.
* Python work is batched through Arrow (``mapInArrow``); a batch holds some thousand rows at most.
* Intermediate tables that several jobs read are written to the checkpoint folder that all executors share.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..plans.storage import materialise, new_folder, remove, shared_dir  # noqa: F401

#: Bytes of an Arrow batch, where the session still has Spark's default (64 MB): texts can be long, and a worker holds
#: a batch several times over.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started, and bounds their batches."""
    if spark.conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def schema_of(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def map_columns(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Runs a batch function over some columns.

    ``make()`` is called once a task and returns a function that takes one Python list per column and
    returns one list per output column (their lengths agree with one another, not necessarily with the input).
    """
    prepare(df.sparkSession)
    target = to_arrow_schema(schema_of(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = work(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, target, strict=True)], schema=target)

    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has columns of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bucket3(doc_id: str | Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; rows with remainder 2 are held out. Null for a null id."""
    key = F.col(f"`{doc_id}`") if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out of training; a row without an id is not held out and not trained on."""
    return F.coalesce(bucket3(doc_id) == 2, F.lit(False))


def trainable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(bucket3(doc_id) != 2, F.lit(False))
