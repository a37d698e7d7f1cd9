"""Relations over a stream: a streaming master with static slaves.

The classic engine has no streams.  This only applies compiled filters and exact lookups, which are row-wise, to a
streaming DataFrame, so that a query written for tables also runs on arriving records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators.relation import Relation
from ..operators.table import DELETED, RECNO, Table


def stream_table(df: DataFrame, name: str, **options) -> Table:
    """A streaming DataFrame as a table; its records have no numbers."""
    if not df.isStreaming:
        raise EngineError("not a stream", name)
    return Table(df.withColumn(RECNO, F.lit(0).cast("long")).withColumn(DELETED, F.lit(False)), name, **options)


def stream_relation(relation: Relation) -> DataFrame:
    """The composites of a relation whose master is a stream; only exact lookups that don't stop and single scans are possible."""
    for node in relation.nodes[1:]:
        if node.action == "terminate" or node.type == "approx":
            raise EngineError("relation", f"{node.alias} depends on an order that a stream doesn't have")
    if relation.sort_text:
        raise EngineError("relation", "a stream can't be sorted")
    return relation.composites()
