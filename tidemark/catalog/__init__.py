"""The registered queries: one for each operator, over the star schema and the event stream, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import changes, joins, reports, scalars, scans, surface
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "Callable", "DataFrame", "SparkSession", "changes", "joins", "reports", "scalars", "scans", "surface"]
