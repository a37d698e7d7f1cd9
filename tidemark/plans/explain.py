"""What a plan does at its scans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    """The formatted physical plan, in full."""
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach the scans, null checks aside."""
    found = [x for part in re.findall(r"PushedFilters: \[(.*)\]", formatted(df)) for x in re.split(r", (?=[A-Z])", part) if x]
    return [x for x in found if not x.startswith("IsNotNull(")]
