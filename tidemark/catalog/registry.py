"""Registering queries, and the tables they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import Table
from ..plans.compiler import Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Declared widths of text fields and (width, decimals) of numbers; the files don't hold them.
WIDTHS = {
    "customer": {"c_name": (18, 0), "c_mktsegment": (10, 0)},
    "part": {"p_name": (20, 0), "p_brand": (10, 0), "p_type": (10, 0)},
    "orders": {"o_orderstatus": (1, 0), "o_orderpriority": (15, 0)},
    "supplier": {"s_name": (18, 0)},
    "nation": {"n_name": (12, 0)},
    "region": {"r_name": (12, 0)},
    "events": {"event_type": (10, 0)},
    "lineitem": {"l_returnflag": (1, 0), "l_linestatus": (1, 0)},
}
# Days as dates, for the functions of dates.
DATES = {"orders": {"o_date": "o_orderdate"}, "lineitem": {"l_date": "l_shipdate"}, "events": {"e_date": "ts"}}
SETTINGS = Settings(date_picture="MM/DD/CCYY")


def table(spark: SparkSession, sf_dir: str, name: str, alias: str | None = None, widths: bool = True) -> Table:
    """A table of the driver's, with physical record numbers."""
    opened = Table.open(spark, f"{sf_dir}/{name}.parquet", alias or name, widths=WIDTHS.get(name, {}) if widths else {}, settings=SETTINGS)
    if name in DATES:
        from dataclasses import replace

        opened = replace(opened, df=opened.df.withColumns({k: F.to_date(v) for k, v in DATES[name].items()}))
    return opened


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def scalar(name: str, on: str, key: str, expressions: dict[str, tuple[str, str]], where: str = "") -> None:
    """Registers a projection: column name to (expression, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, on)
        return t.df.select(F.col(key), *(t.expr(e).alias(n) for n, (e, _) in expressions.items()))

    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {', '.join(f'{s} AS {n}' for n, (_, s) in expressions.items())} FROM {on}"


#: The physical record number of a table whose file is in the order of its key.
def recno(key: str) -> str:
    return f"row_number() OVER (ORDER BY {key})"
