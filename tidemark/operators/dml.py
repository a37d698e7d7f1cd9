"""Changing tables. Tables are immutable: every operation returns a new one, which keeps the old as its snapshot."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError, UniqueError
from ..plans.sequence import numbered
from ..types import FieldInfo, blank, field_of
from .table import DELETED, RECNO, Table


def _changed(table: Table, df: DataFrame) -> Table:
    return replace(table, df=df, previous=table)


def append(table: Table, rows: DataFrame, order: list[str] | None = None) -> Table:
    """Adds records behind the last; order numbers several new ones. Unique tags are checked against old and new keys."""
    missing = [f for f in table.fields if f.name not in rows.columns]
    rows = rows.withColumns({f.name: blank(f.kind, table.df.schema[f.name].dataType) for f in missing})
    last = table.df.agg(F.coalesce(F.max(RECNO), F.lit(0))).first()[0]
    rows = numbered(rows, [F.col(f"`{c}`") for c in order or [f.name for f in table.fields]], RECNO)
    new = rows.select(*(F.col(f"`{f.name}`").cast(table.df.schema[f.name].dataType).alias(f.name) for f in table.fields), (F.col(RECNO) + last).cast("long").alias(RECNO), F.lit(False).alias(DELETED))
    out = _changed(table, table.df.unionByName(new))
    for tag in table.tags.values():
        if tag.unique == "error":
            # only keys of the new records can have become double
            fresh = Table(new, table.name, settings=table.settings, calcs=table.calcs, widths=table.widths)
            keys = fresh.df.select(fresh.key(tag).column.alias("k"))
            old = (table.df.filter(table.compiler().where(tag.filter)) if tag.filter else table.df).select(table.key(tag).column.alias("k"))
            if not keys.join(old, "k", "left_semi").isEmpty() or not keys.groupBy("k").count().filter("count > 1").isEmpty():
                raise UniqueError("duplicate key", f"tag {tag.name} of {table.name}")
    return out


def append_blank(table: Table) -> Table:
    last = table.df.agg(F.coalesce(F.max(RECNO), F.lit(0))).first()[0]
    return _changed(table, table.df.unionByName(table.go_eof().withColumn(RECNO, F.lit(last + 1).cast("long"))))


def update(table: Table, where: str | None, values: dict[str, str]) -> Table:
    """Assigns expressions to fields where a filter holds; values are cast to the field's type."""
    compiler = table.compiler(count=any("RECCOUNT" in v.upper() for v in [where or "", *values.values()]))
    test = F.coalesce(compiler.where(where), F.lit(False)) if where else F.lit(True)
    new = {table.field(k).name: F.when(test, convert(compiler.compile(v).column, table, k)).otherwise(F.col(f"`{table.field(k).name}`")) for k, v in values.items()}
    out = _changed(table, table.df.withColumns(new))
    for tag in table.tags.values():
        if tag.unique == "error":
            out.check_unique(tag.name)
    return out


def convert(column: Column, table: Table, name: str) -> Column:
    """A value as a field stores it; what can't be converted is null."""
    return column.try_cast(table.df.schema[table.field(name).name].dataType)


def set_null(table: Table, where: str, name: str) -> Table:
    field = table.field(name)
    return _changed(table, table.df.withColumn(field.name, F.when(F.coalesce(table.compiler().where(where), F.lit(False)), F.lit(None)).otherwise(F.col(f"`{field.name}`"))))


def _mark(table: Table, where: str, deleted: bool) -> Table:
    test = F.coalesce(table.compiler().where(where), F.lit(False))
    return _changed(table, table.df.withColumn(DELETED, F.when(test, F.lit(deleted)).otherwise(F.col(DELETED))))


def delete(table: Table, where: str) -> Table:
    """Marks records as deleted; they stay visible until pack."""
    return _mark(table, where, True)


def recall(table: Table, where: str) -> Table:
    return _mark(table, where, False)


def blank_records(table: Table, where: str) -> Table:
    test = F.coalesce(table.compiler().where(where), F.lit(False))
    columns = {c.name: F.when(test, blank(field_of(c).kind, c.dataType)).otherwise(F.col(f"`{c.name}`")) for c in table.df.schema if c.name not in (RECNO, DELETED)}
    return _changed(table, table.df.withColumns(columns))


def renumbered(df: DataFrame, block: int = 100_000) -> DataFrame:
    """Record numbers 1, 2, 3, … in the old order, by blocks of old numbers: one count a block crosses blocks."""
    rows = df.withColumn("_block", F.floor((F.col(RECNO) - 1) / block))
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_block", F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(RECNO))
    return rows.withColumn("_in", inside).join(before, "_block").withColumn(RECNO, (F.col("_before") + F.col("_in")).cast("long")).select(*df.columns)


def pack(table: Table) -> Table:
    """Drops deleted records for good and renumbers the others."""
    return _changed(table, renumbered(table.df.filter(~F.col(DELETED))))


def zap(table: Table, first: int, last: int) -> Table:
    """Drops a range of records and renumbers the others."""
    return _changed(table, renumbered(table.df.filter(~F.col(RECNO).between(first, last))))


def unappend(table: Table) -> Table:
    """Undoes the last change."""
    return rollback(table)


def start(table: Table) -> Table:
    """Begins a transaction: the table that rollback returns to."""
    return replace(table, previous=table)


def commit(table: Table) -> Table:
    return replace(table, previous=None)


def rollback(table: Table) -> Table:
    if table.previous is None:
        raise EngineError("no transaction", table.name)
    return table.previous


# Structure.


def add_fields(table: Table, fields: list[FieldInfo]) -> Table:
    """New fields are blank in all records."""
    for f in fields:
        if any(x.name.upper() == f.name.upper() for x in table.fields):
            raise EngineError("field exists", f.name)
    df = table.df
    for f in fields:
        df = df.withColumn(f.name, blank(f.kind, f.spark_type()).cast(f.spark_type())).withMetadata(f.name, f.metadata())
    return _changed(table, df)


def drop_fields(table: Table, names: list[str]) -> Table:
    return _changed(table, table.df.drop(*(table.field(n).name for n in names)))


def modify(table: Table, fields: list[FieldInfo]) -> Table:
    """A new structure: fields of the same name are converted (null where that fails), others are blank."""
    columns = []
    for f in fields:
        old = next((x for x in table.fields if x.name.upper() == f.name.upper()), None)
        kind = f.spark_type()
        value = F.col(f"`{old.name}`").try_cast(kind) if old else blank(f.kind, kind).cast(kind)
        if f.kind == "str" and f.width:
            value = F.rtrim(F.substring(value, 1, f.width))
        columns.append(value.alias(f.name, metadata=f.metadata()))
    return _changed(table, table.df.select(*columns, RECNO, DELETED))


def replace_contents(table: Table, rows: DataFrame, order: list[str]) -> Table:
    """The same structure with other records."""
    return append(_changed(table, table.df.limit(0)), rows, order)
