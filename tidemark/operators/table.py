"""Tables: a DataFrame with record numbers, logical deletion and named orders (tags)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, ExpressionError, Status, UniqueError
from ..plans.compiler import COLLATIONS, Compiler, Settings, Typed, field_value
from ..plans.sequence import numbered
from ..types import FieldInfo, blank, field_of

RECNO, DELETED = "_recno", "_deleted"


@dataclass(frozen=True)
class Tag:
    """A named order: a key expression, with a filter, a direction, a uniqueness rule and a collation.

    unique: None, "continue" (the first record of each key is in the order) or "error" (duplicates are refused).
    """

    name: str
    key: str
    filter: str | None = None
    descending: bool = False
    unique: str | None = None
    collation: str = "machine"


def with_recno(df: DataFrame) -> DataFrame:
    """Physical record numbers of a file source: rows before the file (in the order of file paths) plus the row's place.

    One small row a file is aggregated; no window over all rows.
    """
    if len(df.inputFiles()) <= 1:
        return df.select("*", (F.col("_metadata.row_index") + 1).alias(RECNO))
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    rows = df.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")).groupBy("_path").agg((F.max("_row") + 1).alias("n"))
    files = rows.collect()
    before, total = [], 0
    for r in sorted(files, key=lambda r: r["_path"]):
        before.append((r["_path"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "_path string, _before long")
    return placed.join(offsets, "_path").withColumn(RECNO, F.col("_before") + F.col("_row") + 1).drop("_path", "_row", "_before")


@dataclass(frozen=True)
class Table:
    """An immutable table. df has the columns RECNO and DELETED besides the fields."""

    df: DataFrame
    name: str
    tags: dict[str, Tag] = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    widths: dict[str, tuple[int, int]] = field(default_factory=dict)
    calcs: dict[str, str] = field(default_factory=dict)
    selected: str | None = None
    previous: Table | None = None  # the snapshot that a rollback returns to

    # Opening.

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str, columns: list[str] | None = None, **options) -> Table:
        """A Parquet table with physical record numbers; options are those of the constructor."""
        df = spark.read.parquet(path)
        return cls.of(with_recno(df.select(*columns) if columns else df), name, **options)

    @classmethod
    def of(cls, df: DataFrame, name: str, recno: list[str] | None = None, **options) -> Table:
        """Any DataFrame. recno: columns whose order numbers the records, where df has no record numbers of its own."""
        if RECNO not in df.columns:
            if not recno:
                raise EngineError("no record numbers", f"{name} needs an order for its records")
            df = numbered(df, [F.col(c) for c in recno], RECNO)
        if DELETED not in df.columns:
            df = df.withColumn(DELETED, F.lit(False))
        return cls(df, name, **options)

    def clone(self, name: str) -> Table:
        """The same records under another alias."""
        return replace(self, name=name)

    # Structure.

    @property
    def fields(self) -> list[FieldInfo]:
        found = []
        for column in self.df.schema:
            if column.name not in (RECNO, DELETED):
                info = field_of(column)
                if column.name in self.widths:
                    info = replace(info, width=self.widths[column.name][0], decimals=self.widths[column.name][1])
                found.append(info)
        return found

    @property
    def record_width(self) -> int:
        """Width of a record, the deletion mark included; fields of unknown width count as 0."""
        return 1 + sum(f.width or 0 for f in self.fields)

    def field(self, name: str | int) -> FieldInfo:
        """A field by name (case-insensitive) or ordinal (from 1)."""
        if isinstance(name, int):
            if not 1 <= name <= len(self.fields):
                raise EngineError("no field", f"{self.name} has no field {name}")
            return self.fields[name - 1]
        found = next((f for f in self.fields if f.name.upper() == name.upper()), None)
        if found is None:
            raise EngineError("no field", f"{self.name} has no field {name}")
        return found

    def describe(self) -> list[dict]:
        return [{"name": f.name, "type": f.letter, "width": f.width, "dec": f.decimals, "nullable": f.nullable} for f in self.fields]

    # Expressions.

    def _resolve(self, name: str, alias: str | None) -> Typed:
        if alias is not None and alias.upper() != self.name.upper():
            raise ExpressionError("unknown alias", alias)
        info = self.field(name)
        dtype = self.df.schema[info.name].dataType
        return field_value(F.col(f"`{info.name}`"), info.kind, dtype, info.width, info.decimals)

    def compiler(self, collation: str = "machine", count: bool = False, totals: dict[str, Column] | None = None) -> Compiler:
        record = {"deleted": F.col(DELETED), "recno": F.col(RECNO)}
        if count:
            record["count"] = F.lit(self.df.count())
        return Compiler(self._resolve, replace(self.settings, collation=collation), self.calcs, totals, record)

    def expr(self, text: str) -> Column:
        """A compiled expression, to be selected."""
        return self.compiler(count="RECCOUNT" in text.upper()).compile(text).column

    def with_calc(self, name: str, text: str | None) -> Table:
        """Adds, changes or (None) removes a named expression."""
        calcs = {k: v for k, v in self.calcs.items() if k.upper() != name.upper()}
        table = replace(self, calcs=calcs if text is None else calcs | {name: text})
        if text is not None:
            table.compiler().compile(text)
        return table

    def rename_calc(self, old: str, new: str) -> Table:
        text = next((v for k, v in self.calcs.items() if k.upper() == old.upper()), None)
        if text is None:
            raise EngineError("no calculation", old)
        return self.with_calc(old, None).with_calc(new, text)

    def filter(self, text: str) -> Table:
        return replace(self, df=self.df.filter(self.compiler(count="RECCOUNT" in text.upper()).where(text)))

    def select(self, **expressions: str) -> DataFrame:
        return self.df.select(*(self.expr(e).alias(n) for n, e in expressions.items()))

    def optimised(self) -> Table:
        """The table with its records kept in the executors' memory, or on their disks, from the first use on."""
        return replace(self, df=self.df.persist())

    def released(self) -> Table:
        """Gives up what optimised() kept; lost records are computed anew in any case."""
        self.df.unpersist()
        return self

    # Tags.

    def with_tag(self, tag: Tag) -> Table:
        """Adds a tag; a unique one that refuses duplicates is checked at once."""
        table = replace(self, tags=self.tags | {tag.name: tag})
        if tag.unique == "error":
            table.check_unique(tag.name)
        return table

    def without_tag(self, name: str) -> Table:
        return replace(self, tags={k: v for k, v in self.tags.items() if k != name}, selected=None if self.selected == name else self.selected)

    def set_unique(self, name: str, unique: str | None) -> Table:
        return self.with_tag(replace(self.tags[name], unique=unique))

    def select_tag(self, name: str | None) -> Table:
        """The tag that orders scans and seeks; None for record order."""
        if name is not None and name not in self.tags:
            raise EngineError("no tag", name)
        return replace(self, selected=name)

    def tag(self, name: str | None = None) -> Tag | None:
        name = name or self.selected
        if name is not None and name not in self.tags:
            raise EngineError("no tag", name)
        return self.tags[name] if name else None

    def key(self, tag: Tag) -> Typed:
        """A tag's key, in its collation."""
        value = self.compiler(tag.collation).compile(tag.key)
        column = value.plain if value.plain is not None else value.column
        if value.is_text and COLLATIONS.get(tag.collation):
            column = F.collate(column, COLLATIONS[tag.collation])
        return replace_column(value, column)

    def order(self, name: str | None = None, reverse: bool = False) -> list[Column]:
        """Ordering columns of a tag: (key, record number), both turned round in a descending tag; nulls are least."""
        tag = self.tag(name)
        recno = F.col(RECNO)
        if tag is None:
            return [recno.desc() if reverse else recno.asc()]
        down = tag.descending != reverse
        keys = [self.key(tag).column]
        return [*(k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys), recno.desc() if down else recno.asc()]

    def entries(self, name: str | None = None) -> DataFrame:
        """The records that a tag holds, unordered: its filter and its uniqueness rule applied."""
        tag = self.tag(name)
        if tag is None:
            return self.df
        df = self.df.filter(self.compiler().where(tag.filter)) if tag.filter else self.df
        if tag.unique == "continue":
            # The least record number of each key: an aggregation with partial minima, not a sort of whole records.
            key = self.key(tag).column
            firsts = df.groupBy(key.alias("_key")).agg(F.min(RECNO).alias(RECNO)).select(RECNO)
            df = df.join(firsts, RECNO, "left_semi")
        return df

    def walk(self, name: str | None = None, reverse: bool = False) -> DataFrame:
        """All records of a tag in its order."""
        return self.entries(name).orderBy(*self.order(name, reverse))

    def tag_count(self, name: str) -> int:
        return self.entries(name).count()

    def duplicates(self, name: str) -> DataFrame:
        """Keys that occur more than once in a tag's records, with their counts."""
        tag = self.tag(name)
        df = self.df.filter(self.compiler().where(tag.filter)) if tag.filter else self.df
        return df.groupBy(self.key(tag).column.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    def check_unique(self, name: str) -> None:
        twice = self.duplicates(name).limit(1).collect()
        if twice:
            raise UniqueError("duplicate key", f"tag {name} of {self.name}: {twice[0]['key']!r}")

    def check(self) -> dict[str, bool]:
        """Of each tag, whether its entries agree with the table: unique ones have one record a key."""
        return {n: t.unique is None or self.entries(n).groupBy(self.key(t).column.alias("k")).count().filter("count > 1").isEmpty() for n, t in self.tags.items()}

    # Navigation.

    def top(self, name: str | None = None) -> DataFrame:
        return self.walk(name).limit(1)

    def bottom(self, name: str | None = None) -> DataFrame:
        return self.walk(name, reverse=True).limit(1)

    def go(self, recno: int) -> DataFrame:
        return self.df.filter(F.col(RECNO) == recno)

    def go_eof(self) -> DataFrame:
        """One blank record."""
        columns = [blank(field_of(c).kind, c.dataType).alias(c.name) if c.name not in (RECNO, DELETED) else F.lit(None).cast("long").alias(RECNO) if c.name == RECNO else F.lit(False).alias(DELETED) for c in self.df.schema]
        return self.df.sparkSession.range(1).select(*columns)

    def skip(self, recno: int, n: int, name: str | None = None) -> tuple[Status, DataFrame]:
        """The record n places after (before, if negative) record recno in a tag's order.

        Beyond the end it is the blank record, beyond the beginning the first record.  Only the records on that side of
        the start are sorted, and of them only |n| are kept.
        """
        start = self.entries(name).filter(F.col(RECNO) == recno).limit(1)
        side = self._beyond(start, name, n < 0)
        if n == 0:
            found = start
        else:
            ordered = side.orderBy(*self.order(name, reverse=n < 0)).limit(abs(n))
            if ordered.count() < abs(n):
                return (Status.EOF, self.go_eof()) if n > 0 else (Status.BOF, self.top(name))
            found = ordered.orderBy(*self.order(name, reverse=n >= 0)).limit(1)
        return (Status.NO_RECORD, self.go_eof()) if found.isEmpty() else (Status.FOUND, found)

    def _beyond(self, start: DataFrame, name: str | None, back: bool) -> DataFrame:
        """Entries after (or before) one record in a tag's order."""
        tag = self.tag(name)
        entries = self.entries(name)
        row = start.select(*([self.key(tag).column.alias("k")] if tag else []), RECNO).first()
        if row is None:
            return entries.limit(0)
        down = bool(tag and tag.descending) != back
        r = F.col(RECNO)
        further = r < row[RECNO] if down else r > row[RECNO]
        if tag is None:
            return entries.filter(further)
        key = self.key(tag).column
        if row["k"] is None:
            past = F.lit(False) if down else key.isNotNull()
            same = key.isNull()
        else:
            past = (F.coalesce(key < F.lit(row["k"]), F.lit(True)) if down else key > F.lit(row["k"]))
            same = key == F.lit(row["k"])
        return entries.filter(past | (same & further))

    def sequenced(self, name: str | None = None, place: str = "_seq", reverse: bool = False, columns: list[Column] | None = None) -> DataFrame:
        """The entries (or some columns of them) with their places 1, 2, 3, … in a tag's order."""
        return numbered(self.entries(name), self.order(name, reverse), place, columns)

    def position(self, name: str | None = None) -> DataFrame:
        """Every entry with its fraction of the order, 0 for the first and 1 for the last."""
        rows = self.sequenced(name, "position")
        last = rows.agg(F.max("position")).first()[0] or 1
        return rows.withColumn("position", (F.col("position") - 1) / F.lit(float(max(1, last - 1))))

    def position_set(self, fraction: float, name: str | None = None) -> DataFrame:
        """The entry at a fraction of the order: number ceil(fraction * n), the first at 0."""
        n = self.entries(name).count()
        at = max(1, -int(-fraction * n // 1)) if n else 0
        return self.walk(name).offset(at - 1).limit(1) if n else self.df.limit(0)

    def record_count(self) -> int:
        """All records, deleted ones included."""
        return self.df.count()

    # Seeks.

    def _seek_key(self, value, tag: Tag, whole: bool) -> tuple[Column, object]:
        """Key column and the value to compare it with; text keys of known width are compared at full width."""
        key = self.key(tag)
        if key.is_text and isinstance(value, str):
            if key.width is not None:
                return F.rpad(key.column, key.width, " "), value.ljust(key.width) if whole else value[: key.width]
            return F.rtrim(key.column) if whole else key.column, value.rstrip() if whole else value
        if not key.is_text and isinstance(value, str):
            raise EngineError("type", f"tag {tag.name} isn't a text order")
        return key.column, value

    def seek(self, value, name: str | None = None) -> tuple[Status, DataFrame]:
        """The classic seek: a text is a prefix of the key, unless it has trailing blanks; else the next entry."""
        tag = self._needed(name)
        if isinstance(value, str) and len(value):
            matching = self._prefixed(tag, value)
            found = self._first(matching, tag)
            if not found.isEmpty():
                return Status.FOUND, found
        elif value is not None and not isinstance(value, str):
            key, v = self._seek_key(value, tag, True)
            found = self._first(self.entries(tag.name).filter(key == F.lit(v)), tag)
            if not found.isEmpty():
                return Status.FOUND, found
        elif value is None:
            found = self._first(self.entries(tag.name).filter(self.key(tag).column.isNull()), tag)
            return (Status.FOUND, found) if not found.isEmpty() else (Status.EOF, self.go_eof())
        else:
            return Status.FOUND, self.top(tag.name)
        key, v = self._seek_key(value, tag, False)
        after = self.entries(tag.name).filter(F.coalesce(key < F.lit(v), F.lit(True)) if tag.descending else key > F.lit(v))
        found = self._first(after, tag)
        return (Status.AFTER, found) if not found.isEmpty() else (Status.EOF, self.go_eof())

    def _needed(self, name: str | None) -> Tag:
        tag = self.tag(name)
        if tag is None:
            raise EngineError("no tag", "a seek needs a tag")
        return tag

    def _prefixed(self, tag: Tag, value: str) -> DataFrame:
        key, v = self._seek_key(value, tag, False)
        return self.entries(tag.name).filter(key.startswith(v))

    def _first(self, df: DataFrame, tag: Tag) -> DataFrame:
        return df.orderBy(*self.order(tag.name)).limit(1)

    def seek_exact(self, value, name: str | None = None) -> DataFrame:
        """The first entry of a whole key; no row on a miss."""
        tag = self._needed(name)
        key, v = self._seek_key(value, tag, True)
        return self._first(self.entries(tag.name).filter(key == F.lit(v)), tag)

    def seek_prefix(self, value: str, name: str | None = None) -> DataFrame:
        tag = self._needed(name)
        return self._first(self._prefixed(tag, value), tag)

    def seek_at_or_after(self, value, name: str | None = None) -> DataFrame:
        """The first entry at or after a key, in the direction of the tag."""
        tag = self._needed(name)
        key, v = self._seek_key(value, tag, True)
        return self._first(self.entries(tag.name).filter(F.coalesce(key <= F.lit(v), F.lit(True)) if tag.descending else key >= F.lit(v)), tag)

    def seek_at_or_before(self, value, name: str | None = None) -> DataFrame:
        """The last entry at or before a key, in the direction of the tag."""
        tag = self._needed(name)
        key, v = self._seek_key(value, tag, True)
        side = self.entries(tag.name).filter(key >= F.lit(v) if tag.descending else F.coalesce(key <= F.lit(v), F.lit(True)))
        return side.orderBy(*self.order(tag.name, reverse=True)).limit(1)

    def seek_nth(self, value, n: int, name: str | None = None, prefix: bool = False) -> DataFrame:
        """The n-th entry (from 1) of a key; negative from the end."""
        tag = self._needed(name)
        key, v = self._seek_key(value, tag, not prefix)
        match = self.entries(tag.name).filter(key.startswith(v) if prefix else key == F.lit(v))
        return match.orderBy(*self.order(tag.name, reverse=n < 0)).offset(abs(n) - 1).limit(1)

    def seek_next(self, value, recno: int, name: str | None = None) -> DataFrame:
        """The entry after record recno among those of a key; the first of them if recno isn't one of them."""
        tag = self._needed(name)
        key, v = self._seek_key(value, tag, True)
        match = self.entries(tag.name).filter(key == F.lit(v))
        if match.filter(F.col(RECNO) == recno).isEmpty():
            return self._first(match, tag)
        return self._first(match.filter(F.col(RECNO) < recno if tag.descending else F.col(RECNO) > recno), tag)

    def seek_entry(self, value, recno: int, name: str | None = None) -> DataFrame:
        """The entry of a key and a record number."""
        tag = self._needed(name)
        key, v = self._seek_key(value, tag, True)
        return self.entries(tag.name).filter((key == F.lit(v)) & (F.col(RECNO) == recno))

    def seek_many(self, keys: DataFrame, column: str, name: str | None = None) -> DataFrame:
        """Exact seeks of all keys of a DataFrame in one job: its rows with the fields of the first entry (null on a miss).

        Only keys and record numbers are aggregated, of the wanted keys alone; the records found are fetched by number.
        """
        tag = self._needed(name)
        key = self.key(tag)
        wanted = keys.withColumn("_key", F.rtrim(F.col(column)) if key.is_text else F.col(column))
        entries = self.entries(tag.name).select((F.rtrim(key.column) if key.is_text else key.column).alias("_key"), F.col(RECNO).alias("_first"))
        firsts = entries.join(wanted.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg((F.max if tag.descending else F.min)("_first").alias("_first"))
        names = [c for c in self.df.columns if c != DELETED]
        rows = self.df.select(*(F.col(f"`{c}`").alias(f"_f_{c}") for c in names))
        found = wanted.join(firsts, "_key", "left").join(rows, F.col("_first") == F.col(f"_f_{RECNO}"), "left")
        return found.select(*(F.col(f"`{c}`") for c in keys.columns), *(F.col(f"`_f_{c}`").alias(c) for c in names if c not in keys.columns))


def replace_column(value: Typed, column: Column) -> Typed:
    return replace(value, column=column)
