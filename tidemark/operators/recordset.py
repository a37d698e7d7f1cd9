"""Sets of record numbers and their algebra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .table import RECNO, Table


@dataclass(frozen=True)
class RecordSet:
    """Record numbers of one table, as rows."""

    table: Table
    numbers: DataFrame

    @classmethod
    def where(cls, table: Table, text: str) -> RecordSet:
        return cls(table, table.df.filter(table.compiler().where(text)).select(RECNO))

    @classmethod
    def range(cls, table: Table, first: int, last: int) -> RecordSet:
        return cls(table, table.df.filter(F.col(RECNO).between(first, last)).select(RECNO))

    def and_(self, other: RecordSet) -> RecordSet:
        return RecordSet(self.table, self.numbers.join(other.numbers, RECNO, "left_semi"))

    def or_(self, other: RecordSet) -> RecordSet:
        return RecordSet(self.table, self.numbers.unionAll(other.numbers).distinct())

    def not_(self) -> RecordSet:
        return RecordSet(self.table, self.table.df.select(RECNO).join(self.numbers, RECNO, "left_anti"))

    def count(self) -> int:
        return self.numbers.count()

    def next(self, after: int) -> int | None:
        """The least member above a number."""
        return self.numbers.filter(F.col(RECNO) > after).agg(F.min(RECNO)).first()[0]

    def bitmap(self) -> DataFrame:
        """Bitmaps of the members by bucket of record numbers, for a compact exchange."""
        return self.numbers.groupBy(F.bitmap_bucket_number(RECNO).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(RECNO)).alias("bits"))

    def records(self) -> DataFrame:
        return self.table.df.join(self.numbers, RECNO, "left_semi")
