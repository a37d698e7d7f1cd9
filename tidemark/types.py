"""Field types: letters of the classic table format, their Spark types and what a blank field holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of values in expressions.
STR, NUM, FLT, DATE, TIME, LOG, CUR, MEMO, BIN = "str", "num", "flt", "date", "datetime", "log", "cur", "memo", "bin"

# Type letters and the kind of value an expression sees.
LETTERS = {
    "C": STR, "N": NUM, "F": NUM, "D": DATE, "L": LOG, "I": NUM, "B": NUM, "H": FLT, "Y": CUR, "T": TIME, "7": TIME, "M": MEMO, "X": BIN, "G": BIN,
    "Z": BIN, "W": STR, "O": STR, "P": NUM, "Q": NUM, "R": NUM, "1": NUM, "6": NUM, "2": DATE, "3": BIN, "4": TIME, "5": TIME, "V": BIN,
}


@dataclass(frozen=True)
class FieldInfo:
    """A field: name, type letter, width and decimals (None if unknown), whether it may be null."""

    name: str
    letter: str
    width: int | None = None
    decimals: int = 0
    nullable: bool = True

    @property
    def kind(self) -> str:
        return LETTERS[self.letter]

    def spark_type(self) -> T.DataType:
        match self.letter:
            case "C" | "M" | "W" | "O":
                return T.StringType()
            case "N" | "F":
                # a sign and a point take a place each, but never all of them
                return T.DecimalType(min(38, max(1, self.width or 20)), min(self.decimals, 37))
            case "D" | "2":
                return T.DateType()
            case "L":
                return T.BooleanType()
            case "I" | "R":
                return T.IntegerType()
            case "Q":
                return T.ShortType()
            case "P" | "1":
                return T.LongType()
            case "6":
                return T.DecimalType(20, 0)
            case "B":
                return T.DoubleType()
            case "H":
                return T.FloatType()
            case "Y":
                return T.DecimalType(19, 4)
            case "T" | "7" | "4" | "5":
                return T.TimestampNTZType()
            case _:
                return T.BinaryType()

    def metadata(self) -> dict:
        return {"xtype": self.letter, "width": self.width, "dec": self.decimals}


def field_of(column: T.StructField) -> FieldInfo:
    """A Spark column as a field; metadata of our sources wins over the type."""
    told = column.metadata or {}
    if "xtype" in told:
        return FieldInfo(column.name, told["xtype"], told.get("width"), told.get("dec") or 0, column.nullable)
    kind = column.dataType
    match kind:
        case T.StringType():
            return FieldInfo(column.name, "C", told.get("width"), 0, column.nullable)
        case T.DateType():
            return FieldInfo(column.name, "D", 8, 0, column.nullable)
        case T.TimestampType() | T.TimestampNTZType():
            return FieldInfo(column.name, "T", 8, 0, column.nullable)
        case T.BooleanType():
            return FieldInfo(column.name, "L", 1, 0, column.nullable)
        case T.FloatType():
            return FieldInfo(column.name, "H", 4, 0, column.nullable)
        case T.DecimalType():
            return FieldInfo(column.name, "N", kind.precision, kind.scale, column.nullable)
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return FieldInfo(column.name, "I", 4, 0, column.nullable)
        case T.LongType():
            return FieldInfo(column.name, "1", 8, 0, column.nullable)
        case T.DoubleType():
            return FieldInfo(column.name, "B", 8, 0, column.nullable)
        case _:
            return FieldInfo(column.name, "X", None, 0, column.nullable)


def blank(kind: str, dtype: T.DataType) -> Column:
    """What a blank record holds: spaces (trimmed to the empty text), zero, false; dates have no blank but null."""
    if kind in (STR, MEMO):
        return F.lit("").cast(dtype)
    if kind in (NUM, FLT, CUR):
        return F.lit(0).cast(dtype)
    if kind == LOG:
        return F.lit(False)
    if kind == BIN and isinstance(dtype, T.BinaryType):
        return F.lit(b"")
    return F.lit(None).cast(dtype)
