"""Compiling expressions to Spark columns.

Every compiled node is a column with its kind of value, its width where it is known, and whether it is the
result of a trimming function (whose width then is that of the row's value).

Rules that differ from SQL:

* Text comparisons use the shorter width; of two texts that agree so far the wider one is greater.  A field whose width
  isn't declared counts as wider than any literal, and two such fields are compared whole, without trailing blanks.
* Arithmetic on null gives null; a comparison with exactly one null is false (``<>`` true), two nulls are equal.
* x / 0 is 0.  A blank date stays blank in date arithmetic.

``where`` compiles for a filter: null counts as false there, so plain comparisons suffice and reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError
from ..functions import kernels as K
from ..types import CUR, DATE, FLT, LOG, MEMO, NUM, STR, TIME
from .syntax import Binary, Call, Literal, Name, Not, parse


@dataclass(frozen=True)
class Typed:
    """A compiled expression."""

    column: Column
    kind: str
    width: int | None = None
    decimals: int = 0
    trimmed: bool = False
    literal: object = None
    plain: Column | None = None  # an integral field before its cast to double

    @property
    def is_text(self) -> bool:
        return self.kind in (STR, MEMO)

    def padded(self) -> Column:
        """The value at its full width."""
        return self.column if self.width is None or self.trimmed else F.rpad(self.column, self.width, " ")


@dataclass(frozen=True)
class Settings:
    """Session settings that expressions depend on."""

    date_picture: str = "MM/DD/YY"
    collation: str = "machine"


#: Spark's names of the collations of tags.
COLLATIONS = {"machine": None, "general": "UNICODE_CI_AI", "croatian": "hr_CI_AI", "spanish": "es_CI_AI"}



def directed(column: Column, down: bool) -> Column:
    """An ordering column; null is the least value."""
    return column.desc_nulls_last() if down else column.asc_nulls_first()


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def field_value(column: Column, kind: str, dtype: T.DataType, width: int | None, decimals: int) -> Typed:
    """A stored field as expressions see it: numbers as double, currency and float as they are."""
    if kind == NUM:
        integral = isinstance(dtype, INTEGRAL) or isinstance(dtype, T.DecimalType) and dtype.scale == 0
        return Typed(column.cast("double"), NUM, width, decimals, plain=column if integral or isinstance(dtype, T.DoubleType) else None)
    return Typed(column, kind, width, decimals)


class Compiler:
    """resolve(name, alias) gives the Typed value of a field or raises; calcs and totals are named expressions."""

    def __init__(self, resolve: Callable[[str, str | None], Typed], settings: Settings | None = None, calcs: dict | None = None, totals: dict[str, Column] | None = None, record: dict[str, Column] | None = None):
        self.resolve, self.settings = resolve, settings or Settings()
        self.calcs = {k.upper(): v for k, v in (calcs or {}).items()}
        self.totals = {k.upper(): v for k, v in (totals or {}).items()}
        self.record = record or {}
        self._open: list[str] = []

    # Entry points.

    def compile(self, text) -> Typed:
        return self._node(parse(text) if isinstance(text, str) else text)

    def where(self, text) -> Column:
        """A filter's column: true where the logical expression is, false or null elsewhere."""
        tree = parse(text) if isinstance(text, str) else text
        return self._true(tree)

    def sort_parts(self, text) -> list[tuple[Column, bool]]:
        """(column, descending) of a sort or key expression; concatenated keys of fixed width stay separate columns."""
        tree = parse(text) if isinstance(text, str) else text
        keys = []
        for part in self._concatenated(tree):
            down = isinstance(part, Call) and part.function == "DESCEND" and len(part.arguments) == 1
            directed = down or isinstance(part, Call) and part.function == "ASCEND" and len(part.arguments) == 1
            value = self._node(part.arguments[0] if directed else part)
            column = value.plain if value.plain is not None else value.column
            if value.is_text and COLLATIONS.get(self.settings.collation):
                column = F.collate(column, COLLATIONS[self.settings.collation])
            keys.append((column, down))
        return keys

    def sort_keys(self, text) -> list[Column]:
        return [directed(c, down) for c, down in self.sort_parts(text)]

    def _concatenated(self, tree) -> list:
        """Parts of a text concatenation, sorted one by one; possible where all are of fixed width."""
        if isinstance(tree, Binary) and tree.operator == "+":
            parts = self._concatenated(tree.left) + self._concatenated(tree.right)
            if all(self._fixed(p) for p in parts):
                return parts
        return [tree]

    def _fixed(self, tree) -> bool:
        if isinstance(tree, Call) and tree.function in ("DESCEND", "ASCEND"):
            return True
        value = self._node(tree)
        return value.is_text and not value.trimmed and (isinstance(tree, Name) or value.width is not None)

    # Filters.

    def _true(self, tree) -> Column:
        match tree:
            case Binary(".AND.", a, b):
                return self._true(a) & self._true(b)
            case Binary(".OR.", a, b):
                return self._true(a) | self._true(b)
            case Not(a):
                return ~self._log(a)
            case Binary(op, a, b) if op in K.COMPARISONS:
                return self._compare(op, self._node(a), self._node(b), loose=True)
        value = self._node(tree)
        if value.kind != LOG:
            raise ExpressionError("not logical", "a filter must be a logical expression")
        return value.column

    def _log(self, tree) -> Column:
        value = self._node(tree)
        if value.kind != LOG:
            raise ExpressionError("type", "a logical value is needed")
        return F.coalesce(value.column, F.lit(False))

    # Nodes.

    def _node(self, tree) -> Typed:
        match tree:
            case Literal(bool() as v):
                return Typed(F.lit(v), LOG, 1, literal=v)
            case Literal(float() as v):
                return Typed(F.lit(v), NUM, None, literal=v)
            case Literal(str() as v):
                return Typed(F.lit(v), STR, len(v), literal=v)
            case Name(field=name, alias=alias):
                if alias is None and name.upper() in self.totals:
                    return Typed(self.totals[name.upper()].cast("double"), NUM)
                if alias is None and name.upper() in self.calcs:
                    return self._calc(name.upper())
                return self.resolve(name, alias)
            case Not(a):
                return Typed(~self._log(a), LOG, 1)
            case Binary(".AND.", a, b):
                return Typed(self._log(a) & self._log(b), LOG, 1)
            case Binary(".OR.", a, b):
                return Typed(self._log(a) | self._log(b), LOG, 1)
            case Binary(op, a, b) if op in K.COMPARISONS:
                return Typed(self._compare(op, self._node(a), self._node(b)), LOG, 1)
            case Binary("$", a, b):
                return self._contains(self._node(a), self._node(b))
            case Binary(op, a, b):
                return self._arithmetic(op, self._node(a), self._node(b))
            case Call(function=name, arguments=arguments):
                return self._call(name, arguments)
        raise ExpressionError("syntax", f"can't compile {tree!r}")

    def _calc(self, name: str) -> Typed:
        if name in self._open:
            raise ExpressionError("recursion", f"{name} refers to itself")
        self._open.append(name)
        try:
            return self._node(parse(self.calcs[name]))
        finally:
            self._open.pop()

    def _compare(self, op: str, a: Typed, b: Typed, loose: bool = False) -> Column:
        """loose: null may stand for false."""
        if a.is_text and b.is_text:
            return K.compare_texts(op, a, b, loose)
        if a.is_text or b.is_text or (a.kind != b.kind and not {a.kind, b.kind} <= {NUM, FLT, CUR, DATE}):
            raise ExpressionError("type", f"can't compare {a.kind} and {b.kind}")
        if a.kind == b.kind and a.kind in (CUR, DATE, TIME, LOG):
            x, y = a.column, b.column
        elif b.literal is not None and a.plain is not None and float(b.literal).is_integer():
            x, y = a.plain, F.lit(int(b.literal))
        elif a.literal is not None and b.plain is not None and float(a.literal).is_integer():
            x, y = F.lit(int(a.literal)), b.plain
        else:
            x, y = self._number(a), self._number(b)
        constant = a.literal is not None or b.literal is not None
        return K.compare(op, x, y, loose and constant)

    def _number(self, a: Typed) -> Column:
        if a.kind == DATE:
            return K.julian(a.column)
        if a.kind in (NUM, FLT, CUR):
            return a.column.cast("double")
        raise ExpressionError("type", f"{a.kind} isn't a number")

    def _contains(self, a: Typed, b: Typed) -> Typed:
        if not (a.is_text and b.is_text):
            raise ExpressionError("type", "$ needs two texts")
        return Typed(F.instr(b.padded(), a.padded()) > 0 if a.literal is None else F.contains(b.padded(), F.lit(a.literal)), LOG, 1)

    def _arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        if a.is_text and b.is_text and op in "+-":
            known = a.width is not None and b.width is not None
            width = a.width + b.width if known else None
            if op == "-" or a.trimmed:
                joined = F.concat(F.rtrim(a.column), b.padded())
                if known:
                    joined = F.rpad(joined, width, " ")
                elif op == "-":
                    # the left one's trailing blanks move to the end
                    joined = F.concat(joined, F.repeat(F.lit(" "), (F.length(a.column) - F.length(F.rtrim(a.column))).cast("int")))
                return Typed(joined, STR, width)
            return Typed(F.concat(a.padded(), b.padded()), STR, width, trimmed=b.trimmed)
        if a.kind == DATE and b.kind in (NUM, FLT) and op in "+-":
            days = F.floor(b.column).cast("int") if b.literal is None else F.lit(int(b.literal))
            return Typed(F.date_add(a.column, days) if op == "+" else F.date_sub(a.column, days), DATE, 8)
        if a.kind == NUM and b.kind == DATE and op == "+":
            return self._arithmetic(op, b, a)
        if a.kind == DATE and b.kind == DATE and op == "-":
            return Typed(F.datediff(a.column, b.column).cast("double"), NUM)
        if not {a.kind, b.kind} <= {NUM, FLT, CUR}:
            raise ExpressionError("type", f"can't compute {a.kind} {op} {b.kind}")
        kind = FLT if a.kind == b.kind == FLT and op != "^" else NUM
        x, y = (v.column if kind == FLT else v.column.cast("double") for v in (a, b))
        result = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: K.divide(x, y), "^": lambda: F.pow(x, y)}[op]()
        return Typed(result.cast("float") if kind == FLT else result, kind)

    def _call(self, name: str, arguments: tuple) -> Typed:
        if name in self.calcs and not arguments:
            return self._calc(name)
        if name in self.totals and not arguments:
            return Typed(self.totals[name].cast("double"), NUM)
        found = next((f for full, f in K.FUNCTIONS.items() if full[:8] == name[:8]), None)
        if found is None:
            raise ExpressionError("unknown function", name)
        return found(self, Typed, [self._node(x) for x in arguments])


__all__ = ["COLLATIONS", "Compiler", "Settings", "Typed", "directed", "field_value"]
