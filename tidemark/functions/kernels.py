"""Scalar functions and operators, as columns.

A function gets the compiler, the class of compiled values and its compiled arguments.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExpressionError
from ..types import BIN, CUR, DATE, FLT, LOG, MEMO, NUM, STR, TIME

COMPARISONS = ("=", "<>", ">", "<", ">=", "<=")
#: Julian day number of 1970-01-01.
JULIAN_EPOCH = 2440588


# Operators.


def compare(op: str, x: Column, y: Column, loose: bool) -> Column:
    """loose: one side is a constant and null may stand for false."""
    if loose and op != "<>":
        return {"=": x == y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]
    none = x.isNull() & y.isNull()
    match op:
        case "=":
            return x.eqNullSafe(y)
        case "<>":
            return ~x.eqNullSafe(y)
        case ">":
            return F.coalesce(x > y, F.lit(False))
        case "<":
            return F.coalesce(x < y, F.lit(False))
        case ">=":
            return F.coalesce(x >= y, none)
    return F.coalesce(x <= y, none)


def compare_texts(op: str, a, b, loose: bool) -> Column:
    """Over the shorter width; if that is equal the wider one is greater. See the compiler's text."""
    if a.literal is not None and b.literal is None:
        return compare_texts({">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(op, op), b, a, loose)
    if b.literal is not None and not a.trimmed and (a.width is None or a.width >= len(b.literal)):
        n, wider = len(b.literal), a.width is None or a.width > len(b.literal)
        whole = b.literal != b.literal.rstrip(" ")
        if op in ("=", "<>") and n and not whole:
            same = a.column.startswith(b.literal)  # reaches the scan
            return same if loose and op == "=" else F.coalesce(same, F.lit(False)) if op == "=" else ~F.coalesce(same, F.lit(False))
        x, y = F.substring(F.rpad(a.column, n, " "), 1, n), F.lit(b.literal)
        equal, greater = x == y, x > y
        if wider:
            greater = greater | equal  # of an equal beginning the wider one is greater
        return _ordered(op, a.column, b.column, equal, greater, loose)
    if a.width is None or b.width is None or a.trimmed or b.trimmed:
        x, y = F.rtrim(a.column), F.rtrim(b.column)
        if a.trimmed or b.trimmed:
            n = F.least(F.length(x) if a.trimmed else F.lit(a.width or 1 << 20), F.length(y) if b.trimmed else F.lit(b.width or 1 << 20))
            p, q = (F.substring(F.rpad(v, n, " "), F.lit(1), n) for v in (x, y))
            longer = (F.length(x) if a.trimmed else F.lit(a.width or 1 << 20)) > (F.length(y) if b.trimmed else F.lit(b.width or 1 << 20))
            return _ordered(op, a.column, b.column, p == q, (p > q) | ((p == q) & longer), loose)
        return _ordered(op, a.column, b.column, x == y, x > y, loose)
    n = min(a.width, b.width)
    x, y = (F.substring(F.rpad(v.column, v.width, " "), 1, n) for v in (a, b))
    greater = x > y
    if a.width > b.width:
        greater = greater | (x == y)
    return _ordered(op, a.column, b.column, x == y, greater, loose, below=(x < y) | (x == y) if a.width < b.width else None)


def _ordered(op: str, a: Column, b: Column, equal: Column, greater: Column, loose: bool, below: Column | None = None) -> Column:
    """A comparison out of equality and greater (below: not greater and not equal, unless it is given), with its nulls."""
    less = (~greater & ~equal) if below is None else below
    result = {"=": equal, "<>": ~equal, ">": greater, "<": less, ">=": ~less, "<=": ~greater}[op]
    if loose and op != "<>":
        return result
    both = a.isNull() & b.isNull()
    return F.coalesce(result, both if op in ("=", ">=", "<=") else ~both if op == "<>" else F.lit(False))


def divide(x: Column, y: Column) -> Column:
    """x / 0 is 0; null stays null."""
    return F.when(y == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(x, y))


def julian(d: Column) -> Column:
    """A date's Julian day number, as a double."""
    return (F.unix_date(d) + JULIAN_EPOCH).cast("double")


# Helpers of functions.


def _constant(v, what: str):
    if v.literal is None:
        raise ExpressionError("not constant", f"{what} must be a constant")
    return v.literal


def _whole(v, what: str) -> int:
    return int(_constant(v, what))


def _need(args: list, least: int, most: int, name: str) -> None:
    if not least <= len(args) <= most:
        raise ExpressionError("arguments", f"{name} takes {least} to {most} arguments")


def _text(v):
    if v.kind not in (STR, MEMO):
        raise ExpressionError("type", "a text is needed")
    return v


def fixed(x: Column, decimals: int) -> Column:
    """A number with so many decimals, rounded half up, as text."""
    return F.round(x, decimals).cast(f"decimal(38,{decimals})").cast("string")


FUNCTIONS: dict = {}


def _function(name: str):
    def put(f):
        FUNCTIONS[name] = f
        return f

    return put


# Text.


@_function("CHR")
def _chr(c, t, args):
    _need(args, 1, 1, "CHR")
    return t(F.chr(args[0].column.cast("long")), STR, 1)


@_function("STR")
def _str(c, t, args):
    _need(args, 1, 3, "STR")
    width = _whole(args[1], "a width") if len(args) > 1 else 10
    decimals = _whole(args[2], "a number of decimals") if len(args) > 2 else 0
    shown = fixed(c._number(args[0]), decimals)
    return t(F.when(F.length(shown) > width, "*" * width).otherwise(F.lpad(shown, width, " ")), STR, width)


@_function("STRZERO")
def _strzero(c, t, args):
    value = _str(c, t, args)
    blanks = F.length(value.column) - F.length(F.ltrim(value.column))
    zeros = F.repeat(F.lit("0"), blanks.cast("int"))
    body = F.ltrim(value.column)
    # a sign stays in front of the zeros
    return replace(value, column=F.when(body.startswith("-") & (blanks > 0), F.concat(F.lit("-"), zeros, F.substring(body, 2, 64))).otherwise(F.concat(zeros, body)))


@_function("SUBSTR")
def _substr(c, t, args):
    _need(args, 2, 3, "SUBSTR")
    s, start = _text(args[0]), max(1, _whole(args[1], "a start"))
    room = None if s.width is None else max(0, s.width - start + 1)
    length = _whole(args[2], "a length") if len(args) > 2 else room
    if room is not None and length is not None:
        length = max(0, min(length, room))
    return t(F.substring(s.padded(), start, length if length is not None else 1 << 30), STR, length)


@_function("LEFT")
def _left(c, t, args):
    _need(args, 2, 2, "LEFT")
    n = max(0, _whole(args[1], "a length"))
    n = n if args[0].width is None else min(n, args[0].width)
    return t(F.substring(_text(args[0]).padded(), 1, n), STR, n)


@_function("RIGHT")
def _right(c, t, args):
    _need(args, 2, 2, "RIGHT")
    s, n = _text(args[0]), max(0, _whole(args[1], "a length"))
    return t(F.right(s.padded(), F.lit(n)), STR, n if s.width is None else min(n, s.width))


@_function("UPPER")
def _upper(c, t, args):
    _need(args, 1, 1, "UPPER")
    return replace(_text(args[0]), column=F.upper(args[0].column), literal=None, plain=None)


@_function("SPACE")
def _space(c, t, args):
    n = _whole(args[0], "a width")
    return t(F.lit(" " * n), STR, n, literal=" " * n)


def _trimming(name: str, function) -> None:
    def f(c, t, args):
        _need(args, 1, 1, name)
        return t(function(_text(args[0]).column), STR, args[0].width, trimmed=True)

    FUNCTIONS[name] = f


_trimming("TRIM", F.rtrim)
_trimming("ALLTRIM", F.trim)


@_function("LTRIM")
def _ltrim(c, t, args):
    _need(args, 1, 1, "LTRIM")
    s = _text(args[0])
    return t(F.ltrim(s.padded()), STR, s.width, trimmed=True)


@_function("PADL")
def _padl(c, t, args):
    n = _whole(args[1], "a width")
    return t(F.lpad(_text(args[0]).padded(), n, " "), STR, n)


@_function("PADR")
def _padr(c, t, args):
    n = _whole(args[1], "a width")
    return t(F.rpad(_text(args[0]).padded(), n, " "), STR, n)


@_function("VAL")
def _val(c, t, args):
    number = F.regexp_extract(_text(args[0]).column, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1)
    return t(F.when(args[0].column.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(0.0))), NUM)


@_function("L2BIN")
def _l2bin(c, t, args):
    n = F.pmod(F.floor(c._number(args[0])).cast("long"), F.lit(1 << 32))
    byte = lambda k: F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))
    return t(F.unhex(F.concat(*(F.lpad(F.hex(byte(k)), 2, "0") for k in range(4)))), BIN, 4)


@_function("KEYEQUAL")
def _keyequal(c, t, args):
    _need(args, 2, 2, "KEYEQUAL")
    from ..plans.compiler import COLLATIONS

    name = COLLATIONS.get(c.settings.collation)
    a, b = (F.rtrim(_text(v).column) for v in args)
    if name:
        a, b = F.collate(a, name), F.collate(b, name)
    return t(a.eqNullSafe(b), LOG, 1)


def sort_text(v, down: bool) -> Column:
    """A text whose order is the value's, or the reverse: for projecting keys. Numbers up to 15 digits before the point."""
    if v.kind in (NUM, FLT, CUR):
        n = v.column.cast("decimal(38,6)")
        top = F.lit("1000000000000000").cast("decimal(38,6)")
        return F.lpad((top - n if down else top + n).cast("string"), 23, "0")
    if v.kind == DATE:
        days = F.unix_date(v.column) + JULIAN_EPOCH
        return F.lpad((F.lit(9999999) - days if down else days).cast("string"), 7, "0")
    if v.kind == TIME:
        seconds = F.unix_micros(v.column.cast("timestamp"))
        return F.lpad((F.lit(10**18) - seconds if down else F.lit(10**17) + seconds).cast("string"), 19, "0")
    if v.kind == LOG:
        return F.when(v.column != down, "1").otherwise("0")
    if v.kind in (STR, MEMO):
        printable = "".join(map(chr, range(32, 127)))
        return F.translate(v.padded(), printable, printable[::-1]) if down else v.padded()
    raise ExpressionError("type", f"{v.kind} has no key")


@_function("ASCEND")
def _ascend(c, t, args):
    _need(args, 1, 1, "ASCEND")
    return replace(args[0], literal=None) if args[0].kind in (STR, MEMO) else t(sort_text(args[0], False), STR, None)


@_function("DESCEND")
def _descend(c, t, args):
    _need(args, 1, 1, "DESCEND")
    return t(args[0].column if args[0].kind == BIN else sort_text(args[0], True), STR, args[0].width)


# Dates and times.


@_function("TIME")
def _time(c, t, args):
    return t(F.date_format(F.current_timestamp(), "HH:mm:ss"), STR, 8)


@_function("DATE")
def _date(c, t, args):
    return t(F.current_date(), DATE, 8)


@_function("DTOS")
def _dtos(c, t, args):
    return t(F.coalesce(F.date_format(_day(args[0]), "yyyyMMdd"), F.lit(" " * 8)), STR, 8)


def _day(v) -> Column:
    if v.kind == DATE:
        return v.column
    if v.kind in (NUM, FLT):  # a Julian day number
        return F.date_from_unix_date(F.floor(v.column).cast("int") - JULIAN_EPOCH)
    raise ExpressionError("type", "a date is needed")


def spark_picture(picture: str) -> str:
    """MM/DD/YY and the like as Spark's pattern."""
    return picture.upper().replace("DD", "dd").replace("CCYY", "yyyy").replace("YYYY", "yyyy").replace("YY", "yy")


@_function("DTOC")
def _dtoc(c, t, args):
    _need(args, 1, 2, "DTOC")
    if len(args) == 2:
        return _dtos(c, t, args[:1])
    picture = c.settings.date_picture
    return t(F.coalesce(F.date_format(_day(args[0]), spark_picture(picture)), F.lit(" " * len(picture))), STR, len(picture))


@_function("TTOC")
def _ttoc(c, t, args):
    _need(args, 1, 2, "TTOC")
    if args[0].kind not in (TIME, DATE):
        raise ExpressionError("type", "a datetime is needed")
    return t(F.coalesce(F.date_format(args[0].column, "yyyyMMddHHmmss"), F.lit(" " * 14)), STR, 14)


@_function("DATETIME")
def _datetime(c, t, args):
    _need(args, 3, 7, "DATETIME")
    parts = [_constant(a, "a part of a datetime") for a in args] + [0.0] * (7 - len(args))
    made = F.make_timestamp_ntz(*(F.lit(int(p)) for p in parts[:5]), F.lit(parts[5] + parts[6] / 1000).cast("decimal(16,6)"))
    return t(made, TIME, 8)


@_function("STOD")
def _stod(c, t, args):
    s = _text(args[0]).column
    return t(F.try_to_date(F.when(s.rlike(r"^\d{8}"), F.substring(s, 1, 8)), "yyyyMMdd"), DATE, 8)


@_function("CTOD")
def _ctod(c, t, args):
    pattern = spark_picture(c.settings.date_picture)
    return t(F.try_to_date(F.trim(_text(args[0]).column), pattern), DATE, 8)


def _part(name: str, function) -> None:
    def f(c, t, args):
        _need(args, 1, 1, name)
        day = args[0].column if args[0].kind == TIME else _day(args[0])
        return t(F.coalesce(function(day), F.lit(0)).cast("double"), NUM)

    FUNCTIONS[name] = f


_part("DAY", F.dayofmonth)
_part("MONTH", F.month)
_part("YEAR", F.year)


# Conditions and the record.


@_function("IIF")
def _iif(c, t, args):
    _need(args, 3, 3, "IIF")
    test, a, b = args
    if test.kind != LOG:
        raise ExpressionError("type", "IIF needs a logical value first")
    if a.kind in (STR, MEMO) and b.kind in (STR, MEMO):
        width = max(a.width, b.width) if a.width is not None and b.width is not None else None
        pad = lambda v: v.column if width is None else F.rpad(v.column, width, " ")
        return t(F.when(test.column, pad(a)).otherwise(pad(b)), STR, width)
    if a.kind != b.kind:
        raise ExpressionError("type", "IIF needs two values of one type")
    return t(F.when(test.column, a.column).otherwise(b.column), a.kind, a.width)


@_function("EMPTY")
def _empty(c, t, args):
    _need(args, 1, 1, "EMPTY")
    v = args[0]
    if v.kind == STR:
        return t(F.coalesce(F.trim(v.column), F.lit("")) == "", LOG, 1)
    if v.kind == MEMO:
        return t(F.coalesce(F.length(v.column), F.lit(0)) == 0, LOG, 1)
    if v.kind in (NUM, FLT, CUR):
        return t(F.coalesce(v.column == 0, F.lit(True)), LOG, 1)
    if v.kind == LOG:
        return t(~F.coalesce(v.column, F.lit(False)), LOG, 1)
    return t(v.column.isNull(), LOG, 1)


def _of_record(name: str, key: str, kind: str, make) -> None:
    def f(c, t, args):
        _need(args, 0, 0, name)
        if key not in c.record:
            raise ExpressionError("no record", f"{name} needs a table")
        return t(make(c.record[key]), kind, 1 if kind != NUM else None)

    FUNCTIONS[name] = f


_of_record("DEL", "deleted", STR, lambda x: F.when(x, "*").otherwise(" "))
_of_record("DELETED", "deleted", LOG, lambda x: x)
_of_record("RECNO", "recno", NUM, lambda x: x.cast("double"))
_of_record("RECCOUNT", "count", NUM, lambda x: x.cast("double"))


@_function("PAGENO")
def _pageno(c, t, args):
    """Pages are a matter of layout, which is out of scope: always the first."""
    return t(F.lit(1.0), NUM)
