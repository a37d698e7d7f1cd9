"""Reading and writing DBF tables with their memo files, as a Spark data source named "dbf".

    spark.dataSource.register(DbfSource)
    spark.read.format("dbf").option("encoding", "cp1252").load("/data/people.dbf")
    df.write.format("dbf").mode("append").save("/data/out")

Options: path (a file or a directory of files of one structure), encoding (else the code page mark of the
file), rows_per_partition.  Records are split by number, so one large file is read by many tasks; deleted
records are kept and marked.  The columns are the fields, _recno and _deleted.

Blank dates, numbers and datetimes are null; blank text is the empty text, since trailing blanks are not kept.  A
memo is read from the .fpt or .dbt file beside the table.

Records are decoded a column at a time: a block of records is a matrix of bytes, whose columns Arrow and NumPy convert as a
whole; only values that these can't convert (text outside of ASCII, malformed numbers and dates, memos, rare types) are decoded one by one, with
the same result.

Writing makes one table a task.  An attempt of a task writes to files of its own, whose names no reader takes for tables; the committed ones get
their names at the end, the others are removed, so repeated and speculative tasks do no harm.  Fields are those of the schema's metadata, or follow from the column types; a value that doesn't
fit its field is an error.  _recno isn't stored; records are written in the order of the rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import EngineError
from ..types import FieldInfo, field_of

# Code page marks.
CODE_PAGES = {
    0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x08: "cp865", 0x09: "cp437", 0x0A: "cp850", 0x13: "cp932", 0x4D: "cp936", 0x4E: "cp949", 0x4F: "cp950", 0x57: "cp1252",
    0x64: "cp852", 0x65: "cp866", 0x66: "cp865", 0x67: "cp861", 0x6A: "cp737", 0x6B: "cp857", 0x78: "cp950", 0x79: "cp949", 0x7A: "cp936", 0x7B: "cp932", 0x7C: "cp874",
    0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253",
}
# Version bytes of tables whose memos are in blocks of 512 bytes ended by 0x1A.
OLD_MEMO = (0x83,)
JULIAN_ORDINAL = 1721425  # Julian day of the ordinal 0 of Python's dates
OLE_EPOCH = dt.datetime(1899, 12, 30)


def open_file(path: str):
    """A file of any file system that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        filesystem, name = arrow_fs.FileSystem.from_uri(path)
    else:
        filesystem, name = arrow_fs.LocalFileSystem(), path
    return filesystem, name


@dataclass(frozen=True)
class Slot:
    """A field and its place in the record."""

    info: FieldInfo
    start: int
    length: int
    null_bit: int | None
    system: bool = False
    length_bit: int | None = None


@dataclass(frozen=True)
class Header:
    version: int
    records: int
    start: int
    width: int
    code_page: int
    slots: tuple[Slot, ...]

    @property
    def fields(self) -> list[Slot]:
        return [s for s in self.slots if not s.system]

    def schema(self) -> T.StructType:
        fields = [T.StructField(s.info.name, s.info.spark_type(), s.info.nullable or s.info.letter in "DTN7FMXG", s.info.metadata()) for s in self.fields]
        return T.StructType([*fields, T.StructField("_recno", T.LongType()), T.StructField("_deleted", T.BooleanType())])


def read_header(data: bytes) -> Header:
    """The header of a table out of its first bytes."""
    if len(data) < 32:
        raise EngineError("not a table", "the file is too short")
    version, records, start, width = data[0], *struct.unpack_from("<IHH", data, 4)
    slots, at, place, bit = [], 32, 1, 0
    while at + 32 <= min(start, len(data)) and data[at] != 0x0D:
        raw = data[at : at + 32]
        letter, length, decimals, flags = chr(raw[11]), raw[16], raw[17], raw[18]
        if letter == "C":  # wide text fields use the decimals as the high byte of the width
            length, decimals = length + 256 * decimals, 0
        name = raw[:11].split(b"\0")[0].decode("ascii", "replace")
        nullable, system = bool(flags & 2), letter == "0" or bool(flags & 1)
        slots.append(Slot(FieldInfo(name, letter, length, decimals, nullable), place, length, bit if nullable else None, system))
        bit += nullable
        place += length
        at += 32
    return Header(version, records, start, width, data[29], tuple(slots))


class Memo:
    """A memo file."""

    def __init__(self, path: str, old: bool):
        filesystem, name = open_file(path)
        self.file, self.old = filesystem.open_input_file(name), old
        self.block = 512 if old else struct.unpack(">H", self.file.read_at(2, 6))[0] or 1

    def get(self, number: int) -> bytes:
        if number <= 0:
            return b""
        at = number * self.block
        if self.old:
            out = b""
            while True:
                part = self.file.read_at(self.block, at)
                end = part.find(b"\x1a")
                if end >= 0 or not part:
                    return out + part[: max(end, 0)]
                out, at = out + part, at + self.block
        head = self.file.read_at(8, at)
        if len(head) < 8:
            return b""
        return self.file.read_at(struct.unpack(">I", head[4:])[0], at + 8)


def _julian(days: int) -> dt.date | None:
    ordinal = days - JULIAN_ORDINAL
    return dt.date.fromordinal(ordinal) if 1 <= ordinal <= dt.date.max.toordinal() else None


def _moment(raw: bytes, keep_ms: bool) -> dt.datetime | None:
    day, ms = struct.unpack("<ii", raw)
    date = _julian(day)
    if date is None:
        return None
    whole = dt.datetime.combine(date, dt.time()) + dt.timedelta(milliseconds=ms)
    # stored milliseconds may be a little short of a second
    return whole if keep_ms else (whole + dt.timedelta(milliseconds=500)).replace(microsecond=0)


def decode(slot: Slot, raw: bytes, encoding: str, memo: Memo | None):
    """The value of a field's bytes; None where it is blank and its type has a null for that."""
    letter = slot.info.letter
    match letter:
        case "C":
            return raw.decode(encoding, "replace").rstrip(" ")
        case "N" | "F":
            text = raw.strip(b" \0")
            if not text:
                return None
            try:
                return decimal.Decimal(text.decode("ascii")).quantize(decimal.Decimal(1).scaleb(-slot.info.decimals))
            except (decimal.InvalidOperation, UnicodeDecodeError):
                return None
        case "D":
            text = raw.decode("ascii", "replace")
            try:
                return dt.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
            except ValueError:
                return None
        case "L":
            return raw in (b"Y", b"y", b"T", b"t")
        case "I":
            return struct.unpack("<i", raw)[0]
        case "B":
            return struct.unpack("<d", raw)[0]
        case "H":
            return struct.unpack("<f", raw)[0]
        case "Y":
            return decimal.Decimal(struct.unpack("<q", raw)[0]).scaleb(-4)
        case "T" | "7":
            return _moment(raw, letter == "7")
        case "M" | "X" | "G":
            number = struct.unpack("<i", raw)[0] if len(raw) == 4 else int(raw.strip(b" \0") or b"0")
            data = memo.get(number) if memo else b""
            return data.decode(encoding, "replace") if letter == "M" else data
        case "W" | "O":
            return raw.decode("utf-16-le", "replace").rstrip("\0 ")
        case "P" | "Q" | "R" | "1":
            return struct.unpack({"P": "<I", "Q": "<h", "R": "<H", "1": "<q"}[letter], raw)[0]
        case "6":
            return decimal.Decimal(struct.unpack("<Q", raw)[0])
        case "2":
            year, month, day = struct.unpack("<hHH", raw)
            return dt.date(year, month, day) if 1 <= month <= 12 and 1 <= day <= 31 and year > 0 else None
        case "4":
            year, month, day, hour, minute, second, fraction = struct.unpack("<hHHHHHI", raw)
            return dt.datetime(year, month, day, hour, minute, second, fraction // 1000) if year > 0 and month else None
        case "5":
            days = struct.unpack("<d", raw)[0]
            return OLE_EPOCH + dt.timedelta(days=days)
    return raw


def _decimals(values: np.ndarray, kind: pa.DataType, nulls: np.ndarray | None = None) -> pa.Array:
    """Integers as decimals of their last digits: the 128-bit values are the integers with their signs extended."""
    wide = np.stack([values.astype("<i8"), values.astype("<i8") >> 63], axis=1)
    made = pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(wide.tobytes())])
    return made if nulls is None else pc.if_else(pa.array(nulls), pa.scalar(None, kind), made)


def _ascii(cells: np.ndarray) -> pa.Array | None:
    """The cells of a column (a row of bytes each) as text, if all of it is ASCII."""
    if cells.size and cells.max() >= 128:
        return None
    size = cells.shape[1]
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(cells), [None, pa.py_buffer(np.ascontiguousarray(cells).tobytes())])
    return raw.cast(pa.binary()).cast(pa.string())


NUMBERS = {"I": "<i4", "B": "<f8", "H": "<f4", "P": "<u4", "Q": "<i2", "R": "<u2", "1": "<i8"}
#: Days of the Unix epoch and of the least and greatest date, as Julian days.
EPOCH, FIRST_DAY, LAST_DAY = 2440588, JULIAN_ORDINAL + 1, JULIAN_ORDINAL + dt.date.max.toordinal()


def decode_column(slot: Slot, cells: np.ndarray, kind: pa.DataType, encoding: str, memo: Memo | None) -> pa.Array:
    """A column of a block of records; cells holds a row of bytes a record. Equal to decode() of each cell."""
    letter = slot.info.letter
    if letter in NUMBERS and slot.length == np.dtype(NUMBERS[letter]).itemsize:
        values = np.ascontiguousarray(cells).view(NUMBERS[letter])[:, 0]
        return pa.array(values.astype(values.dtype.newbyteorder("="))).cast(kind)
    if letter == "Y":
        return _decimals(np.ascontiguousarray(cells).view("<i8")[:, 0], kind)
    if letter == "L":
        return pa.array(np.isin(cells[:, 0], np.frombuffer(b"YyTt", np.uint8)))
    if letter in "T7" and slot.length == 8:
        day, ms = np.ascontiguousarray(cells).view("<i4").astype(np.int64).T
        micros = (day - EPOCH) * 86_400_000_000 + (ms * 1000 if letter == "7" else (ms + 500) // 1000 * 1_000_000)
        return pc.if_else(pa.array((day < FIRST_DAY) | (day > LAST_DAY)), pa.scalar(None, kind), pa.array(micros).cast(kind))
    text = _ascii(cells) if letter in "CNFD" else None
    if text is not None and letter == "C":
        return pc.utf8_rtrim(text, characters=" ").cast(kind)
    try:
        if text is not None and letter in "NF":
            text = pc.utf8_trim(text, characters=" \0")
            plain = pc.match_substring_regex(text, r"^[+-]?[0-9]+(\.[0-9]+)?$" if slot.info.decimals else r"^[+-]?[0-9]+$")
            if pc.all(pc.or_(plain, pc.equal(text, ""))).as_py() is not False:
                return pc.if_else(pc.equal(text, ""), pa.scalar(None, kind), pc.if_else(pc.equal(text, ""), "0", text).cast(kind))
        if text is not None and letter == "D" and slot.length == 8:
            digits = ((cells >= 48) & (cells <= 57)).all(axis=1)
            if (digits | (cells == 32).all(axis=1)).all():
                day = pc.strptime(pc.if_else(pa.array(digits), text, "00000000"), format="%Y%m%d", unit="s", error_is_null=True).cast(kind)
                again = pc.strftime(day.cast(pa.timestamp("s")), format="%Y%m%d")
                if pc.all(pc.equal(again, text)).as_py() is not False:  # a day that is none, as the 31st of June, is decoded below
                    return day
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass  # such as a number with more decimals than its field
    return pa.array([decode(slot, c.tobytes(), encoding, memo) for c in cells], kind)


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, before: int):
        self.path, self.first, self.last, self.before = path, first, last, before


class DbfReader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str], options: dict):
        self.schema, self.paths = schema, paths
        self.encoding, self.rows = options.get("encoding"), int(options.get("rows_per_partition", 100_000))

    def partitions(self) -> list[InputPartition]:
        found, before = [], 0
        for path in self.paths:
            n = header_of(path).records
            found += [Range(path, i, min(n, i + self.rows), before) for i in range(0, n, self.rows)]
            before += n
        return found or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        if part.last <= part.first:
            return
        head = header_of(part.path)
        encoding = self.encoding or CODE_PAGES.get(head.code_page, "cp1252")
        memo = None
        if any(s.info.letter in "MXG" for s in head.fields):
            memo = Memo(memo_path(part.path), head.version in OLD_MEMO)
        flags = next((s for s in head.slots if s.info.letter == "0"), None)
        filesystem, name = open_file(part.path)
        with filesystem.open_input_file(name) as file:
            for at in range(part.first, part.last, 8192):
                count = min(8192, part.last - at)
                data = file.read_at(count * head.width, head.start + at * head.width)
                cells = np.frombuffer(data, np.uint8)[: len(data) // head.width * head.width].reshape(-1, head.width)
                columns = []
                for s, f in zip(head.fields, schema, strict=False):
                    column = decode_column(s, cells[:, s.start : s.start + s.length], f.type, encoding, memo)
                    if s.null_bit is not None and flags is not None:
                        null = cells[:, flags.start + s.null_bit // 8] & (1 << s.null_bit % 8)
                        column = pc.if_else(pa.array(null > 0), pa.scalar(None, column.type), column)
                    columns.append(column)
                columns.append(pa.array(np.arange(len(cells), dtype=np.int64) + part.before + at + 1))
                columns.append(pa.array(cells[:, 0] == ord("*")))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def header_of(path: str) -> Header:
    filesystem, name = open_file(path)
    with filesystem.open_input_file(name) as file:
        start = struct.unpack("<H", file.read_at(2, 8))[0]
        return read_header(file.read_at(max(start, 32), 0))


def memo_path(path: str) -> str:
    """The memo file beside a table, in either case."""
    filesystem, name = open_file(path)
    stem = name.rpartition(".")[0]
    for ending in ("fpt", "FPT", "dbt", "DBT"):
        if filesystem.get_file_info(f"{stem}.{ending}").type == arrow_fs.FileType.File:
            return path[: len(path) - len(name)] + f"{stem}.{ending}"
    raise EngineError("no memo file", path)


# Writing.

# The field that a column type becomes where its metadata names none, as (letter, width, decimals).
MADE = {T.IntegerType: ("I", 4, 0), T.ShortType: ("I", 4, 0), T.ByteType: ("I", 4, 0), T.LongType: ("N", 20, 0), T.DoubleType: ("B", 8, 2), T.FloatType: ("B", 8, 2), T.BooleanType: ("L", 1, 0), T.DateType: ("D", 8, 0), T.TimestampType: ("T", 8, 0), T.TimestampNTZType: ("T", 8, 0), T.StringType: ("M", 4, 0), T.BinaryType: ("G", 4, 0)}
WIDTHS = {"I": 4, "B": 8, "Y": 8, "T": 8, "D": 8, "L": 1, "M": 4, "G": 4}


def slots_of(schema: T.StructType) -> list[Slot]:
    """The fields that a schema is written as; a bit of the last, hidden field tells nulls."""
    found, place = [], 1
    columns = [c for c in schema if c.name not in ("_recno", "_deleted")]
    for bit, column in enumerate(columns):
        info = field_of(column) if column.metadata else None
        if info is None or info.letter not in "CNF" and info.letter not in WIDTHS or info.letter in "CNF" and not info.width:
            if isinstance(column.dataType, T.DecimalType):
                letter, width, decimals = "N", column.dataType.precision + 2, column.dataType.scale
            else:
                letter, width, decimals = MADE.get(type(column.dataType), ("", 0, 0))
            if not letter:
                raise EngineError("no field type", f"{column.name}: {column.dataType.simpleString()}")
        else:
            letter, width, decimals = info.letter, WIDTHS.get(info.letter, info.width), info.decimals
        if len(column.name.encode()) > 10:
            raise EngineError("field name", f"{column.name} has more than ten characters")
        found.append(Slot(FieldInfo(column.name, letter, width, decimals, True), place, width, bit))
        place += width
    size = -(-len(found) // 8)
    return [*found, Slot(FieldInfo("_NullFlags", "0", size, 0, False), place, size, None, True)]


def table_head(slots: list[Slot], records: int, code_page: int) -> bytes:
    """The bytes before the first record."""
    start = 32 + 32 * len(slots) + 1 + 263
    width = 1 + sum(s.length for s in slots)
    head = struct.pack("<BBBBIHH", 0x30, 0, 1, 1, records, start, width) + bytes(16) + bytes([2 if any(s.info.letter in "MG" for s in slots) else 0, code_page, 0, 0])
    for s in slots:
        low, high = (s.length % 256, s.length // 256) if s.info.letter == "C" else (s.length, s.info.decimals)
        head += s.info.name.encode().ljust(11, b"\0") + s.info.letter.encode() + struct.pack("<I", s.start) + bytes([low, high, (2 if s.info.nullable else 0) | (1 if s.system else 0)]) + bytes(13)
    return head + b"\r" + bytes(263)


def encode(slot: Slot, value, encoding: str, memo) -> bytes:
    """The bytes of a field; memo(data) stores a memo and gives its block."""
    letter, size = slot.info.letter, slot.length
    if value is None:
        return b" " * size if letter in "CNFDL" else bytes(size)
    match letter:
        case "C":
            raw = value.encode(encoding).ljust(size)
        case "N" | "F":
            number = decimal.Decimal(repr(value) if isinstance(value, float) else value)
            raw = f"{number:.{slot.info.decimals}f}".encode().rjust(size)
        case "D":
            raw = f"{value:%Y%m%d}".rjust(8, "0").encode()
        case "L":
            raw = b"T" if value else b"F"
        case "I":
            raw = struct.pack("<i", value)
        case "B":
            raw = struct.pack("<d", value)
        case "Y":
            raw = struct.pack("<q", int(decimal.Decimal(value).scaleb(4).to_integral_value()))
        case "T":
            at = value.replace(tzinfo=None)
            ms = (at.hour * 3600 + at.minute * 60 + at.second) * 1000 + at.microsecond // 1000
            raw = struct.pack("<ii", at.toordinal() + JULIAN_ORDINAL, ms)
        case _:
            data = value.encode(encoding) if isinstance(value, str) else bytes(value)
            raw = struct.pack("<i", memo(data) if data else 0)
    if len(raw) > size:
        raise EngineError("value too wide", f"{slot.info.name}: {value!r}")
    return raw


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]
    records: int


class DbfWriter(DataSourceArrowWriter):
    """One table a task, as folder/part-<write>-<partition>.dbf."""

    BLOCK = 64  # bytes of a memo block
    UNDONE = ".undone"  # at the end of the names of files that aren't committed

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.folder, self.encoding, self.overwrite = schema, options["path"], options.get("encoding", "cp1252"), overwrite
        self.job = uuid.uuid4().hex
        self.code_page = next((k for k, v in CODE_PAGES.items() if v == self.encoding), 0)
        slots_of(schema)  # refused at once if it can't be written

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import io
        import tempfile

        from pyspark import TaskContext

        context = TaskContext.get()
        name, attempt = f"part-{self.job}-{context.partitionId():06}", f".{context.taskAttemptId()}{self.UNDONE}"
        slots = slots_of(self.schema)
        filesystem, folder = open_file(self.folder)
        filesystem.create_dir(folder, recursive=True)
        memos = any(s.info.letter in "MG" for s in slots)
        records, block = 0, 512 // self.BLOCK
        # The number of records stands in the header, so the records wait in a file of the task until it is known.
        with tempfile.TemporaryFile() as body:
            memo_file = filesystem.open_output_stream(f"{folder}/{name}.fpt{attempt}") if memos else io.BytesIO()
            memo_file.write(bytes(6) + struct.pack(">H", self.BLOCK) + bytes(504))

            def memo(data: bytes) -> int:
                nonlocal block
                entry = struct.pack(">II", 1, len(data)) + data
                memo_file.write(entry + bytes(-len(entry) % self.BLOCK))
                at, block = block, block + -(-len(entry) // self.BLOCK)
                return at

            for batch in batches:
                columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                deleted = columns.get("_deleted", [False] * batch.num_rows)
                for i in range(batch.num_rows):
                    values = [columns[s.info.name][i] for s in slots[:-1]]
                    flags = sum(1 << s.null_bit for s, v in zip(slots, values, strict=False) if v is None)
                    body.write((b"*" if deleted[i] else b" ") + b"".join(encode(s, v, self.encoding, memo) for s, v in zip(slots, values, strict=False)) + flags.to_bytes(slots[-1].length, "little"))
                records += batch.num_rows
            memo_file.close()
            body.seek(0)
            with filesystem.open_output_stream(f"{folder}/{name}.dbf{attempt}") as out:
                out.write(table_head(slots, records, self.code_page))
                while data := body.read(1 << 20):
                    out.write(data)
                out.write(b"\x1a")
        return Written((*([f"{name}.fpt{attempt}"] if memos else []), f"{name}.dbf{attempt}"), records)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the committed files, removes the others of this write, and former tables if they are to be overwritten."""
        filesystem, folder = open_file(self.folder)
        kept = {n: n.removesuffix(self.UNDONE).rpartition(".")[0] for m in messages if m is not None for n in m.names}
        former = [x for x in filesystem.get_file_info(arrow_fs.FileSelector(folder)) if x.base_name not in kept]
        for info in former:
            if info.base_name.startswith(f"part-{self.job}-") or self.overwrite and info.base_name.lower().endswith((".dbf", ".fpt", ".dbt")):
                filesystem.delete_file(info.path)
        for undone, name in kept.items():
            filesystem.move(f"{folder}/{undone}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        filesystem, folder = open_file(self.folder)
        for m in messages:
            for name in m.names if m is not None else ():
                filesystem.delete_file(f"{folder}/{name}")


class DbfSource(DataSource):
    """The data source."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        filesystem, name = open_file(path)
        info = filesystem.get_file_info(name)
        if info.type == arrow_fs.FileType.Directory:
            prefix = path[: len(path) - len(name)]
            return sorted(prefix + f.path for f in filesystem.get_file_info(arrow_fs.FileSelector(name)) if f.path.lower().endswith(".dbf"))
        return [path]

    def schema(self) -> T.StructType:
        paths = self._paths()
        if not paths:
            raise EngineError("no table", self.options["path"])
        return header_of(paths[0]).schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DbfReader(schema, self._paths(), dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DbfWriter:
        return DbfWriter(schema, dict(self.options), overwrite)


def write_dbf(table, path: str, mode: str = "overwrite", **options) -> None:
    """A table as DBF files, one a task, with its deletion marks; records are numbered by file and place."""
    spark = table.df.sparkSession
    spark.dataSource.register(DbfSource)
    table.df.write.format("dbf").mode(mode).options(**options).save(path)


def open_dbf(spark, path: str, name: str, **options):
    """A DBF file as a table."""
    from ..operators.table import Table

    spark.dataSource.register(DbfSource)
    reader = spark.read.format("dbf")
    for key in ("encoding", "rows_per_partition"):
        if key in options:
            reader = reader.option(key, str(options.pop(key)))
    df = reader.load(path)
    # Field metadata is put on again, as a data source's columns may lose it.
    for slot in header_of(DbfSource({"path": path})._paths()[0]).fields:
        df = df.withMetadata(slot.info.name, slot.info.metadata())
    return Table(df, name, **options)
