"""Compound and single-tag index files: definitions of tags, and the entries of a tag as a Spark data source named "cdx".

    table = with_index(table, "/data/people.cdx")          # the file's tags, as orders of the table
    entries(spark, "/data/people.cdx", "NAME", pad=b" ")    # part, place, key (bytes as stored), recno

An order is a view here, so nothing but the definitions is needed of an index file; its entries serve checks and keyed lookups without
the table.  They are read by as many tasks as the tag's root has children, each in its own part of the tree, and stand in the order of (part,
place); a descending tag is stored ascending.  Nothing but headers and roots is read on the driver.

write_definitions() stores tags in a file without entries, for a program that rebuilds orders when it opens them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError
from ..operators.table import Table, Tag
from .dbf import open_file

# Fixed values of the format: sizes, bits of the options, marks.
BLOCK, NAME, HEADER = 512, 10, 1024
UNIQUE, CANDIDATE, FILTERED, COMPACT, PLAIN, COMPOUND = 0x01, 0x04, 0x08, 0x20, 0x60, 0xE0
LEAF, BLOCK_NOTE, NONE = 0x02, 0xABCD, 0xFFFFFFFF
COLLATIONS = {"": "machine", "GENERAL": "general"}


@dataclass(frozen=True)
class TagHeader:
    """A tag as its header tells it; root is the offset of its tree, block the size of the tree's blocks."""

    tag: Tag
    root: int
    key_size: int
    options: int
    block: int = BLOCK
    unit: int = 1


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").strip()


def _header(file, at: int, name: str, block: int = BLOCK, unit: int = 1) -> TagHeader:
    raw = file.read_at(HEADER, at)
    if len(raw) < HEADER:
        raise EngineError("not an index", "the file is too short")
    root, key_size, options = *struct.unpack_from("<I", raw), *struct.unpack_from("<HB", raw, 12)
    if struct.unpack_from("<I", raw, 16)[0] == BLOCK_NOTE and at == 0:
        block, unit = struct.unpack_from("<II", raw, 20)
    if options < COMPACT or not root or root == NONE:
        raise EngineError("not an index", f"options {options}, root {root}")
    descending, _, filter_size, _, expression_size = struct.unpack_from("<5H", raw, 0x1F6)
    expression = _text(raw[0x200 : 0x200 + expression_size])
    condition = _text(raw[0x200 + expression_size : 0x200 + expression_size + filter_size]) if options & FILTERED else ""
    order = _text(raw[0x1EE:0x1F6])
    unique = "error" if options & CANDIDATE else "continue" if options & UNIQUE else None
    return TagHeader(Tag(name, expression, condition or None, descending == 1, unique, COLLATIONS.get(order, order.lower())), root * unit, key_size, options, block, unit)


def _leaf(raw: bytes, key_size: int, pad: bytes) -> Iterator[tuple[bytes, int]]:
    """Keys and record numbers of a leaf: a key has its leading bytes from the one before and its last ones padded."""
    n = struct.unpack_from("<H", raw, 2)[0]
    number_bits, shared_bits, padded_bits, size = raw[20], raw[21], raw[22], raw[23]
    key, at = b"", len(raw)
    for i in range(n):
        packed = int.from_bytes(raw[24 + i * size : 24 + (i + 1) * size], "little")
        number = packed & (1 << number_bits) - 1
        shared = packed >> number_bits & (1 << shared_bits) - 1
        padded = packed >> number_bits + shared_bits & (1 << padded_bits) - 1
        own = key_size - shared - padded
        if own < 0 or at - own < 24 + n * size:
            raise EngineError("damaged index", f"entry {i}")
        at -= own
        key = key[:shared] + raw[at : at + own] + pad * padded
        yield key, number


def _children(raw: bytes, key_size: int, unit: int) -> list[int]:
    """Offsets of an inner block's children; numbers in inner blocks have their high byte first."""
    n = struct.unpack_from("<H", raw, 2)[0]
    return [struct.unpack_from(">I", raw, 12 + i * (key_size + 8) + key_size + 4)[0] * unit for i in range(n)]


def _walk(file, head: TagHeader, at: int, pad: bytes, depth: int = 0) -> Iterator[tuple[bytes, int]]:
    raw = file.read_at(head.block, at)
    if len(raw) < head.block or depth > 64:
        raise EngineError("damaged index", f"block at {at}")
    if struct.unpack_from("<H", raw)[0] & LEAF:
        yield from _leaf(raw, head.key_size, pad)
    else:
        for child in _children(raw, head.key_size, head.unit):
            yield from _walk(file, head, child, pad, depth + 1)


def headers(path: str) -> list[TagHeader]:
    """The tags of an index file, by name; a single-tag file's tag has the file's name."""
    filesystem, name = open_file(path)
    with filesystem.open_input_file(name) as file:
        first = _header(file, 0, name.rpartition("/")[2].rpartition(".")[0].upper())
        if first.options & COMPOUND != COMPOUND and first.options < 0x40:
            return [first]
        return [_header(file, at * first.unit, key.decode("latin-1").strip(), first.block, first.unit) for key, at in _walk(file, first, first.root, b" ")]


def tags(path: str) -> list[Tag]:
    """The definitions alone."""
    return [h.tag for h in headers(path)]


def with_index(table: Table, path: str) -> Table:
    """The table with all tags of an index file; unique ones are checked as with_tag does."""
    for tag in tags(path):
        table = table.with_tag(tag)
    return table


class Subtree(InputPartition):
    def __init__(self, part: int, at: int):
        self.part, self.at = part, at


SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("recno", T.LongType())])


class CdxReader(DataSourceReader):
    def __init__(self, path: str, tag: str, pad: bytes):
        self.path, self.pad = path, pad
        found = [h for h in headers(path) if h.tag.name.upper() == tag.upper()]
        if not found:
            raise EngineError("no tag", tag)
        self.head = found[0]

    def partitions(self) -> list[InputPartition]:
        filesystem, name = open_file(self.path)
        with filesystem.open_input_file(name) as file:
            raw = file.read_at(self.head.block, self.head.root)
        if struct.unpack_from("<H", raw)[0] & LEAF:
            return [Subtree(0, self.head.root)]
        return [Subtree(i, at) for i, at in enumerate(_children(raw, self.head.key_size, self.head.unit))]

    def read(self, part: Subtree) -> Iterator[pa.RecordBatch]:
        from itertools import batched

        filesystem, name = open_file(self.path)
        with filesystem.open_input_file(name) as file:
            done = 0
            for some in batched(_walk(file, self.head, part.at, self.pad), 8192):
                columns = [[part.part] * len(some), list(range(done, done + len(some))), [k for k, _ in some], [n for _, n in some]]
                done += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], SCHEMA.names)


class CdxSource(DataSource):
    """The data source; options: path, tag, pad (the byte that ends keys, as a number; 0 by default)."""

    @classmethod
    def name(cls) -> str:
        return "cdx"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CdxReader(self.options["path"], self.options["tag"], bytes([int(self.options.get("pad", 0))]))


def entries(spark: SparkSession, path: str, tag: str, pad: bytes = b"\0") -> DataFrame:
    """A tag's entries: part, place, key, recno. Keys of text in the machine's order end in blanks (pad), all others in zeros."""
    spark.dataSource.register(CdxSource)
    return spark.read.format("cdx").option("tag", tag).option("pad", pad[0]).load(path)


def double_key(key: bytes) -> float:
    """The number or Julian day of a numeric key: its sign bit is turned, and all bits of a negative one."""
    raw = bytes([key[0] ^ 0x80]) + key[1:] if key[0] & 0x80 else bytes(b ^ 0xFF for b in key)
    return struct.unpack(">d", raw)[0]


def _empty_leaf() -> bytes:
    head = struct.pack("<HHII", 3, 0, NONE, NONE) + struct.pack("<HIBBBBBB", BLOCK - 24, 0xFFFF, 15, 15, 16, 4, 4, 3)
    return head.ljust(BLOCK, b"\0")


def _definition(tag: Tag, root: int, key_size: int) -> bytes:
    options = PLAIN | (UNIQUE if tag.unique == "continue" else CANDIDATE if tag.unique == "error" else 0) | (FILTERED if tag.filter else 0)
    expression, condition = tag.key.encode("latin-1") + b"\0", (tag.filter or "").encode("latin-1") + b"\0"
    if len(expression) + len(condition) > BLOCK:
        raise EngineError("expression too long", tag.name)
    order = next((k for k, v in COLLATIONS.items() if v == tag.collation), tag.collation.upper()).encode()[:8]
    raw = struct.pack("<IIIHBB", root, 0, 0, key_size, options, 1).ljust(0x1EE, b"\0") + order.ljust(8, b"\0")
    raw += struct.pack("<5H", int(tag.descending), len(expression), len(condition), 0, len(expression))
    return (raw + expression + (condition if tag.filter else b"")).ljust(HEADER, b"\0")


def write_definitions(path: str, some: list[Tag], key_size: int = 10) -> None:
    """A compound file with the definitions of some tags, whose trees are empty; a file of that kind has few tags."""
    some = sorted((replace(t, name=t.name.upper()[:NAME]) for t in some), key=lambda t: t.name)
    if len(some) > 25:
        raise EngineError("too many tags", str(len(some)))  # what one leaf of the directory holds in any case
    directory, places = struct.pack("<HHII", 3, len(some), NONE, NONE), [HEADER * (i + 1) for i in range(len(some))]
    trees = HEADER * (len(some) + 1)
    keys = b"".join(t.name.encode("latin-1").ljust(NAME) for t in reversed(some))
    infos = b"".join(at.to_bytes(3, "little") for at in places)
    directory += struct.pack("<HIBBBBBB", BLOCK - 24 - len(infos) - len(keys), 0xFFFF, 15, 15, 16, 4, 4, 3) + infos
    directory += bytes(BLOCK - len(directory) - len(keys)) + keys
    head = struct.pack("<IIIHBB", trees, 0, 0, NAME, COMPOUND, 1).ljust(0x1F6, b"\0") + struct.pack("<5H", 0, 1, 1, 0, 1)
    body = b"".join(_definition(t, trees + BLOCK * (i + 1), key_size) for i, t in enumerate(some))
    filesystem, name = open_file(path)
    filesystem.create_dir(name.rpartition("/")[0] or ".", recursive=True)
    with filesystem.open_output_stream(name) as out:
        out.write(head.ljust(HEADER, b"\0") + body + directory + _empty_leaf() * len(some))
