import struct

import pytest

from tidemark.errors import EngineError
from tidemark.operators.table import Table, Tag
from tidemark.sources import cdx

NONE = 0xFFFFFFFF


def header(root, key_size, options, expression="", condition="", descending=0, order=""):
    text = expression.encode() + b"\0" + (condition.encode() + b"\0" if condition else b"")
    raw = struct.pack("<IIIHBB", root, 0, 0, key_size, options, 1).ljust(0x1EE, b"\0") + order.encode().ljust(8, b"\0")
    return (raw + struct.pack("<5H", descending, len(expression) + 1, max(1, len(condition) + 1), 0, len(expression) + 1) + text).ljust(1024, b"\0")


def leaf(keys, size, pad, attribute=2, left=NONE, right=NONE, bits=(16, 4, 4)):
    """A packed leaf: shared leading bytes, left-out trailing pads."""
    infos, body, before = b"", b"", b""
    for key, number in keys:
        trail = size - len(key.rstrip(pad))
        shared = 0
        while before and shared < size - trail and shared < len(before) and key[shared] == before[shared]:
            shared += 1
        packed = number | shared << bits[0] | trail << bits[0] + bits[1]
        infos += packed.to_bytes(sum(bits) // 8, "little")
        body = key[shared : size - trail] + body
        before = key
    head = struct.pack("<HHII", attribute, len(keys), left, right) + struct.pack("<HIBBBBBB", 488 - len(infos) - len(body), (1 << bits[0]) - 1, (1 << bits[1]) - 1, (1 << bits[2]) - 1, *bits, sum(bits) // 8)
    return head + infos + bytes(488 - len(infos) - len(body)) + body


def branch(entries, attribute=1):
    return (struct.pack("<HHII", attribute, len(entries), NONE, NONE) + b"".join(k + struct.pack(">II", n, at) for k, n, at in entries)).ljust(512, b"\0")


def number_key(x):
    raw = struct.pack(">d", x)
    return bytes([raw[0] ^ 0x80]) + raw[1:] if x >= 0 else bytes(b ^ 0xFF for b in raw)


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    """Two tags: a text one of a single leaf, and a numeric one of two levels."""
    names = [(n.ljust(8).encode(), i) for i, n in sorted(enumerate(["", "ab", "abc", "abc", "b", "zz", "ab"], 1), key=lambda x: (x[1], x[0]))]
    numbers = sorted((number_key(x), i) for i, x in enumerate([-1.5, 0.0, 3.25, -100.0, 7.0, 1e9] * 10, 1))
    groups = [numbers[i : i + 20] for i in range(0, 60, 20)]
    at = 1024 * 3
    blocks = [leaf([(b"NAME      ", 1024), (b"PRICE     ", 2048)], 10, b" ", 3), leaf(names, 8, b" ", 3)]
    blocks += [branch([(g[-1][0], g[-1][1], at + 512 * (3 + i)) for i, g in enumerate(groups)])] + [leaf(g, 8, b"\0") for g in groups]
    made = tmp_path_factory.mktemp("x") / "people.cdx"
    made.write_bytes(header(at, 10, 0xE0) + header(at + 512, 8, 0x60, "NAME", order="GENERAL") + header(at + 1024, 8, 0x69, "AMT * 2", ".NOT. DELETED()", 1) + b"".join(blocks))
    return str(made), names, numbers


def test_definitions(path):
    assert cdx.tags(path[0]) == [Tag("NAME", "NAME", None, False, None, "general"), Tag("PRICE", "AMT * 2", ".NOT. DELETED()", True, "continue", "machine")]


def test_entries(spark, path):
    got = [(bytes(r["key"]), r["recno"]) for r in cdx.entries(spark, path[0], "name", b" ").orderBy("part", "place").collect()]
    assert got == path[1]
    df = cdx.entries(spark, path[0], "PRICE")
    assert df.rdd.getNumPartitions() == 3
    got = [(bytes(r["key"]), r["recno"]) for r in df.orderBy("part", "place").collect()]
    assert got == path[2] and [cdx.double_key(k) for k, _ in got] == sorted([-1.5, 0.0, 3.25, -100.0, 7.0, 1e9] * 10)
    with pytest.raises(EngineError, match="no tag"):
        cdx.CdxReader(path[0], "other", b" ")


def test_tags_order_a_table(spark, path):
    t = cdx.with_index(Table.of(spark.createDataFrame([(i + 1, n, float(a)) for i, (n, a) in enumerate([("b", 3), ("a", 3), ("C", 1)])], "_recno long, NAME string, AMT double"), "t"), path[0])
    assert [r["NAME"] for r in t.walk("NAME").collect()] == ["a", "b", "C"]
    assert [r["NAME"] for r in t.walk("PRICE").collect()] == ["b", "C"]


def test_single_tag_files(spark, tmp_path):
    keys = [(b"a   ", 2), (b"b   ", 1)]
    (tmp_path / "one.idx").write_bytes(header(1024, 4, 0x21, "CODE", descending=0) + leaf(keys, 4, b" ", 3))
    assert cdx.tags(str(tmp_path / "one.idx")) == [Tag("ONE", "CODE", None, False, "continue")]
    assert [(bytes(r["key"]), r["recno"]) for r in cdx.entries(spark, str(tmp_path / "one.idx"), "one", b" ").orderBy("place").collect()] == keys


def test_definitions_are_written(tmp_path):
    some = [Tag("PRICE", "o_totalprice", "o_totalprice > 1000", True), Tag("CUST", "o_custkey", None, False, "continue"), Tag("KEY", "o_orderkey", None, False, "error"), Tag("N", "UPPER(name)", None, False, None, "general")]
    cdx.write_definitions(str(tmp_path / "d" / "x.cdx"), some)
    assert sorted(cdx.tags(str(tmp_path / "d" / "x.cdx")), key=lambda t: t.name) == sorted(some, key=lambda t: t.name)


def test_damaged_files(tmp_path):
    for name, raw in (("short", b"x" * 100), ("zero", bytes(4096)), ("cut", header(2048, 10, 0xE0) + bytes(100)), ("entry", header(1024, 10, 0xE0) + leaf([(b"A         ", 1024)], 10, b" ", 3)[:-1] + b"A")):
        (tmp_path / f"{name}.cdx").write_bytes(raw)
        with pytest.raises(EngineError):
            cdx.headers(str(tmp_path / f"{name}.cdx"))
