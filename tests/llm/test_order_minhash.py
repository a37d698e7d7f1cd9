import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import order_minhash as M

U = (1 << 64) - 1


def slow(text, k=M.K, rows=M.ROWS, picks=M.PICKS):
    """The fingerprint by its definition, in plain Python."""

    def mix(x):
        x = ((x ^ (x >> 30)) * int(M.MIX1)) & U
        x = ((x ^ (x >> 27)) * int(M.MIX2)) & U
        return x ^ (x >> 31)

    a, b = M._multipliers(rows)
    points = [ord(c) for c in text]
    width = min(k, len(points))
    content = []
    for i in range(max(1, len(points) - k + 1)):
        h = width
        for c in points[i : i + width]:
            h = (h * int(M.GOLD) + c) & U
        content.append(mix(h))
    seen, pairs = {}, []
    for h in content:
        n = seen.get(h, 0)
        seen[h] = n + 1
        pairs.append(mix((h + n * int(M.GOLD)) & U) if n else h)
    out = []
    for row in range(rows):
        hashed = []
        for i, p in enumerate(pairs):
            x = (p * int(a[row, 0]) + int(b[row, 0])) & U
            hashed.append((x ^ (x >> 31), i))
        at = sorted(i for _, i in sorted(hashed)[:picks])
        h = len(at)
        for i in at:
            h = mix((h * int(M.GOLD) & U) + content[i] & U)
        out.append(h)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcde", "abcdef", "abababababab" * 5, "the cat sat on the mat, the cat sat", "é𝄞東京" * 4])
def test_fingerprint_equals_its_definition(text):
    assert M.fingerprint(text).tolist() == slow(text)


def test_blocks_do_not_matter(monkeypatch):
    text = "".join(random.Random(1).choice("abcd ") for _ in range(6000))
    whole = M.fingerprint(text)
    monkeypatch.setattr(M, "BLOCK", 1024 * M.ROWS)
    assert np.array_equal(M.fingerprint(text), whole) and whole.tolist() == slow(text)


def test_order_and_edits_count():
    drawn = random.Random(3)
    words = [f"{drawn.randrange(10**6)}" for _ in range(400)]
    text = " ".join(words)
    likeness = lambda a, b: M.likeness(M.to_string(M.fingerprint(a, rows=64)), M.to_string(M.fingerprint(b, rows=64)))
    edit = " ".join(w if i % 100 else "x" for i, w in enumerate(words))
    moved = " ".join(words[200:] + words[:200])
    assert likeness(text, text) == 1 and likeness(text, edit) > 0.8
    assert 0.3 < likeness(text, moved) < 0.75  # the same k-mers, but about half of the pairs turn round
    assert likeness(text, " ".join(words[::-1])) < 0.7 and likeness(text, "other text altogether " * 50) < 0.1


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        f, g, n = (M.to_string(M.fingerprint(x)) for x in (text, new, after))
        want.append((key or 0, len(text), hashlib.sha256(new.encode()).hexdigest(), f, g, M.likeness(f, g), M.likeness(f, n)))
    assert sorted((r[0] or 0, *tuple(r)[1:]) for r in got) == sorted(want)


@pytest.mark.parametrize("parts", [2, 8, 50])
def test_whole_table(spark, documents, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = M.query(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    check([(r["doc_id"], r["text"]) for r in documents.collect()], got)


def test_edges(spark, odd, empty):
    check([(r["doc_id"], r["text"]) for r in odd.collect()], M.edits(odd).collect())
    assert M.edits(empty).count() == 0
    assert len(M.edits(odd.filter("doc_id = 4")).collect()) == 2
    assert M.fingerprints(odd).count() == odd.count()


def test_ids_of_any_type(spark, documents):
    from pyspark.sql import functions as F

    rows = [("b", "text of b"), ("a", "text of a"), (None, "no id"), ("é", "text of é"), ("B", "of B"), ("𝄞", "clef"), ("\uffff", "last")]
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    got = {r["name"]: r["edited_sha256"] for r in M.edits(spark.createDataFrame(rows, "name string, text string"), "name").collect()}
    for i, (key, text) in enumerate(order):
        assert got[key] == hashlib.sha256(M.edited(text, order[(i + 1) % len(order)][1]).encode()).hexdigest()
    days = documents.limit(40).select(F.date_add(F.lit("2024-01-01"), F.col("doc_id").cast("int")).alias("day"), "text")
    assert M.edits(days, "day").count() == 40


def test_ranges_follow_the_bytes(spark, monkeypatch):
    """Many ranges of about as many bytes, one a task; a repeated id is divided too."""
    monkeypatch.setattr(M, "RANGE_BYTES", 4000)
    rows = [(i, f"{i} " + "word " * (i % 30)) for i in range(900)] + [(450, f"{i:04} the same id many times over") for i in range(900)] + [(17, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = M.in_order(df, "doc_id", "text")
    used = [(r, size) for r, size in placed.rdd.mapPartitions(lambda p: [_measure(p)]).collect() if r]
    assert len(used) > 30 and all(len(r) == 1 for r, _ in used)
    assert sorted(size for _, size in used)[-2] < 4 * 4000  # but for the one long text
    check(rows, M.edits(df).collect())


def _measure(rows):
    rows = list(rows)
    return sorted({r["range"] for r in rows}), sum(len(r["text"]) + 64 for r in rows)
