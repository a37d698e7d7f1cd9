"""Order MinHash fingerprints: like MinHash, but sensitive to the order of what it samples.

Every k-mer of the text (k code points) is numbered by its occurrence, so that the pairs (k-mer, number) of a
text are distinct.  For each of ``rows`` hash functions the ``picks`` pairs of least hash are selected, put back into
the order in which they stand in the text, and their k-mers are hashed together as a tuple.  The share of equal
tuples of two fingerprints is their likeness: unlike a plain MinHash it falls when passages are rearranged,
and so bounds the edit distance (Marçais, DeBlasio, Pandey, Kingsford: Locality-sensitive hashing for the edit
distance, 2019).

All arithmetic is modulo 2^64.  The occurrence numbers come from one sort of the k-mers' hashes, whose low bits
hold the position; a text of up to 2^24 code points keeps 40 bits of each hash there.

Edge cases: a null text counts as empty.  A text shorter than k is its own only k-mer; the empty text has a
fingerprint of its own.  Fewer than ``picks`` pairs are all taken.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, prepare, read

K, ROWS, PICKS = 6, 24, 2
# Odd 64-bit multipliers of the mixing steps (golden ratio and the finaliser of splitmix64).
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31 = np.uint64(27), np.uint64(30), np.uint64(31)
#: Pairs hashed at once, over all rows: keeps the matrix in the processor's cache and bounds memory.
BLOCK = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S30)) * MIX1
    x = (x ^ (x >> S27)) * MIX2
    return x ^ (x >> S31)


def _multipliers(rows: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * rows + 1, dtype=np.uint64) * GOLD
    drawn = _mix(seeds)
    return (drawn[:rows] | np.uint64(1))[:, None], drawn[rows:, None]


def kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of every k-mer of the code points."""
    n = max(1, len(points) - k + 1)
    width = min(k, len(points))
    rolled = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        rolled = rolled * GOLD + points[i : i + n]
    return _mix(rolled)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of k-mer and occurrence number."""
    n = len(hashes)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    order = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
    at = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    group = order >> bits
    first = np.empty(n, bool)
    first[0], first[1:] = True, group[1:] != group[:-1]
    if first.all():
        return hashes
    index = np.arange(n)
    nth = index - np.maximum.accumulate(np.where(first, index, 0))
    again = nth > 0
    out = hashes.copy()
    out[at[again]] = _mix(hashes[at[again]] + nth[again].astype(np.uint64) * GOLD)
    return out


def fingerprint(text: str | None, k: int = K, rows: int = ROWS, picks: int = PICKS) -> np.ndarray:
    """rows tuple hashes."""
    a, b = _multipliers(rows)
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    content = kmers(points, k)
    pairs = numbered(content)
    best = keys = None
    step = max(1024, BLOCK // rows)
    line = np.arange(rows)
    for start in range(0, len(pairs), step):
        hashed = pairs[start : start + step] * a + b
        hashed ^= hashed >> S31
        found, at = [], []
        for i in range(min(picks, hashed.shape[1])):
            least = hashed.argmin(axis=1)
            at.append(least + start)
            found.append(hashed[line, least])
            if i + 1 < picks:
                hashed[line, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
        found, at = np.array(found).T, np.array(at).T
        if best is not None:
            found, at = np.hstack([keys, found]), np.hstack([best, at])
        least = np.argsort(found, axis=1, kind="stable")[:, :picks]
        keys, best = np.take_along_axis(found, least, 1), np.take_along_axis(at, least, 1)
    best.sort(axis=1)  # back into the order of the text
    out = np.full(rows, np.uint64(best.shape[1]), np.uint64)
    for column in content[best].T:
        out = _mix(out * GOLD + column)
    return out


def to_string(print_: np.ndarray) -> str:
    """The tuple hashes, 8 hexadecimal digits each."""
    return (print_ >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal tuples of two fingerprints in string form."""
    n = len(a) // 8
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 8 * n, 8)) / n


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: int = ROWS, picks: int = PICKS) -> DataFrame:
    """One row a document: id, fingerprint."""

    def make():
        return lambda keys, texts: (keys, [to_string(fingerprint(t, k, rows, picks)) for t in texts])

    return map_columns(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, fingerprint string", make)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Bytes of text of a range of ids, the most ranges, rows of the sample a range, and leading characters of a text by which equal ids are told apart.
RANGE_BYTES, RANGES, SAMPLE, HEAD = 32 << 20, 16_384, 64, 32


def bounds(rows: DataFrame, least: int) -> list:
    """Upper bounds (id, head) of all ranges but the last, so that each has about as many bytes; a sample a range comes to the driver."""
    size = F.octet_length("text") + 64
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    ranges = min(RANGES, max(least, -(-(total or 0) // RANGE_BYTES)))
    drawn = rows.select("id", "head", size.alias("size"))
    if n > ranges * SAMPLE:
        drawn = drawn.sample(min(1.0, 1.1 * ranges * SAMPLE / n), 5)
    drawn = sorted(drawn.collect(), key=lambda r: (r["id"] is not None, *([r["id"]] if r["id"] is not None else []), r["head"].encode()))
    step, reached, found = sum(r["size"] for r in drawn) / ranges, 0, []
    for r in drawn:
        reached += r["size"]
        if reached >= step * (len(found) + 1) and len(found) < ranges - 1:
            place = (r["id"], r["head"])
            # a very long text or an often repeated id may reach several steps at once; their ranges are one
            found += [place] * max(1, min(int(reached / step) - len(found), ranges - 1 - len(found)))
    return [x for i, x in enumerate(found) if not i or x != found[i - 1]]


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (range, guest, id, text), partitioned by range and sorted; a range's last row is the guest that follows it.

    Ranges of (id, text) of about as many bytes, one a task, replace a window over all rows: only the first row of
    each range also goes to the range before it (the first of all to the last range).  Ids can be of any type that Spark sorts.  Ties of
    an id are ordered by text; null ids come first.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.left(text, F.lit(HEAD)).alias("head"))
    kind = dict(rows.dtypes)["id"]
    cuts = bounds(rows, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    where = F.lit(0)
    if cuts:
        # The number of bounds below the row, found in two steps so that many bounds cost little. A null is less than all else.
        place = lambda key, head: F.struct(F.lit(key).cast(kind).alias("id"), F.lit(head).alias("head"))
        x, step = F.struct("id", "head"), max(1, int(len(cuts) ** 0.5))
        below = lambda some: F.size(F.filter(some, lambda y: y < x))
        coarse = below(F.array(*(place(*c) for c in cuts[step - 1 :: step]))) * step
        where = coarse + below(F.slice(F.array(*(place(*c) for c in cuts)), coarse + 1, step))
    rows = rows.withColumn("range", where)
    # The first row of every range, by (id, head): at most one small row a range comes to the driver.
    firsts = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.min(F.struct("id", "head")).alias("first")).collect()}
    order = sorted(firsts)
    if not order:
        return rows.drop("head").withColumn("guest", F.lit(False))
    targets = [(firsts[r]["id"], firsts[r]["head"], order[i - 1]) for i, r in enumerate(order)]
    targets = spark.createDataFrame(targets, f"key {kind}, first string, range int")  # a row a range
    heads = rows.drop("range").join(F.broadcast(targets), F.col("id").eqNullSafe(F.col("key")) & (F.col("head") == F.col("first")))
    # Among rows of one id and head the least text is the first; texts are compared in the aggregation, not collected.
    heads = heads.groupBy("id", "range").agg(F.min("text").alias("text")).withColumn("guest", F.lit(True))
    both = rows.drop("head").withColumn("guest", F.lit(False)).unionByName(heads)
    return both.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "guest", F.col("id").asc_nulls_first(), "text")


def edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the text replaced by the beginning of the next document's, by id; the
    last document is followed by the first.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    placed = in_order(df, id_col, text_col)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # range, id, text, fingerprint of the row whose successor is still to come
        for batch in batches:
            ids, rows = [], []
            for key, text, range_, guest in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "range", "guest")), strict=True):
                own = to_string(fingerprint(text))
                if last is not None and last[0] == range_:
                    _, before, old, mark = last
                    new = edited(old, text)
                    changed = to_string(fingerprint(new))
                    ids.append(before)
                    rows.append((len(old), hashlib.sha256(new.encode()).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, own)))
                last = None if guest else (range_, key, text, own)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:4]), *(pa.array(c, pa.float64()) for c in columns[4:])], names)

    return placed.select("id", "text", "range", "guest").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return edits(read(spark, sf_dir, "documents"))
