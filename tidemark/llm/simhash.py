"""SimHash near-duplicates: a binary trie self-join over the distinct fingerprints.

Fingerprint: the text's ASCII capitals are lowered, its words are the runs of non-white-space, its features the
3-word shingles (repeats included; fewer words: the whole sequence; no word: fingerprint zero); bit i is set if more
than half of the shingles' XXH64 values (seed 42) have it set.

Join: two fingerprints within three of 64 bits agree on at least one of four 16-bit blocks.  Each distinct fingerprint
is sent to its four (block, value) cells, so a cell is the root of a binary trie over the other 48 bits, and the trie
is joined with itself: pairs of nodes go down together, differing bits add up, and a pair is pruned once
its sum exceeds the budget.  A cell with many fingerprints (groups of near copies) is divided again by the same
argument: pairs within the budget also agree on one of four 12-bit blocks of the remaining 48 bits, and so on.

Only links that join two classes are kept: a task holds a union-find over its cells' leaves, node pairs
whose leaves are all of one class are pruned, and a task emits at most one link a fingerprint.  Nothing is lost, as
classes of the links are those of all pairs within the budget.  Classes of the whole are then found by
alternating large-star and small-star steps on the links (Kiveris et al., Connected components in MapReduce and
beyond, 2014), written to the checkpoint folder after each round.

Exact copies share a fingerprint and never enter the join as more than one row.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; a null id is never the
representative of a class unless all its ids are null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_columns, materialise, prepare, read

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: A cell with more fingerprints than this is divided by blocks of its remaining bits.
CELL = 4096
#: Node pairs that go down together at once; bounds the memory of the traversal.
FRONT = 1 << 17


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle. Lowering and splitting work on bytes, so they touch ASCII alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fp (the fingerprint as a signed 64-bit number)."""

    def make():
        def work(keys, texts):
            prints = np.array([simhash(shingle_hashes(t)) for t in texts], np.uint64)
            return keys, prints.view(np.int64)

        return work

    return map_columns(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, fp long", make)


class Classes:
    """Union-find over 0..n-1, with the least member as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def labels(self) -> np.ndarray:
        p = self.parent
        while True:
            up = p[p]
            if np.array_equal(up, p):
                return p
            self.parent = p = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)


def trie_join(keys: np.ndarray, cells: np.ndarray, budget: int = BUDGET, front: int = FRONT) -> Classes:
    """Classes of the leaves linked within the budget, by a self-join of the binary trie under every cell.

    keys must be sorted within each run of equal cells and distinct there.  A node is a range of leaves that share their
    first bits.
    """
    n = len(keys)
    classes = Classes(n)
    if n < 2:
        return classes
    # Neighbours in the order are linked first: it makes most node pairs of a dense cell one class from the start.
    near = (cells[1:] == cells[:-1]) & (np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget)
    at = np.flatnonzero(near)
    classes.join(at, at + 1)
    edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
    big = edges[1:] - edges[:-1] > 1
    lo, hi = edges[:-1][big], edges[1:][big]
    # A pair: node a, node b (a <= b), the bit at which they are split next, and the differing bits above it.
    stack = [(lo, hi, lo, hi, np.full(len(lo), BITS - 1), np.zeros(len(lo), np.int64))]
    while stack:
        alo, ahi, blo, bhi, bit, diff = stack.pop()
        if len(alo) > front:
            half = len(alo) // 2
            stack.append(tuple(x[:half] for x in (alo, ahi, blo, bhi, bit, diff)))
            stack.append(tuple(x[half:] for x in (alo, ahi, blo, bhi, bit, diff)))
            continue
        # Nothing is left to learn of a pair whose leaves are all of one class.
        label = classes.labels()
        ends = np.concatenate((np.flatnonzero(label[1:] != label[:-1]) + 1, [n]))
        run_end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
        one = (run_end[alo] >= ahi) & (run_end[blo] >= bhi) & (label[alo] == label[blo])
        alo, ahi, blo, bhi, bit, diff = (x[~one] for x in (alo, ahi, blo, bhi, bit, diff))
        # Two leaves: compare them outright.
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[leaves], blo[leaves]
        met = np.bitwise_count(keys[a] ^ keys[b]) <= budget
        if met.any():
            a, b = a[met], b[met]
            apart = label[a] != label[b]
            classes.join(a[apart], b[apart])
        alo, ahi, blo, bhi, bit, diff = (x[~leaves] for x in (alo, ahi, blo, bhi, bit, diff))
        if not len(alo):
            continue
        if (bit < 0).any():
            raise ValueError("the keys of a cell aren't distinct")
        amid, bmid = _split(keys, alo, ahi, bit), _split(keys, blo, bhi, bit)
        same = (alo == blo) & (ahi == bhi)
        children = [(alo, amid, blo, bmid, bit - 1, diff), (amid, ahi, bmid, bhi, bit - 1, diff), (alo, amid, bmid, bhi, bit - 1, diff + 1), (amid, ahi, blo, bmid, bit - 1, diff + 1)]
        kept = []
        for k, (al, ah, bl, bh, nb, d) in enumerate(children):
            ok = (ah > al) & (bh > bl) & (d <= budget)
            if k == 3:
                ok &= ~same  # the mirror image of the pair before
            ok &= ~((al == bl) & (ah == bh) & (ah - al == 1))  # a leaf with itself
            kept.append(tuple(x[ok] for x in (al, ah, bl, bh, nb, d)))
        merged = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        if len(merged[0]):
            stack.append(merged)
    return classes


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The first leaf of each range whose given bit is set: a binary search in all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    shift = bit.astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        up = (keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1) == 0
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def _blocks(taken: tuple[tuple[int, int], ...]) -> list[tuple[tuple[int, int], ...]]:
    """Every way to extend the taken bit ranges by one of four equal blocks of the other bits; a block is a few ranges."""
    free = [i for i in range(BITS) if not any(a <= i < b for a, b in taken)]
    size = len(free) // 4
    out = []
    for k in range(4):
        bits = free[k * size : (k + 1) * size if k < 3 else len(free)]
        ranges: list[list[int]] = []
        for i in bits:
            if ranges and ranges[-1][1] == i:
                ranges[-1][1] = i + 1
            else:
                ranges.append([i, i + 1])
        out.append((*taken, *map(tuple, ranges)))
    return out


def _masked(ranges: tuple[tuple[int, int], ...]):
    """The fingerprint with only the bits of some ranges left, as a column of fp."""
    mask = sum(1 << i for a, b in ranges for i in range(a, b))
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def cells(distinct: DataFrame, limit: int = CELL, levels: int = 3) -> DataFrame:
    """Rows (scheme, value, fp): the cells of every distinct fingerprint; cells above the limit are divided, exactly.

    The last level is not divided any more; its cells agree on 16 + 12 + 9 bits.
    """
    schemes = {str(k): r for k, r in enumerate(_blocks(()))}
    placed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), _masked(r).alias("value")) for k, r in schemes.items()))).alias("c")).select("c.scheme", "c.value", "fp")
    done = None
    for _ in range(1, levels):
        big = materialise(placed.groupBy("scheme", "value").count().filter(F.col("count") > limit).select("scheme", "value"))
        if big.isEmpty():
            break
        fine = placed.join(big, ["scheme", "value"], "left_anti")
        done = fine if done is None else done.unionByName(fine)
        schemes = {f"{k}.{j}": r for k, taken in schemes.items() for j, r in enumerate(_blocks(taken))}
        split = F.create_map(*(x for k in {k.rpartition(".")[0] for k in schemes} for x in (F.lit(k), F.array(*(F.struct(F.lit(f"{k}.{j}").alias("scheme"), _masked(schemes[f"{k}.{j}"]).alias("value")) for j in range(4))))))
        placed = placed.join(big, ["scheme", "value"], "left_semi").select("fp", F.explode(split[F.col("scheme")]).alias("c")).select("c.scheme", "c.value", "fp")
    return placed if done is None else done.unionByName(placed)


def links(distinct: DataFrame, budget: int = BUDGET, limit: int = CELL) -> DataFrame:
    """Rows (a, b): links between distinct fingerprints whose classes are those of all pairs within the budget."""
    spark = distinct.sparkSession
    prepare(spark)
    if budget > 3:
        raise ValueError("four blocks prove pairs within three bits only")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cells(distinct, limit).repartition(parts, "scheme", "value").sortWithinPartitions("scheme", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(codes, values, prints):
            order = np.lexsort((prints, values, codes))
            codes, values, prints = codes[order], values[order], prints[order]
            new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (values[1:] != values[:-1])))
            label = trie_join(prints, np.cumsum(new), budget).labels()
            moved = np.flatnonzero(label != np.arange(len(label)))
            signed = prints.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[label[moved]]), pa.array(signed[moved])], ["a", "b"])

        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()])
            held.append((codes, batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
            if sum(len(x[0]) for x in held) >= 1 << 18:  # whole cells so far are solved, the last one waits
                codes, values, prints = map(np.concatenate, zip(*held, strict=True))
                cut = len(codes) - int(np.argmax(((codes != codes[-1]) | (values != values[-1]))[::-1])) if codes[0] != codes[-1] or values[0] != values[-1] else 0
                if cut:
                    yield solve(codes[:cut], values[:cut], prints[:cut])
                    held = [(codes[cut:], values[cut:], prints[cut:])]
                else:
                    held = [(codes, values, prints)]
        if held:
            yield solve(*map(np.concatenate, zip(*held, strict=True)))

    return placed.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node of every node's component. Nodes without a link have no row.

    Large-star: a node's larger neighbours are linked to its least neighbour; small-star: its smaller ones are.
    Both steps aggregate a minimum per node and join it back, so no node's neighbours are gathered in a list.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # After a large-star u > v in every row, and small-star needs the smaller neighbours alone.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(small, "u")
        star = pointed.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        star = materialise(star)
        # Done when it is a forest of stars that a further round would not change.
        roots = star.select(F.col("v").alias("u")).distinct()
        if star.join(roots, "u", "left_semi").isEmpty() and star.groupBy("u").count().filter("count > 1").isEmpty():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
        edges = star


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row a document: id, fp, root (the least fingerprint of its component), component_id (least id reachable)."""
    prints = materialise(fingerprints(df, id_col, text_col))
    distinct = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(distinct.select("fp"), budget))
    # Least id of every component, for the fingerprints that have links.
    met = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    of_root = met.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = met.join(of_root, "root").select("fp", "root", "component_id")
    reach = distinct.join(of_print, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    reach = materialise(reach)
    # Fingerprints with more than a thousandth of the rows are less than a thousand: they go to every task, so that
    # no task of the join meets a large group of copies.
    total = reach.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = reach.filter(F.col("n") * 1000 > total)
    hot = prints.join(F.broadcast(many.drop("n")), "fp")
    rest = prints.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(reach.drop("n"), "fp")
    names = [F.col(f"`{id_col}`"), "fp", "root", "component_id"]
    return hot.select(*names).unionAll(rest.select(*names))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """df's rows and columns, one row of each component: the one of least id, then least fingerprint; null ids last.

    Texts are joined by id alone.  Only where an id occurs in several rows are fingerprints taken again, of those rows.
    """
    k, p = fresh(df, "_key", "_fp")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")).alias(k)
    found = materialise(near_duplicates(df, id_col, text_col, budget).select(F.col(f"`{id_col}`").alias("id"), key, "fp", "root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", k, "fp")).alias("x")).select(f"x.{k}", F.col("x.fp").alias(p))
    repeated = found.groupBy(k).count().filter("count > 1").select(k)
    single = materialise(first.join(repeated, k, "left_anti"))
    several = materialise(first.join(repeated, k, "left_semi"))
    names = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn(k, key)
    kept = rows.join(single, k, "left_semi").select(*names)
    if several.isEmpty():
        return kept

    # The rows of repeated ids with their fingerprints; of equal (id, fingerprint) one row stays.
    twice = rows.join(several.select(k).distinct(), k, "left_semi")
    schema = T.StructType([*df.schema.fields, T.StructField(k, T.StringType()), T.StructField(p, T.LongType())])
    at = df.columns.index(text_col)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(shingle_hashes(t)) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], [*batch.schema.names, p])

    chosen = twice.select(*names, k).mapInArrow(marked, schema).join(several, [k, p], "left_semi")
    return kept.unionAll(chosen.dropDuplicates([k, p]).select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
