"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by the MD5 of seed and id).  A document's virtual
finish time is the number of its source's words served up to and including it, divided by the source's target;
a source that must be repeated is queued again behind itself.  All queue entries are range-sorted by finish
time (ranges of virtual time, sorted inside) and served until the total budget is used up.  Since the targets sum up to the budget, that is at time 1:
entries that finish by then are taken whole, and the one entry that each source has in service is cut at the
word where the time ends.

Targets: weight shares of the budget, but no source may get more than ``repeats`` times its size; the excess
goes to the others by their weights until none is above.

Scale: only ids, sources and sizes are shuffled, never texts.  The running sums of a source are taken over
buckets of its shuffled order, whose number follows the row count, and then joined by their sums, so a source with
a third of all rows isn't a task.  The number of sources decides the size of the small tables (one row a source
and bucket); no step brings a source's rows together.

Edge cases: null texts have size 0 and are never taken; null sources form one source, the last; documents of
equal ids and sizes are interchangeable and their order is that of the sort; no rows give no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, prepare, read

#: Rows of a bucket of a source's shuffled order, about.
BUCKET_ROWS = 20_000
SEED = "mix-1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: dict, weights: dict, budget: float, repeats: int) -> dict:
    """Targets of the sources: weight shares of the budget, none above repeats times its size.

    The level is where the capped shares sum up to the budget: sources are taken by the ratio of cap and weight, and
    those whose ratio is below the level of the rest are full.  One value a source, so it runs on the driver.
    """
    targets = {s: 0.0 for s in sizes}
    order = sorted((s for s in sizes if weights[s] > 0), key=lambda s: repeats * sizes[s] / weights[s])
    left, rest = budget, sum(weights[s] for s in order)
    for k, s in enumerate(order):
        level = left / rest
        if level <= repeats * sizes[s] / weights[s]:
            targets.update({x: weights[x] * level for x in order[k:]})
            break
        targets[s] = float(repeats * sizes[s])
        left, rest = left - repeats * sizes[s], rest - weights[s]
    return targets


def cyclic_weights(sources: list, cycle: tuple[float, ...] = (5, 2, 1)) -> dict:
    """Weights for sources in code point order, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def mix(df: DataFrame, weights=cyclic_weights, share: float = 1.0, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, and of its first entry in
    the mix v_finish and position (words served before it); those are null if nothing is taken.

    weights: a dictionary by source or a function that makes one out of the list of sources; share: the budget as a
    share of all words.
    """
    rows = materialise(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size")).withColumn("order", F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes, most = {r["source"]: r["size"] for r in by_source}, max((r["n"] for r in by_source), default=0)
    weight = weights(list(sizes)) if callable(weights) else weights
    budget = share * sum(sizes.values())
    targets = water_fill(sizes, weight, budget, repeats)
    spark = df.sparkSession
    table = spark.createDataFrame([(s, int(sizes[s]), targets[s]) for s in sizes], "source string, source_size long, target double")

    # Position of a document in its source's queue: the words of the buckets before plus those before it in its bucket.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits = 1
    while 16**digits * BUCKET_ROWS < most:
        digits += 1
    queue = rows.withColumn("bucket", F.substring("order", 1, digits))
    sums = queue.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = (
        queue.alias("q").join(sums.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
        .join(table.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source")))
        .select("q.doc_id", "q.source", "q.size", "t.source_size", "t.target", "q.order", (F.col("s.before") + F.col("q.within")).alias("start"))
    )

    # Queue entries: as many rounds as the target needs, each with its virtual start and finish time.
    rounds = F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    entries = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("round", F.explode(F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0)))))
    entries = entries.withColumn("begin", F.col("round") * F.col("source_size") + F.col("start"))
    entries = entries.withColumn("v_start", F.col("begin") / F.col("target")).withColumn("v_finish", (F.col("begin") + F.col("size")) / F.col("target"))

    # An entry in service at time 1, when the budget is used up, is cut at the word where its source's target ends.
    room = F.floor(F.col("target")) - F.col("begin")
    part = F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long")
    entries = entries.filter(F.col("v_start") < 1).withColumn("words", F.when(F.col("v_finish") <= 1, F.col("size")).otherwise(part))

    # The global order: ranges of virtual time, sorted inside, with the words of the ranges before.
    ranges = max(4 * tasks, -(-sum(r["n"] for r in by_source) // BUCKET_ROWS))
    entries = entries.withColumn("range", F.least(F.floor(F.col("v_finish") * ranges), F.lit(ranges)).cast("int"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = entries.groupBy("range").agg(F.sum("words").alias("words")).select("range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    in_range = Window.partitionBy("range").orderBy("v_finish", "order", "doc_id", "round").rowsBetween(Window.unboundedPreceding, -1)
    served = entries.withColumn("inside", F.coalesce(F.sum("words").over(in_range), F.lit(0))).join(by_range, "range")
    served = served.withColumn("position", F.col("ahead") + F.col("inside")).filter(F.col("position") < budget)
    taken = served.groupBy("doc_id", "source", "size", "order", "start").agg(F.sum("words").alias("taken"), F.min("v_finish").alias("v_finish"), F.min("position").alias("position"))
    keys = ["doc_id", "source", "size", "order", "start"]
    p, t = placed.alias("p"), taken.alias("t")
    joined = p.join(t, [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left")
    return joined.select(F.col("p.doc_id").alias(id_col), F.col("p.source").alias("source"), F.col("p.size").alias("size"), "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0)).alias("taken"), "t.v_finish", "t.position")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    for k, m in enumerate(WORD.finditer(text), 1):
        if k == n:
            return text[: m.end()]
    return text


def mixed_rows(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars") -> DataFrame:
    """The mix itself: every document as often as it is taken whole, and once more cut to the words left over.

    mixed is what mix() returned for df.  Columns and their order are df's; count_col, if df has it, is the new
    number of characters.  Rows of equal id, source and size share what they are given, evenly and rounded down.
    """
    prepare(df.sparkSession)
    k, taken, size, turn, left = fresh(df, "_key", "_taken", "_size", "_round", "_left")
    key = lambda i, s, n: F.md5(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("~")), F.coalesce(s, F.lit("~~")), n.cast("string")))
    plan = mixed.withColumn(k, key(F.col(f"`{id_col}`"), F.col("source"), F.col("size")))
    plan = plan.groupBy(k).agg(F.floor(F.sum("taken") / F.count(F.lit(1))).cast("long").alias(taken), F.first("size").alias(size)).filter(F.col(taken) > 0)
    rows = df.withColumn(k, key(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), words(F.col(f"`{text_col}`"))))
    met = rows.join(plan, k).withColumn(turn, F.explode(F.sequence(F.lit(0), (F.ceil(F.col(taken) / F.col(size)) - 1).cast("int"))))
    names = df.columns
    met = met.withColumn(left, F.least(F.col(size), F.col(taken) - F.col(turn) * F.col(size))).select(*(F.col(f"`{c}`") for c in names), left, size)

    def cut(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            share, whole = columns[left].to_pylist(), columns[size].to_pylist()
            if share != whole:
                texts = [t if a == b else first_words(t, a) for t, a, b in zip(columns[text_col].to_pylist(), share, whole, strict=True)]
                columns[text_col] = pa.array(texts, columns[text_col].type)
                if count_col in columns:
                    columns[count_col] = pa.array([len(t) for t in texts], columns[count_col].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return met.mapInArrow(cut, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "v_finish", "position")


#: The same in DuckDB's SQL.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ 	-
]+')) END AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (
  SELECT *, row_number() OVER o AS k,
    (SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget_left,
    (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, encode(source) NULLS LAST)),
f AS (SELECT min(k) AS k FROM r WHERE budget_left::DOUBLE / weight_left <= 3.0::DOUBLE * source_size / weight),
t AS (
  SELECT source, source_size, CASE WHEN r.k >= f.k THEN weight * (SELECT budget_left::DOUBLE / weight_left FROM r, f WHERE r.k = f.k)
                                   ELSE 3.0::DOUBLE * source_size END AS target
  FROM r, f),
q AS (
  SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT q.*, round, (round * source_size + start)::BIGINT AS begin FROM q, (SELECT unnest([0, 1, 2]) AS round)
  WHERE size > 0 AND target > 0 AND (round * source_size + start)::DOUBLE / target < 1),
v AS (
  SELECT *, (begin + size)::DOUBLE / target AS v_finish,
    CASE WHEN (begin + size)::DOUBLE / target <= 1 THEN size ELSE greatest(0, least(size, floor(target)::BIGINT - begin)) END AS words FROM e),
p AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY v_finish, ord, doc_id, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM v),
g AS (
  SELECT doc_id, source, size, start, sum(words)::BIGINT AS taken, min(v_finish) AS v_finish, min(position) AS position FROM p
  WHERE position < (SELECT sum(source_size) FROM s) GROUP BY ALL)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken, g.v_finish, g.position
FROM q LEFT JOIN g ON q.doc_id IS NOT DISTINCT FROM g.doc_id AND q.source IS NOT DISTINCT FROM g.source AND q.size = g.size AND q.start = g.start
"""
