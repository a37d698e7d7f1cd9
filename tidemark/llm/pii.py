"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

Protected entities are the values of the base patterns (email, ip, card, phone; see BASE), and each kind as a whole, through which
values of few mentions disclose: who is always near addresses gives one away, even if no two are equal.  The corpus tells how
strongly a term t reveals an entity e: the point-wise mutual information of their occurrence in documents,
log2(N c(t,e) / (c(t) c(e))), as a share of the entity's whole information log2(N / c(e)).  Terms are words within
``window`` words of a mention.  All counts are documents, copies included; how sure the share is depends on the number of
different contexts of a pair, so that copies of a document are no evidence.
The share is bounded from below: it reaches ``threshold`` where c(t,e) / c(t) reaches q = (c(e) / N)^(1 - threshold), and by
Chernoff's bound k different contexts show that with confidence 1 - ``alpha`` if k/p KL(p || q) >= ln(1 / alpha), p being
the observed c(t,e) / c(t).  So a rare entity needs no fixed number of contexts, but fewer the more information it has.
A term that discloses at least ``threshold`` of an entity is sanitised
wherever it stands: generalised to the entity's kind if all that it discloses is of one kind, else removed.

Scale: all corpus statistics are aggregated over all documents, with partial counts before the shuffle; what is shuffled
are words and counts, not texts.  The disclosing terms go to all tasks while there are at most ``few``; beyond that, the
documents' terms are joined with them instead, with the same result.

Base spans are leftmost and non-overlapping per kind and always kept.  Added spans have the kind ``term_`` and the
entity's kind, or ``term_any``, and never overlap a base span.

Edge cases: null texts count as empty.  A corpus without entities has no added spans.  Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialise, prepare, read

# Kinds in their order and the patterns. Where a pattern could start inside a run of its own first
# characters, the run's start is the leftmost; the look-behinds say so and keep time proportional to length.
BASE = ("email", "ip", "card", "phone")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")

WINDOW, ALPHA, THRESHOLD, FEW = 8, 0.05, 0.8, 100_000
WORD = re.compile(r"[^\W_]+")
_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the at signs."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LEFT:
            start -= 1
        m = EMAIL_RIGHT.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind and start. A match that fails its check is dropped and not tried again shorter."""
    found = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):  # every other kind has one
        return found
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def entity(kind: str, value: str) -> str:
    """An entity's name: its kind and its value without punctuation and case."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def terms(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Words of two or more letters, lower case, outside the taken spans."""
    if not taken:
        return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text) if m.end() - m.start() > 1 and not m[0].isdigit()]
    spans, found, k = sorted((a, b) for _, a, b in taken), [], 0
    reach = 0  # the furthest end of the spans that start before the word's end
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if m.start() >= reach and m.end() - m.start() > 1 and not m[0].isdigit():
            found.append((m[0].lower(), m.start(), m.end()))
    return found


def entities(base: list[tuple[str, int, int]], text: str) -> set[str]:
    """The entities of a text: values, and kinds as a whole."""
    return {entity(k, text[a:b]) for k, a, b in base} | {whole(k) for k, _, _ in base}


def whole(kind: str) -> str:
    """The name of a kind as a whole; no value is empty."""
    return f"{kind}:"


def mentions(text: str, window: int = WINDOW, kinds: bool = False) -> list[tuple[str, str, str, int]]:
    """(entity, term, context, n) of the terms near each entity, and if asked near its kind as a whole; a context is named by its own terms. n is 1 once a pair, else 0."""
    base = base_spans(text)
    if not base:
        return []
    words = terms(text, base)
    starts = [w[1] for w in words]
    from bisect import bisect_left

    found, met = [], set()
    for kind, a, b in base:
        i = bisect_left(starts, a)
        near = words[max(0, i - window) : i + window]
        context = hashlib.blake2b(" ".join(w[0] for w in near).encode(), digest_size=8).hexdigest()
        for name in (entity(kind, text[a:b]), whole(kind)) if kinds else (entity(kind, text[a:b]),):
            for w in {w[0] for w in near}:
                found.append((name, w, context, int((name, w) not in met)))
                met.add((name, w))
    return found


def disclosing(df: DataFrame, text_col: str = "text", window: int = WINDOW, alpha: float = ALPHA, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (term, kind): the terms that disclose a protected entity, and its kind ('any' if of several kinds). Materialised."""
    prepare(df.sparkSession)

    def pairs():
        def work(texts):
            rows = [x for t in texts for x in mentions(t or "", window, kinds=True)]
            return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [], [])

        return work

    def frequencies():
        def work(texts):
            # documents of the batch by term; entities are counted like terms, by their own names
            count: Counter[str] = Counter()
            for t in texts:
                t = t or ""
                base = base_spans(t)
                if base:
                    count.update({w[0] for w in terms(t, base)})
                    count.update(entities(base, t))
                else:
                    count.update({w.lower() for w in set(WORD.findall(t)) if len(w) > 1 and not w.isdigit()})
            return list(count), list(count.values())

        return work

    near = map_columns(df, [text_col], "entity string, term string, context string, n long", pairs)
    # One row per pair and context, then per pair.
    near = near.groupBy("entity", "term", "context").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("together"))
    # What can't pass even if the term stands nowhere else and the entity in one document needs no counts.
    total, needed = df.count(), math.log(1 / alpha)
    near = materialise(near.filter(F.col("contexts") * ((1 - threshold) * math.log(max(total, 1))) >= needed))
    counted = map_columns(df, [text_col], "name string, n long", frequencies).groupBy("name").agg(F.sum("n").alias("n"))
    names = near.select(F.col("term").alias("name")).unionAll(near.select(F.col("entity").alias("name"))).distinct()
    counted = materialise(counted.join(names, "name", "left_semi"))
    of_term = counted.select(F.col("name").alias("term"), F.col("n").alias("n_term"))
    of_entity = counted.select(F.col("name").alias("entity"), F.col("n").alias("n_entity"))
    both = near.join(of_term, "term").join(of_entity, "entity")
    p = F.col("together") / F.col("n_term")
    q = F.pow(F.col("n_entity") / total, F.lit(1 - threshold))
    # KL(p || q) / p
    surprise = F.log(p / q) + F.when(p < 1, (1 - p) / p * F.log((1 - p) / (1 - q))).otherwise(0)
    told = both.filter((F.col("n_entity") < total) & (p >= q) & (F.col("contexts") * surprise >= needed)).withColumn("kind", F.substring_index("entity", ":", 1))
    return materialise(told.groupBy("term").agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("any").alias("kind")))


def spans_of(text: str | None, known: dict[str, str]) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and those of the known terms."""
    text = text or ""
    base = base_spans(text)
    return base, [(f"term_{known[w]}", a, b) for w, a, b in terms(text, base) if w in known] if known else []


def ordered(base: list[tuple], added: list[tuple]) -> list[tuple]:
    """By kind as listed and then those of terms, then start."""
    return sorted(base + added, key=lambda s: (BASE.index(s[0]) if s[0] in BASE else len(BASE), s[0], s[1]))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sanitise(text: str, base: list[tuple], added: list[tuple]) -> str:
    """Entities become their kind's name; terms that disclose one kind become 'a' and the kind, others go."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + added):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at or kind in BASE:
            out.append("" if kind == "term_any" else f"[{kind.removeprefix('term_')}]" if kind.startswith("term_") else f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


SPANS = "array<struct<kind: string, start: int, end: int>>"


def _applied(df: DataFrame, told: DataFrame, id_col: str, text_col: str, few: int, schema: str, row) -> DataFrame:
    """One row a document: id and row(text, base spans, added spans).

    told are the disclosing terms; up to few of them go to every task, more are joined with the documents' terms.
    """
    spark = df.sparkSession
    prepare(spark)
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, {schema}"

    def rows(keys, texts, known_of):
        return keys, *map(list, zip(*(row(t, *spans_of(t, k)) for t, k in zip(texts, known_of, strict=True)), strict=True))

    head = told.limit(few + 1).collect()
    if len(head) <= few:
        sent = spark.sparkContext.broadcast({r["term"]: r["kind"] for r in head})
        return map_columns(df, [id_col, text_col], schema, lambda: lambda keys, texts: rows(keys, texts, [sent.value] * len(keys)))

    # Each document gets its own disclosing terms, whose number is bounded by its text; rows of equal texts share them.
    texts = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))

    def own():
        def work(digests, some):
            pairs = [(d, w) for d, t in zip(digests, some, strict=True) for w in {x[0] for x in terms(t, base_spans(t))}]
            return tuple(map(list, zip(*pairs, strict=True))) if pairs else ([], [])

        return work

    met = map_columns(texts, ["digest", "text"], "digest string, term string", own).join(told, "term").distinct()
    met = met.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("known"))
    with_terms = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("digest_"))
    with_terms = with_terms.join(met.withColumnRenamed("digest", "digest_"), "digest_", "left")
    return map_columns(with_terms, [id_col, text_col, "known"], schema, lambda: lambda keys, some, known: rows(keys, some, [dict(k or []) for k in known]))


def find(df: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """One row a document: id, base and added (arrays of kind, start, end), sanitised (the text; null stays null)."""

    def row(text, base, added):
        form = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return form(base), form(added), None if text is None else sanitise(text, base, added)

    return _applied(df, told, id_col, text_col, few, f"base {SPANS}, added {SPANS}, sanitised string", row)


def digests(df: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """One row a document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (all), of the spans that find() tells."""

    def row(text, base, added):
        return *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(ordered(base, [])).encode()).hexdigest(), joined(ordered(base, added)), len(added), len(base) + len(added)

    return _applied(df, told, id_col, text_col, few, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long", row)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return digests(docs, disclosing(docs))
