import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import pii as P


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in P.query(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        want, have = brute.personal_spans(r["text"]), got[r["doc_id"]]
        assert [have[f"n_{k}"] for k in P.BASE] == [sum(s[0] == k for s in want) for k in P.BASE]
        assert have["base_sha256"] == brute.sha(brute.joined(want))
        assert have["spans"].startswith(brute.joined(want))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab@.-_% +()0123459é"), max_size=40))
def test_base_spans_equal_plain_patterns(text):
    assert P.base_spans(text) == brute.personal_spans(text)


def test_long_runs_take_time_in_proportion():
    import time

    began = time.process_time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "a.@-." * 60_000):
        P.base_spans(text)
    assert time.process_time() - began < 20


def corpus(spark, n=400):
    """An address that always stands near one nickname, amid common words."""
    drawn = random.Random(5)
    common = [f"word{'abcdefghij'[i]}" for i in range(10)]
    filler = lambda k: " ".join(drawn.choice(common) for _ in range(k))
    rows = []
    for i in range(n):
        text = filler(30)
        if i % 20 == 0:
            text = f"{filler(5)} zorblax {filler(2)} jo.doe@example.com {filler(9)}"
        elif i % 20 == 1:
            text = f"{filler(7)} +1 (555) 010-{1000 + i} {filler(3)}"
        rows.append((i, text))
    rows.append((n, "later zorblax wrote"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    df = corpus(spark)
    told = {r["term"]: r["kind"] for r in P.disclosing(df).collect()}
    assert told == {"zorblax": "email"}
    # brute force over all pairs of term and entity
    rows = [r["text"] for r in df.collect()]
    import math

    holds = {t: {i for i, x in enumerate(rows) if t in x.split()} for t in {w for x in rows for w in x.split() if w.isalpha()}}
    entity = {i for i, x in enumerate(rows) if "jo.doe@example.com" in x}
    share = {t: math.log2(len(rows) * len(s & entity) / (len(s) * len(entity))) / math.log2(len(rows) / len(entity)) for t, s in holds.items() if s & entity}
    assert {t for t, x in share.items() if x >= P.THRESHOLD} == {"zorblax"}
    for few in (10, 0):  # sent to all tasks, and joined
        found = {r["doc_id"]: r for r in P.find(df, P.disclosing(df), few=few).collect()}
        assert found[400]["sanitised"] == "later [email] wrote" and [tuple(s) for s in found[400]["added"]] == [("term_email", 6, 13)]
        assert "zorblax" not in found[0]["sanitised"] and "[EMAIL]" in found[0]["sanitised"]
        assert len(found) == 401


def test_copies_are_no_evidence(spark):
    rows = [(i, "the odd quaxil lives at me@example.org today") for i in range(50)] + [(100 + i, f"plain text number {i}") for i in range(200)]
    assert P.disclosing(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_edges(spark, odd, empty):
    told = P.disclosing(odd)
    rows = P.digests(odd, told).collect()
    assert len(rows) == odd.count() and {r["spans"] for r in rows} == {""}
    assert P.digests(empty, P.disclosing(empty)).count() == 0
    assert P.sanitise("a b@c.de f", [("email", 2, 8)], []) == "a [EMAIL] f"


def test_rare_entities_disclose_too(spark):
    """Two and three contexts are enough where the entity is rare; one is none, and a common word never is."""
    drawn = random.Random(7)
    filler = lambda k: " ".join(f"word{drawn.choice('abcdefghij')}{drawn.choice('abcdefghij')}" for _ in range(k))
    rows = [(i, filler(20)) for i in range(4000)]
    rows += [(4000 + i, f"{filler(4)} quaxil {filler(2)} two@example.org {filler(5)}") for i in range(2)]
    rows += [(4100 + i, f"{filler(4)} three@example.org zorblax {filler(5)}") for i in range(3)]
    rows += [(4200, f"{filler(4)} once@example.org hapax {filler(5)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["term"]: r["kind"] for r in P.disclosing(df).collect()} == {"quaxil": "email", "zorblax": "email"}


def test_groups_of_copies_lose_nothing(spark):
    """Term and entity stand in the same documents, of four contexts and many copies: all that there is to tell."""
    rows = [(4 * i + k, f"context{'abcd'[k]} quaxil lives at me@example.org today{'abcd'[k]}") for i in range(100) for k in range(4)] + [(1000 + i, f"plain text today of number {i}") for i in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["term"]: r["kind"] for r in P.disclosing(df).collect()} == {"quaxil": "email", "lives": "email", "at": "email"}


def test_a_document_counts_once(spark):
    found = P.mentions("quaxil a1b me@example.org or quaxil b2c me@example.org", window=2)
    assert sum(n for _, w, _, n in found if w == "quaxil") == 1 and len({c for _, w, c, _ in found if w == "quaxil"}) == 2


def plain_disclosing(texts: list[str], window: int = P.WINDOW, alpha: float = P.ALPHA, threshold: float = P.THRESHOLD) -> dict[str, str]:
    """The module's definition over all pairs of a term and an entity, with sets of documents."""
    import math
    import re
    from collections import defaultdict

    holds, stands, near, contexts = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        base = brute.personal_spans(text)
        inside = {x for _, a, b in base for x in range(a, b)}
        words = [(m[0].lower(), m.start()) for m in re.finditer(r"[^\W_]+", text) if len(m[0]) > 1 and not m[0].isdigit() and inside.isdisjoint(range(m.start(), m.end()))]
        for w, _ in words:
            holds[w].add(i)
        for kind, a, b in base:
            value = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            around = [w for w, at in words if at < a][-window:] + [w for w, at in words if at >= a][:window]
            for e in (f"{kind}:{value}", f"{kind}:"):
                stands[e].add(i)
                for w in around:
                    near[w, e].add(i)
                    contexts[w, e].add(tuple(around))
    found, n = defaultdict(set), len(texts)
    for (w, e), both in near.items():
        p, q = len(both) / len(holds[w]), (len(stands[e]) / n) ** (1 - threshold)
        share = 1 - math.log(p) / math.log(len(stands[e]) / n) if len(stands[e]) < n else 0
        if share >= threshold:  # p >= q, in other words
            kl = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
            if len(contexts[w, e]) / p * kl >= math.log(1 / alpha):
                found[w].add(e.split(":")[0])
    return {w: kinds.pop() if len(kinds) == 1 else "any" for w, kinds in found.items()}


def planted(spark, copies: int = 1):
    """The documents of sf0.01 with sixty names planted: some always near one address, some always near ever new ones, some anywhere."""
    drawn = random.Random(11)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    words = [w for t in texts[:50] for w in t.split() if w.isalpha()]
    some = lambda k: " ".join(drawn.choice(words) for _ in range(k))
    guilty = []
    for i in range(40):
        name, kind = f"zo{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'uvwx'[i // 26]}x", i % 2
        guilty.append(name)
        for k in range(6 if kind else 12):
            value = f"{name}@example.org" if kind else f"+1 (555) {100 + i}-{1000 + k}"
            texts.append(f"{some(20)} {name} {some(2)} {value} {some(20)}")
        if kind:
            texts.append(f"{some(20)} {name} {some(20)}")
    for i in range(20):
        texts += [f"{some(30)} ki{'abcdefghijklmnopqrst'[i]}q {some(30)}" for _ in range(6)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts * copies)], "doc_id long, text string"), texts * copies, set(guilty)


def test_whole_table_with_planted_names_equals_brute_force(spark):
    df, texts, guilty = planted(spark)
    told = {r["term"]: r["kind"] for r in P.disclosing(df).collect()}
    assert told == plain_disclosing(texts)
    assert guilty <= told.keys() and len(told) <= 1.1 * len(guilty)  # recall 1; precision
    again, _, _ = planted(spark, 5)
    assert {r["term"]: r["kind"] for r in P.disclosing(again).collect()} == told


def test_repeated_corpora_disclose_the_same(spark):
    df = corpus(spark)
    again = df.unionAll(df).unionAll(df).unionAll(df).unionAll(df)
    assert {r["term"]: r["kind"] for r in P.disclosing(again).collect()} == {r["term"]: r["kind"] for r in P.disclosing(df).collect()} == {"zorblax": "email"}


def test_kinds_disclose_where_values_are_rare(spark):
    rows = [(i, f"some word number {i} of the text") for i in range(2000)] + [(5000 + i, f"write {'abcdefgh'[i]}x to quaxil at you{i}@example.org about {'abcdefgh'[i]}y") for i in range(8)]
    told = {r["term"]: r["kind"] for r in P.disclosing(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert told["quaxil"] == "email" and "of" not in told
