import random

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import simhash


def neighbours(seed, groups=8, size=40, flips=6):
    drawn = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = drawn.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(drawn.randrange(flips)):
                x ^= 1 << drawn.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("front", [1 << 17, 64])
def test_trie_join_equals_all_pairs(seed, front):
    keys = neighbours(seed)
    labels = simhash.trie_join(np.array(keys, np.uint64), np.zeros(len(keys), int), front=front).labels()
    want = brute.components(keys)
    assert [keys[i] for i in labels] == [want[k] for k in keys]


def test_dense_group_keeps_its_links():
    keys = sorted({0x1234 ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(24) for j in range(24) for k in range(24)})
    assert set(simhash.trie_join(np.array(keys, np.uint64), np.zeros(len(keys), int)).labels()) == {0}


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_of_any_cell_size(spark, limit):
    keys = neighbours(9, groups=10, size=30)
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "fp long")
    links = simhash.links(df, limit=limit)
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(links).collect()}
    want = brute.components(keys)
    groups = lambda d: sorted(sorted(k for k in keys if d.get(k, k) == v) for v in {d.get(k, k) for k in keys})
    assert groups(found) == groups(want)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, table):
    path = f"/root/testdata/{table}"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, path).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_copies_are_linked(spark):
    drawn = random.Random(2)
    base = [f"w{drawn.randrange(5000)}" for _ in range(4000)]
    rows = [(i, " ".join(w if drawn.random() > 0.0005 else "x" for w in base)) for i in range(30)] + [(100 + i, " ".join(f"v{drawn.randrange(5000)}" for _ in range(300))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == brute.near_duplicates(rows)
    assert len({c for i, (_, c) in got.items() if i < 100}) < 30
    kept = [r["doc_id"] for r in simhash.one_of_each(df).collect()]
    assert sorted(kept) == sorted({c for _, c in got.values()})


def test_edges(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["fp"], r["component_id"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, 1)}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("one") == 1 and sum(t in (None, "", "   \n\t ") for t in texts) == 1 and "no id here but some words" in texts
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "x y z w"), (2, "x y z w")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.one_of_each(twice).collect()) == [(1, "a b c d"), (1, "x y z w")]
