"""Queries that do their work on the whole table, not on chosen records of it."""

import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["src_memo", "src_memo_net", "surf_memo", "dml_memocompact", "snk_memofile"])
def test_every_memo(spark, name):
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()}
    assert got.keys() == want.keys()
    for key, text in want.items():
        row = got[key]
        assert row.get("text", text) == text and row.get("n", len(text)) == len(text) and row.get("assigned", f"{text}!") == f"{text}!"


def test_every_row_is_sorted(spark):
    rows = [(r["l_orderkey"], r["l_linenumber"], r["l_extendedprice"]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()]
    rows.sort(key=lambda r: (-r[2], r[0], r[1]))
    got = sorted(catalog.QUERIES["sort_api"](spark, SF).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r["l_orderkey"], r["l_linenumber"], r["l_extendedprice"]) for r in got] == rows
