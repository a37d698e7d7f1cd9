"""What remains of the exported surface: structure, tags, relations' life cycle, snapshots, statuses and errors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators import dml
from ..operators.relation import Relation
from ..operators.table import RECNO, Tag
from ..sources import cdx, files
from .changes import CUSTOMERS, customer, folder, shown
from .joins import OC, out
from .registry import query, table
from .scans import by_customer, by_name, orders_out


def _floats(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return replace(t, df=t.df.withColumns({"fs": F.col("p_size").cast("float"), "fp": F.col("p_retailprice").cast("float"), "fz": F.lit(0).cast("float")}))


def _float_query(name: str, expressions: dict[str, tuple[str, str]]) -> None:
    def run(spark, sf_dir):
        t = _floats(spark, sf_dir)
        return t.df.select("p_partkey", *(t.expr(e).alias(n) for n, (e, _) in expressions.items()))

    query(name, f"SELECT p_partkey, {', '.join(f'({s})::FLOAT AS {n}' for n, (_, s) in expressions.items())} FROM part")(run)


_float_query("op_add_flt", {"a": ("fs + fp", "p_size::FLOAT + p_retailprice::FLOAT")})
_float_query("op_sub_flt", {"a": ("fp - fs", "p_retailprice::FLOAT - p_size::FLOAT")})
_float_query("op_mul_flt", {"a": ("fs * fs", "p_size::FLOAT * p_size::FLOAT")})
_float_query("op_div_flt", {"a": ("fs / fz", "0"), "b": ("fp / fs", "CASE WHEN p_size = 0 THEN 0 ELSE p_retailprice::FLOAT::DOUBLE / p_size END")})


@query("scan_tagsync", "SELECT k AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS k FROM orders) WHERE o_orderkey = 99")
def scan_tagsync(spark, sf_dir):
    """The place of one record in a tag: the entries up to it are counted, nothing is sorted."""
    t = by_customer(spark, sf_dir)
    start = t.entries().filter(F.col(RECNO) == 100)
    return t._beyond(start, None, True).agg((F.count(F.lit(1)) + 1).alias("place"))


@query("src_readbuf", "SELECT count(*) AS n, round(sum(l_extendedprice), 0) AS total FROM lineitem")
def src_readbuf(spark, sf_dir):
    """A batch-wise scan; Parquet's columnar reader is the buffer."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("total"))


@query("src_memo_net", "SELECT doc_id, text, strlen(text)::BIGINT AS n_bytes, 'M' AS kind FROM documents")
def src_memo_net(spark, sf_dir):
    """Memos as text, with their length in bytes and their type."""
    return table(spark, sf_dir, "documents").df.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.lit("M").alias("kind"))


@query("src_index", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand DESC, p_partkey DESC) AS place FROM part WHERE p_size > 10")
def src_index(spark, sf_dir):
    """Tags of an index file, written and opened again; one of them is walked."""
    cdx.write_definitions(path := f"{folder(spark)}/part.cdx", [Tag("NAME", "p_name"), Tag("BRAND", "p_brand", "p_size > 10", descending=True)])
    t = cdx.with_index(table(spark, sf_dir, "part"), path)
    return t.sequenced("BRAND", "place").select("p_partkey", "place")


@query("tag_remove", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place, 1 AS tags FROM orders")
def tag_remove(spark, sf_dir):
    """The order of the tag that is left when another one, which was selected, is removed."""
    t = by_customer(spark, sf_dir).with_tag(Tag("price", "o_totalprice")).select_tag("price").without_tag("price")
    return t.sequenced("cust", "place").select("o_orderkey", "place", F.lit(len(t.tags)).alias("tags"))


REINDEXED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders WHERE o_totalprice > 1000"


def _reindexed(spark, sf_dir):
    """A tag is a view, so after a change its order is that of the changed records."""
    t = by_customer(spark, sf_dir)
    t = dml.pack(dml.delete(t, ".NOT. o_totalprice > 1000"))
    return t.sequenced(place="place").select("o_orderkey", "place")


query("dml_reindex", REINDEXED)(_reindexed)


@query("tag_reindex", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_custkey < 500 THEN o_totalprice * 2 ELSE o_totalprice END, o_orderkey) AS place FROM orders")
def tag_reindex(spark, sf_dir):
    """One tag, whose keys are changed in many records: its order is that of the new keys."""
    t = by_customer(spark, sf_dir).with_tag(Tag("price", "o_totalprice"))
    t = dml.update(t, "o_custkey < 500", {"o_totalprice": "o_totalprice * 2"})
    return t.sequenced("price", "place").select("o_orderkey", "place")


@query("dml_memocompact", "SELECT doc_id, left(text, 5) AS head, length(text) AS n FROM documents")
def dml_memocompact(spark, sf_dir):
    """Memos stored anew after a change take the room of their values alone, which stay the same."""
    files.write_table(dml.pack(table(spark, sf_dir, "documents")), path := folder(spark))
    return files.read_table(spark, path, "documents").df.select("doc_id", F.substring("text", 1, 5).alias("head"), F.length("text").cast("long").alias("n"))


@query("ddl_remove", "SELECT 1 AS before, 0 AS after")
def ddl_remove(spark, sf_dir):
    """A stored table before and after its removal."""
    parent = folder(spark)
    files.write_table(customer(spark, sf_dir), f"{parent}/gone.parquet")
    before = files.list_tables(spark, parent).count()
    files.remove_table(spark, f"{parent}/gone.parquet")
    return spark.createDataFrame([(before, files.list_tables(spark, parent).count())], "before int, after int")


def _skipping(spark, sf_dir):
    from .joins import _orders_to_customers

    return _orders_to_customers(spark, sf_dir, "skip")


MATCHED = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0"


@query("rel_load", MATCHED + " WHERE c_name > 'Customer#0000001'")
def rel_load(spark, sf_dir):
    """A definition loaded with its filter on a slave."""
    r = _skipping(spark, sf_dir).query("customer->c_name > 'Customer#0000001'")
    return out(Relation.load(r.save(), {n.alias: n.table for n in r.nodes}).composites(), **OC)


@query("rel_lock", MATCHED)
def rel_lock(spark, sf_dir):
    """A relation on a snapshot of its composites."""
    return out(_skipping(spark, sf_dir).lock().composites(), **OC)


@query("rel_free", MATCHED)
def rel_free(spark, sf_dir):
    """A relation goes on after what it kept is freed."""
    r = _skipping(spark, sf_dir).retain()
    r.count()
    return out(r.free().composites(), **OC)


@query("rel_changed", MATCHED + " WHERE o_totalprice > 200000")
def rel_changed(spark, sf_dir):
    """A changed filter takes effect although composites were kept."""
    r = _skipping(spark, sf_dir).retain()
    r.count()
    return out(r.query("o_totalprice > 200000").composites(), **OC)


@query("fn_totalref", "SELECT l_returnflag, round(sum(l_quantity) - avg(l_quantity) * count(*), 2) + 1 AS x FROM lineitem GROUP BY 1")
def fn_totalref(spark, sf_dir):
    """Totals referred to by name in an expression."""
    from ..operators.report import Group, Report, Total
    from ..operators.table import Table

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity", F.lit(0).cast("long").alias("_seq"))
    totals = [Total("S", "sum", F.col("l_quantity"), "f"), Total("A", "average", F.col("l_quantity"), "f"), Total("N", "count", None, "f")]
    got = Report(rows, [Group("f", F.col("l_returnflag"))], totals, sorted_by_groups=True).table("f", ["l_returnflag"])
    t = Table.of(got.withColumnRenamed("_seq", RECNO), "t")
    x = t.compiler(totals={n: F.col(n) for n in "SAN"}).compile("S - A * N").column
    return t.df.select("l_returnflag", (F.round(x, 2) + 1).alias("x"))


@query("txn_start", f"SELECT *, false AS deleted FROM ({CUSTOMERS})")
def txn_start(spark, sf_dir):
    """Changes inside a transaction don't touch the table from which it began."""
    t = dml.start(customer(spark, sf_dir))
    dml.delete(t, "c_nationkey = 1")
    return shown(t)


@query("buf_flush", f"SELECT *, c_nationkey = 2 AS deleted FROM ({CUSTOMERS})")
def buf_flush(spark, sf_dir):
    """Changes written out and read again."""
    files.write_table(dml.delete(customer(spark, sf_dir), "c_nationkey = 2"), path := folder(spark))
    return shown(files.read_table(spark, path, "customer"))


@query("buf_refresh", "SELECT count(*) AS before, count(*) FILTER (WHERE c_nationkey <> 1) AS after FROM customer")
def buf_refresh(spark, sf_dir):
    """A table overwritten by another writer, read before and after."""
    path = folder(spark)
    files.write_table(customer(spark, sf_dir), path)
    before = files.read_table(spark, path, "customer").record_count()
    files.write_table(customer(spark, sf_dir).filter("c_nationkey <> 1"), path, mode="overwrite")
    spark.catalog.refreshByPath(path)
    return spark.createDataFrame([(before, files.read_table(spark, path, "customer").record_count())], "before long, after long")


@query("surf_tagprop", "SELECT 'o_custkey' AS key, 'o_totalprice > 0' AS filter, false AS descending, 'machine' AS collation, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders WHERE o_totalprice > 0")
def surf_tagprop(spark, sf_dir):
    """A tag's definition, and how many entries and keys it has."""
    t = by_customer(spark, sf_dir, filter="o_totalprice > 0")
    tag = t.tag()
    held = t.entries().agg(F.count(F.lit(1)).alias("n"), F.countDistinct(t.key(tag).column).alias("keys"))
    return held.select(F.lit(tag.key).alias("key"), F.lit(tag.filter).alias("filter"), F.lit(tag.descending).alias("descending"), F.lit(tag.collation).alias("collation"), "n", "keys")


@query("surf_tagnext", "SELECT 1 AS place, 'cust' AS name, false AS selected, arg_min(o_orderkey, (o_custkey, o_orderkey)) AS first FROM orders UNION ALL SELECT 2, 'price', true, arg_min(o_orderkey, (o_totalprice, o_orderkey)) FROM orders")
def surf_tagnext(spark, sf_dir):
    """Tags one after another, which is selected, and the first record of each."""
    t = by_customer(spark, sf_dir).with_tag(Tag("price", "o_totalprice")).select_tag("price")
    parts = [t.top(n).select(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(n == t.selected).alias("selected"), F.col("o_orderkey").alias("first")) for i, n in enumerate(t.tags, 1)]
    return parts[0].unionAll(parts[1])


@query("surf_batchw", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS recno FROM (SELECT c_custkey, c_name FROM customer UNION ALL SELECT 1000000000 + i, 'NEW' FROM range(50) t(i))")
def surf_batchw(spark, sf_dir):
    """Many records appended in one go."""
    new = spark.range(50).selectExpr("1000000000 + id AS c_custkey", "'NEW' AS c_name", "0 AS c_nationkey")
    return dml.append(customer(spark, sf_dir), new, ["c_custkey"]).df.select("c_custkey", "c_name", F.col(RECNO).alias("recno"))


@query("surf_status", "SELECT * FROM (VALUES ('exact', 'found'), ('between', 'after'), ('beyond', 'eof'), ('skip', 'eof'), ('back', 'bof'), ('absent', 'no record')) t(what, status)")
def surf_status(spark, sf_dir):
    """Statuses of seeks and skips."""
    t = by_name(spark, sf_dir)
    last, first = t.bottom().first()[RECNO], t.top().first()[RECNO]
    told = [("exact", t.seek("red")[0]), ("between", t.seek("m!")[0]), ("beyond", t.seek("~")[0]), ("skip", t.skip(last, 1)[0]), ("back", t.skip(first, -1)[0]), ("absent", t.skip(1 << 40, 0)[0])]
    return spark.createDataFrame([(w, s.value) for w, s in told], "what string, status string")


@query("surf_err", "SELECT * FROM (VALUES ('field', 'no field'), ('tag', 'no tag'), ('function', 'unknown function'), ('syntax', 'syntax'), ('unique', 'duplicate key'), ('type', 'type')) t(what, code)")
def surf_err(spark, sf_dir):
    """Codes of typed errors."""
    t = by_customer(spark, sf_dir)
    tries = {
        "field": lambda: t.field("none"), "tag": lambda: t.select_tag("none"), "function": lambda: t.expr("LOWER(o_orderstatus)"), "syntax": lambda: t.expr("1 +"),
        "unique": lambda: t.with_tag(Tag("u", "o_custkey", unique="error")), "type": lambda: t.expr("o_orderstatus + 1"),
    }
    found = []
    for what, attempt in tries.items():
        try:
            attempt()
        except EngineError as e:
            found.append((what, e.code))
    return spark.createDataFrame(found, "what string, code string")


@query("surf_direct", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (9, 99, 999)")
def surf_direct(spark, sf_dir):
    """Records fetched by their numbers, in one scan."""
    return orders_out(table(spark, sf_dir, "orders").df.filter(F.col(RECNO).isin(10, 100, 1000)))


@query("surf_opt", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def surf_opt(spark, sf_dir):
    """A table kept in memory for several uses."""
    t = table(spark, sf_dir, "orders", widths=False).optimised()
    t.record_count()
    return t.filter("o_totalprice > 1000").df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))
