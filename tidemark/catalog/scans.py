"""Scans, navigation, seeks, tags, record sets, filters, projections and sorts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.recordset import RecordSet
from ..operators.relation import Relation
from ..operators.table import DELETED, RECNO, Tag
from ..plans.sequence import numbered
from .registry import query, recno, table

ORDERS = "SELECT *, row_number() OVER (ORDER BY o_orderkey) AS recno FROM orders"
PICK = "o_orderkey, o_custkey, o_totalprice"


def by_customer(spark, sf_dir, **options):
    """Orders with a tag on the customer's number."""
    t = table(spark, sf_dir, "orders")
    return t.with_tag(Tag("cust", "o_custkey", **options)).select_tag("cust")


def by_name(spark, sf_dir, **options):
    t = table(spark, sf_dir, "part")
    return t.with_tag(Tag("name", "p_name", **options)).select_tag("name")


def orders_out(df):
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


def parts_out(df):
    return df.select("p_partkey", "p_name")


# Scans.


@query("scan_open", "SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) AS recno FROM region")
def scan_open(spark, sf_dir):
    return table(spark, sf_dir, "region").df.select("r_regionkey", "r_name", F.col(RECNO).alias("recno"))


@query("scan_open_net", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_open_net(spark, sf_dir):
    return table(spark, sf_dir, "nation").df.drop(RECNO, DELETED)


@query("scan_clone", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def scan_clone(spark, sf_dir):
    """The same table under two names, joined."""
    a = table(spark, sf_dir, "nation")
    r = Relation(a)
    r.slave(a.clone("b").with_tag(Tag("region", "n_regionkey")), "n_regionkey", "region", type="scan", action="skip")
    r.query("nation->n_nationkey < b->n_nationkey")
    return r.composites().select(F.col("nation__n_nationkey").alias("a"), F.col("b__n_nationkey").alias("b"))


@query("scan_dir", "SELECT unnest(['region', 'nation', 'orders', 'lineitem']) AS name")
def scan_dir(spark, sf_dir):
    """The tables of a directory, as a table."""
    from ..sources.files import list_tables

    return list_tables(spark, sf_dir).filter("name IN ('region', 'nation', 'orders', 'lineitem')").select("name")


@query("scan_top", f"SELECT {PICK} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1")
def scan_top(spark, sf_dir):
    return orders_out(by_customer(spark, sf_dir).top())


@query("scan_bottom", f"SELECT {PICK} FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1")
def scan_bottom(spark, sf_dir):
    return orders_out(by_customer(spark, sf_dir).bottom())


@query("scan_skip", f"SELECT {PICK} FROM (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS k FROM orders) WHERE k = 6 + (SELECT k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS k FROM orders) WHERE o_orderkey = 99)")
def scan_skip(spark, sf_dir):
    return orders_out(by_customer(spark, sf_dir).skip(100, 6)[1])


@query("scan_go", f"SELECT {PICK} FROM ({ORDERS}) WHERE recno = 42")
def scan_go(spark, sf_dir):
    return orders_out(table(spark, sf_dir, "orders").go(42))


@query("scan_go_eof", "SELECT 0::BIGINT AS o_orderkey, 0::BIGINT AS o_custkey, 0.0::DOUBLE AS o_totalprice, '' AS o_orderstatus")
def scan_go_eof(spark, sf_dir):
    return table(spark, sf_dir, "orders").go_eof().select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("scan_pos", "SELECT p_partkey, percent_rank() OVER (ORDER BY p_name, p_partkey) AS position FROM part")
def scan_pos(spark, sf_dir):
    return by_name(spark, sf_dir).position().select("p_partkey", "position")


@query("scan_posset", "SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_name, p_partkey) AS k FROM part) WHERE k = ceil(0.25 * (SELECT count(*) FROM part))")
def scan_posset(spark, sf_dir):
    return parts_out(by_name(spark, sf_dir).position_set(0.25))


@query("scan_count", "SELECT count(*) AS n FROM lineitem")
def scan_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n"))


@query("scan_order", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part")
def scan_order(spark, sf_dir):
    t = by_name(spark, sf_dir)
    return t.sequenced(place="place", columns=[F.col("p_partkey"), F.col("p_name")])


@query("scan_order_net", "SELECT p_partkey, row_number() OVER (ORDER BY p_name DESC, p_partkey DESC) AS place FROM part")
def scan_order_net(spark, sf_dir):
    """The order walked from its last entry."""
    t = by_name(spark, sf_dir)
    return t.sequenced(place="place", reverse=True, columns=[F.col("p_partkey")])


@query("src_seq", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def src_seq(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("src_memo", "SELECT doc_id, text FROM documents")
def src_memo(spark, sf_dir):
    """Memos of all records."""
    return table(spark, sf_dir, "documents").df.select("doc_id", "text")


# Seeks.


@query("seek_str", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') ORDER BY p_name, p_partkey LIMIT 1")
def seek_str(spark, sf_dir):
    return parts_out(by_name(spark, sf_dir).seek("red")[1])


@query("seek_n", "SELECT p_partkey, p_name FROM part WHERE rpad(p_name, 20, ' ') > 'm' ORDER BY p_name, p_partkey LIMIT 1")
def seek_n(spark, sf_dir):
    """A miss lands on the next entry."""
    return parts_out(by_name(spark, sf_dir).seek("m!")[1])


@query("seek_dbl", f"SELECT {PICK} FROM orders WHERE o_custkey >= 77 ORDER BY o_custkey, o_orderkey LIMIT 1")
def seek_dbl(spark, sf_dir):
    return orders_out(by_customer(spark, sf_dir).seek(77.0)[1])


@query("seek_i8", f"SELECT {PICK} FROM orders WHERE o_custkey >= 31 ORDER BY o_custkey, o_orderkey LIMIT 1")
def seek_i8(spark, sf_dir):
    return orders_out(by_customer(spark, sf_dir).seek(31)[1])


NEXT = "SELECT {pick} FROM orders WHERE o_custkey = 77 AND o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 77) ORDER BY o_orderkey LIMIT 1"


def _next(spark, sf_dir, value):
    """The second of a key, from the first."""
    t = by_customer(spark, sf_dir)
    first = t.seek_exact(value).first()
    return orders_out(t.seek_next(value, first[RECNO]) if first else t.df.limit(0))


query("seek_next_dbl", NEXT.format(pick=PICK))(lambda s, d: _next(s, d, 77.0))
query("seek_next_i8", NEXT.format(pick=PICK))(lambda s, d: _next(s, d, 77))


@query("seek_next", "SELECT p_partkey, p_name FROM part WHERE p_name = 'red ring' ORDER BY p_partkey LIMIT 1 OFFSET 1")
def seek_next(spark, sf_dir):
    t = by_name(spark, sf_dir)
    first = t.seek_exact("red ring").first()
    return parts_out(t.seek_next("red ring", first[RECNO]) if first else t.df.limit(0))


@query("seek_next_n", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') ORDER BY p_name, p_partkey LIMIT 1 OFFSET 2")
def seek_next_n(spark, sf_dir):
    """The third entry of a prefix."""
    return parts_out(by_name(spark, sf_dir).seek_nth("small", 3, prefix=True))


@query("seek_exact", "SELECT p_partkey, p_name FROM part WHERE p_name = 'red ring' ORDER BY p_partkey LIMIT 1")
def seek_exact(spark, sf_dir):
    return parts_out(by_name(spark, sf_dir).seek_exact("red ring"))


@query("seek_prefix", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'sm') ORDER BY p_name, p_partkey LIMIT 1")
def seek_prefix(spark, sf_dir):
    return parts_out(by_name(spark, sf_dir).seek_prefix("sm"))


@query("seek_ge", f"SELECT {PICK} FROM orders WHERE o_custkey >= 50 ORDER BY o_custkey, o_orderkey LIMIT 1")
def seek_ge(spark, sf_dir):
    return orders_out(by_customer(spark, sf_dir).seek_at_or_after(50))


@query("seek_le", f"SELECT {PICK} FROM orders WHERE o_custkey <= 50 ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1")
def seek_le(spark, sf_dir):
    return orders_out(by_customer(spark, sf_dir).seek_at_or_before(50))


@query("seek_step", f"SELECT {PICK} FROM orders WHERE o_custkey = 77 ORDER BY o_orderkey DESC LIMIT 1 OFFSET 1")
def seek_step(spark, sf_dir):
    """The last but one of a key."""
    return orders_out(by_customer(spark, sf_dir).seek_nth(77, -2))


@query("seek_tag", f"SELECT {PICK} FROM orders WHERE o_custkey = 77")
def seek_tag(spark, sf_dir):
    """All entries of a key; the equality reaches the scan."""
    return orders_out(by_customer(spark, sf_dir).entries().filter("o_custkey = 77"))


@query("seek_go", f"SELECT {PICK} FROM ({ORDERS}) WHERE o_custkey = (SELECT o_custkey FROM ({ORDERS}) WHERE recno = 10) AND recno = 10")
def seek_go(spark, sf_dir):
    t = by_customer(spark, sf_dir)
    key = t.go(10).first()["o_custkey"]
    return orders_out(t.seek_entry(key, 10))


@query("seek_many", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def seek_many(spark, sf_dir):
    """Seeks of all customers' numbers at once."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return by_customer(spark, sf_dir).seek_many(keys, "c_custkey").select("c_custkey", "o_orderkey")


@query("tag_walk", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def tag_walk(spark, sf_dir):
    t = by_customer(spark, sf_dir)
    return t.sequenced(place="place", columns=[F.col("o_orderkey")])


# Tags.


@query("tag_count", "SELECT count(*) AS records, count(DISTINCT o_custkey) AS entries FROM orders")
def tag_count(spark, sf_dir):
    t = by_customer(spark, sf_dir, unique="continue")
    return t.df.agg(F.count(F.lit(1)).alias("records")).crossJoin(t.entries().agg(F.count(F.lit(1)).alias("entries")))


@query("tag_expr", "SELECT p_partkey, row_number() OVER (ORDER BY upper(p_type), p_brand, p_partkey) AS place FROM part")
def tag_expr(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "part")).sort("UPPER(p_type) + p_brand")
    return r.sequenced("place", [F.col("part__p_partkey").alias("p_partkey")])


@query("tag_filter", "SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def tag_filter(spark, sf_dir):
    return parts_out(by_name(spark, sf_dir, filter="p_size > 25").entries())


@query("tag_desc", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey DESC) AS place FROM orders")
def tag_desc(spark, sf_dir):
    t = by_customer(spark, sf_dir, descending=True)
    return t.sequenced(place="place", columns=[F.col("o_orderkey")])


@query("tag_unique_cont", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def tag_unique_cont(spark, sf_dir):
    return by_customer(spark, sf_dir, unique="continue").entries().select("o_custkey", "o_orderkey")


@query("tag_unique_err", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def tag_unique_err(spark, sf_dir):
    """The keys for which a unique tag refuses the table."""
    return by_customer(spark, sf_dir).duplicates("cust")


@query("tag_uniqueset", "SELECT count(*) AS before, count(DISTINCT o_custkey) AS after FROM orders")
def tag_uniqueset(spark, sf_dir):
    t = by_customer(spark, sf_dir)
    return t.entries().agg(F.count(F.lit(1)).alias("before")).crossJoin(t.set_unique("cust", "continue").entries().agg(F.count(F.lit(1)).alias("after")))


@query("tag_collate", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def tag_collate(spark, sf_dir):
    """A collation that ignores case and accents."""
    t = by_name(spark, sf_dir, collation="general")
    return t.sequenced(place="place", columns=[F.col("p_partkey")])


@query("tag_nullkey", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END NULLS FIRST, o_orderkey) AS place FROM orders")
def tag_nullkey(spark, sf_dir):
    """Null keys come first."""
    t = table(spark, sf_dir, "orders")
    t = replace(t, df=t.df.withColumn("k", F.expr("IF(o_custkey % 3 = 0, NULL, o_custkey)"))).with_tag(Tag("k", "k")).select_tag("k")
    return t.sequenced(place="place", columns=[F.col("o_orderkey")])


@query("tag_add", "SELECT 'cust' AS name, 'o_custkey' AS key UNION ALL SELECT 'price', 'o_totalprice'")
def tag_add(spark, sf_dir):
    """Tags after adding two and removing a third."""
    t = by_customer(spark, sf_dir).with_tag(Tag("price", "o_totalprice")).with_tag(Tag("date", "o_date")).without_tag("date")
    return spark.createDataFrame([(x.name, x.key) for x in t.tags.values()], "name string, key string")


@query("surf_taginfo", "SELECT 'cust' AS name, 'o_custkey' AS key, 'o_totalprice > 0' AS filter, true AS descending, 'continue' AS uniqueness")
def surf_taginfo(spark, sf_dir):
    t = by_customer(spark, sf_dir, filter="o_totalprice > 0", descending=True, unique="continue")
    return spark.createDataFrame([(x.name, x.key, x.filter, x.descending, x.unique) for x in t.tags.values()], "name string, key string, filter string, descending boolean, uniqueness string")


@query("surf_tagpos", "SELECT o_orderkey, percent_rank() OVER (ORDER BY o_custkey, o_orderkey) AS position FROM orders")
def surf_tagpos(spark, sf_dir):
    return by_customer(spark, sf_dir).position().select("o_orderkey", "position")


@query("surf_fields", "SELECT * FROM (VALUES ('r_regionkey', 1), ('r_name', 2)) t(name, ordinal)")
def surf_fields(spark, sf_dir):
    t = table(spark, sf_dir, "region")
    return spark.createDataFrame([(t.field(i).name, i) for i in (1, 2)], "name string, ordinal int")


@query("surf_nfields", "SELECT 2 AS n_fields, 17 AS record_width")
def surf_nfields(spark, sf_dir):
    t = table(spark, sf_dir, "region")
    return spark.createDataFrame([(len(t.fields), t.record_width)], "n_fields int, record_width int")


@query("surf_nullable", "SELECT unnest(['r_regionkey', 'r_name']) AS name, true AS nullable")
def surf_nullable(spark, sf_dir):
    return spark.createDataFrame([(f.name, f.nullable) for f in table(spark, sf_dir, "region").fields], "name string, nullable boolean")


@query("surf_alias", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def surf_alias(spark, sf_dir):
    t = table(spark, sf_dir, "orders", alias="sales")
    return t.filter("sales->o_custkey = 7").df.select("o_orderkey")


# Filters, projections, sorts, limits.


@query("filt_query", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filt_query(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "lineitem")).query("l_quantity > 30 .AND. l_returnflag = 'R'")
    return r.composites().select(*(F.col(f"lineitem__{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity")))


@query("filt_true", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
def filt_true(spark, sf_dir):
    """Conjuncts over either table; each reaches its own scan."""
    r = Relation(table(spark, sf_dir, "orders"))
    r.slave(table(spark, sf_dir, "customer").with_tag(Tag("key", "c_custkey")), "o_custkey", "key", action="skip")
    r.query("customer->c_mktsegment = 'BUILDING' .AND. o_totalprice > 100000")
    return r.composites().select(F.col("orders__o_orderkey").alias("o_orderkey"), F.col("customer__c_name").alias("c_name"))


@query("filt_deleted", "SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def filt_deleted(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    t = replace(t, df=t.df.withColumn(DELETED, F.col("n_nationkey") % 2 == 0))
    return t.filter(".NOT. DELETED()").df.select("n_nationkey")


@query("proj_expr", "SELECT c_custkey, upper(c_name) AS a, c_acctbal * 2 AS b, c_acctbal > 0 AS c FROM customer")
def proj_expr(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return t.df.select("c_custkey", t.expr("UPPER(c_name)").alias("a"), t.expr("c_acctbal * 2").alias("b"), t.expr("c_acctbal > 0").alias("c"))


@query("proj_calc", "SELECT c_custkey, c_acctbal / 2 + 1 AS a FROM customer WHERE c_acctbal / 2 > 1000")
def proj_calc(spark, sf_dir):
    t = table(spark, sf_dir, "customer").with_calc("HALF", "c_acctbal / 2").filter("HALF() > 1000")
    return t.df.select("c_custkey", t.expr("HALF() + 1").alias("a"))


@query("proj_calc_mod", "SELECT c_custkey, c_acctbal / 4 AS a FROM customer")
def proj_calc_mod(spark, sf_dir):
    """A named expression changed, renamed, and another one removed."""
    t = table(spark, sf_dir, "customer").with_calc("HALF", "c_acctbal / 2").with_calc("HALF", "c_acctbal / 4").rename_calc("HALF", "QUARTER").with_calc("GONE", "1").with_calc("GONE", None)
    return t.df.select("c_custkey", t.expr("QUARTER()").alias("a"))


@query("proj_field", "SELECT c_custkey, c_name AS by_ordinal, c_name AS by_name FROM customer")
def proj_field(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return t.df.select("c_custkey", F.col(t.field(2).name).alias("by_ordinal"), F.col(t.field("C_NAME").name).alias("by_name"))


@query("proj_alias", "SELECT o_orderkey, rpad(c_name, 18, ' ') || o_orderstatus AS a FROM orders JOIN customer ON o_custkey = c_custkey")
def proj_alias(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "orders"))
    r.slave(table(spark, sf_dir, "customer").with_tag(Tag("key", "c_custkey")), "o_custkey", "key", action="skip")
    return r.select(o_orderkey="o_orderkey", a="customer->c_name + orders.o_orderstatus").select(F.col("o_orderkey").cast("long"), "a")


def _ranked(relation, key):
    """A relation's order as places."""
    root = relation.root.alias
    return relation.sequenced("place", [F.col(f"{root}__{key}").alias(key)])


@query("sort_rel", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) AS place FROM customer")
def sort_rel(spark, sf_dir):
    return _ranked(Relation(table(spark, sf_dir, "customer")).sort("c_mktsegment + c_name"), "c_custkey")


@query("sort_tag", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def sort_tag(spark, sf_dir):
    """A relation in the order of its master's collated tag."""
    return _ranked(Relation(by_name(spark, sf_dir, collation="general"), tag="name"), "p_partkey")


@query("sort_desc", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_desc(spark, sf_dir):
    return _ranked(Relation(table(spark, sf_dir, "orders")).sort("DESCEND(o_totalprice)"), "o_orderkey")


@query("sort_do", "SELECT o_orderkey, row_number() OVER (ORDER BY c_name, o_orderkey) AS seq FROM orders JOIN customer ON o_custkey = c_custkey")
def sort_do(spark, sf_dir):
    """Composites sorted by a slave's field, numbered."""
    r = Relation(table(spark, sf_dir, "orders"))
    r.slave(table(spark, sf_dir, "customer").with_tag(Tag("key", "c_custkey")), "o_custkey", "key", action="skip")
    r.sort("customer->c_name")
    return r.sequenced("seq", [F.col("orders__o_orderkey").alias("o_orderkey")])


@query("sort_api", "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem")
def sort_api(spark, sf_dir):
    """A stand-alone sort of all rows with their payload, each with its place."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return numbered(rows, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], "place")


@query("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_topk(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "orders")).sort("DESCEND(o_totalprice)")
    return r.ordered().limit(10).select(F.col("orders__o_orderkey").alias("o_orderkey"), F.col("orders__o_totalprice").alias("o_totalprice"))


@query("distinct_tag", "SELECT DISTINCT p_type FROM part")
def distinct_tag(spark, sf_dir):
    t = table(spark, sf_dir, "part").with_tag(Tag("type", "p_type", unique="continue")).select_tag("type")
    return t.entries().select("p_type")


# Record sets.

SETS = {"a": "o_totalprice > 200000", "b": "o_orderstatus = 'F'"}


def _sets(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return RecordSet.where(t, SETS["a"]), RecordSet.where(t, SETS["b"])


@query("set_and", f"SELECT recno FROM ({ORDERS}) WHERE {SETS['a']} AND {SETS['b']}")
def set_and(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.and_(b).numbers.select(F.col(RECNO).alias("recno"))


@query("set_or", f"SELECT recno FROM ({ORDERS}) WHERE {SETS['a']} OR {SETS['b']}")
def set_or(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.or_(b).numbers.select(F.col(RECNO).alias("recno"))


@query("set_not", f"SELECT recno FROM ({ORDERS}) WHERE NOT {SETS['a']}")
def set_not(spark, sf_dir):
    return _sets(spark, sf_dir)[0].not_().numbers.select(F.col(RECNO).alias("recno"))


@query("set_range", f"SELECT recno FROM ({ORDERS}) WHERE recno BETWEEN 100 AND 250 AND {SETS['b']}")
def set_range(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return RecordSet.range(t, 100, 250).and_(RecordSet.where(t, SETS["b"])).numbers.select(F.col(RECNO).alias("recno"))


@query("set_bitmap", f"SELECT (recno // 32768 + 1)::BIGINT AS bucket, count(*) AS n FROM (SELECT {recno('o_orderkey')} - 1 AS recno, * FROM orders) WHERE {SETS['b']} GROUP BY 1")
def set_bitmap(spark, sf_dir):
    """Members by bitmap bucket, counted in the bitmaps."""
    return _sets(spark, sf_dir)[1].bitmap().select("bucket", F.bitmap_count("bits").alias("n"))
