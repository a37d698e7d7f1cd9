"""Relations: every type of lookup with every action, and moving through composites."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.relation import Relation
from ..operators.table import Tag
from .registry import query, table


def customers(spark, sf_dir, only: str | None = None, **options):
    t = table(spark, sf_dir, "customer")
    return (t.filter(only) if only else t).with_tag(Tag("key", "c_custkey", **options))


def orders_of(spark, sf_dir, **options):
    return table(spark, sf_dir, "orders").with_tag(Tag("cust", "o_custkey", **options))


def out(df, **columns):
    return df.select(*(F.col(c).alias(n) for n, c in columns.items()))


OC = {"o_orderkey": "orders__o_orderkey", "c_name": "customer__c_name"}
CO = {"c_custkey": "customer__c_custkey", "o_orderkey": "orders__o_orderkey"}


def _orders_to_customers(spark, sf_dir, action, only="c_acctbal > 0", **options):
    r = Relation(table(spark, sf_dir, "orders"), **options)
    r.slave(customers(spark, sf_dir, only), "o_custkey", "key", action=action)
    return r


@query("rel_init", "SELECT c_custkey, c_name FROM customer")
def rel_init(spark, sf_dir):
    return out(Relation(table(spark, sf_dir, "customer")).composites(), c_custkey="customer__c_custkey", c_name="customer__c_name")


@query("rel_slave", "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def rel_slave(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "nation"))
    r.slave(table(spark, sf_dir, "region").with_tag(Tag("key", "r_regionkey")), "n_regionkey", "key")
    return out(r.composites(), n_name="nation__n_name", r_name="region__r_name")


@query("join_exact_blank", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_exact_blank(spark, sf_dir):
    return out(_orders_to_customers(spark, sf_dir, "blank").composites(), **OC)


@query("join_exact_skip", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_exact_skip(spark, sf_dir):
    return out(_orders_to_customers(spark, sf_dir, "skip").composites(), **OC)


@query("join_exact_first", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_exact_first(spark, sf_dir):
    """Of several matches an exact lookup takes the first."""
    r = Relation(table(spark, sf_dir, "customer"))
    r.slave(orders_of(spark, sf_dir), "c_custkey", "cust")
    return out(r.composites(), **CO)


@query("join_exact_term", "WITH j AS (SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > -800) SELECT * FROM j WHERE o_orderkey < (SELECT coalesce(min(o_orderkey), 1 << 60) FROM j WHERE c_name IS NULL)")
def join_exact_term(spark, sf_dir):
    """Composites before the first miss."""
    return out(_orders_to_customers(spark, sf_dir, "terminate", "c_acctbal > -800").composites(), **OC)


@query("join_scan_blank", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_scan_blank(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "customer"))
    r.slave(orders_of(spark, sf_dir), "c_custkey", "cust", type="scan")
    return out(r.composites(), **CO)


@query("join_scan_skip", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def join_scan_skip(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "customer"))
    r.slave(orders_of(spark, sf_dir), "c_custkey", "cust", type="scan", action="skip")
    return out(r.composites(), **CO)


MULTI = """SELECT n_nationkey, c_custkey, NULL::BIGINT AS s_suppkey FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey, NULL, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey"""


def _multi(spark, sf_dir, action):
    r = Relation(table(spark, sf_dir, "nation"))
    r.slave(table(spark, sf_dir, "customer").with_tag(Tag("nation", "c_nationkey")), "n_nationkey", "nation", type="scan", action=action)
    r.slave(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").with_tag(Tag("nation", "s_nationkey")), "n_nationkey", "nation", type="scan", action=action)
    return out(r.composites(), n_nationkey="nation__n_nationkey", c_custkey="customer__c_custkey", s_suppkey="supplier__s_suppkey")


@query("join_scan_multi", MULTI.replace("s_nationkey = n_nationkey", "s_nationkey = n_nationkey AND s_acctbal > 5000") + " UNION ALL SELECT n_nationkey, NULL, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def join_scan_multi(spark, sf_dir):
    """Two scans of one master take turns; a master without any match has one blank row."""
    return _multi(spark, sf_dir, "blank")


@query("join_scan_multi_skip", MULTI.replace("s_nationkey = n_nationkey", "s_nationkey = n_nationkey AND s_acctbal > 5000"))
def join_scan_multi_skip(spark, sf_dir):
    return _multi(spark, sf_dir, "skip")


@query("join_approx", """SELECT e.event_id, p.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.ts <= p.ts""")
def join_approx(spark, sf_dir):
    """Each click with the purchase at or after it."""
    events = table(spark, sf_dir, "events")
    r = Relation(events.filter("event_type = 'click'"))
    r.slave(events.clone("buys").filter("event_type = 'purchase'").with_tag(Tag("ts", "ts")), "ts", "ts", type="approx")
    return out(r.composites(), event_id="events__event_id", next_id="buys__event_id")


@query("join_recno", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def join_recno(spark, sf_dir):
    """Looked up by record number."""
    r = Relation(table(spark, sf_dir, "nation"))
    r.slave(table(spark, sf_dir, "region"), "n_regionkey + 1", action="skip")
    return out(r.composites(), n_name="nation__n_name", r_name="region__r_name")


@query("join_recno_approx", "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def join_recno_approx(spark, sf_dir):
    """A record number out of range gives a blank record."""
    r = Relation(table(spark, sf_dir, "nation"))
    r.slave(table(spark, sf_dir, "region"), "n_nationkey + 1", type="approx")
    return out(r.composites(), n_name="nation__n_name", r_name="region__r_name")


@query("join_matchlen", "SELECT a.p_partkey, (SELECT min(b.p_partkey) FROM part b WHERE left(b.p_type, 3) = left(a.p_type, 3) AND b.p_type = (SELECT min(c.p_type) FROM part c WHERE left(c.p_type, 3) = left(a.p_type, 3))) AS first FROM part a")
def join_matchlen(spark, sf_dir):
    """The first three characters of the key count; of their matches the first in key order."""
    part = table(spark, sf_dir, "part")
    r = Relation(part)
    r.slave(part.clone("like").with_tag(Tag("type", "p_type")), "p_type", "type", match_length=3)
    return out(r.composites(), p_partkey="part__p_partkey", first="like__p_partkey")


@query("join_nullkey", "SELECT o_orderkey, c_custkey FROM (SELECT *, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) LEFT JOIN customer ON k = c_custkey")
def join_nullkey(spark, sf_dir):
    """A null key never matches a key that can't be null."""
    t = table(spark, sf_dir, "orders")
    t = replace(t, df=t.df.withColumn("k", F.expr("IF(o_custkey % 5 = 0, NULL, o_custkey)")))
    r = Relation(t)
    r.slave(customers(spark, sf_dir), "k", "key")
    return out(r.composites(), o_orderkey="orders__o_orderkey", c_custkey="customer__c_custkey")


@query("join_blankkey", "SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = coalesce(c_nationkey, 0)")
def join_blankkey(spark, sf_dir):
    """A blank composite is looked up with its blank key: number 0 here."""
    r = _orders_to_customers(spark, sf_dir, "blank")
    r.node("customer").slave(table(spark, sf_dir, "nation").with_tag(Tag("key", "n_nationkey")), "customer->c_nationkey", "key")
    return out(r.composites(), o_orderkey="orders__o_orderkey", n_name="nation__n_name")


@query("join_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def join_chain(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "orders"))
    c = r.slave(customers(spark, sf_dir), "o_custkey", "key", action="skip")
    n = c.slave(table(spark, sf_dir, "nation").with_tag(Tag("key", "n_nationkey")), "customer->c_nationkey", "key", action="skip")
    n.slave(table(spark, sf_dir, "region").with_tag(Tag("key", "r_regionkey")), "nation->n_regionkey", "key", action="skip")
    r.query("region->r_name = 'ASIA'")
    return out(r.composites(), **OC, n_name="nation__n_name", r_name="region__r_name")


@query("join_self", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def join_self(spark, sf_dir):
    c = customers(spark, sf_dir)
    r = Relation(c)
    r.slave(c.clone("next"), "c_custkey + 1", "key", action="skip")
    return out(r.composites(), a="customer__c_custkey", b="next__c_custkey")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "customer"))
    r.slave(orders_of(spark, sf_dir), "c_custkey", "cust", type="scan")
    return out(r.semi("orders"), c_custkey="customer__c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "customer"))
    r.slave(orders_of(spark, sf_dir), "c_custkey", "cust", type="scan")
    return out(r.anti("orders"), c_custkey="customer__c_custkey")


@query("rel_doall", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7")
def rel_doall(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "customer"))
    r.slave(orders_of(spark, sf_dir), "c_custkey", "cust", type="scan")
    return out(r.do_all(8), **CO)


@query("rel_doone", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 99")
def rel_doone(spark, sf_dir):
    return out(_orders_to_customers(spark, sf_dir, "blank", None).do_one(100, "customer"), **OC)


@query("rel_next", "SELECT * FROM (VALUES (1, 'orders'), (2, 'customer'), (3, 'nation')) t(place, alias)")
def rel_next(spark, sf_dir):
    """Nodes in pre-order."""
    r = _orders_to_customers(spark, sf_dir, "blank")
    r.node("customer").slave(table(spark, sf_dir, "nation").with_tag(Tag("key", "n_nationkey")), "customer->c_nationkey", "key")
    return spark.createDataFrame([(i, n.alias) for i, n in enumerate(r.nodes, 1)], "place int, alias string")


def _sorted(spark, sf_dir):
    r = _orders_to_customers(spark, sf_dir, "skip")
    return r.sort("customer->c_name")


SORTED = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 ORDER BY c_name {d}, o_orderkey {d}"


@query("rel_top", SORTED.format(d="") + " LIMIT 1")
def rel_top(spark, sf_dir):
    return out(_sorted(spark, sf_dir).top(), **OC)


@query("rel_bottom", SORTED.format(d="DESC") + " LIMIT 1")
def rel_bottom(spark, sf_dir):
    return out(_sorted(spark, sf_dir).bottom(), **OC)


@query("rel_skip", SORTED.format(d="") + " LIMIT 1 OFFSET 10")
def rel_skip(spark, sf_dir):
    return out(_sorted(spark, sf_dir).skip(10), **OC)


@query("rel_skip_back", SORTED.format(d="DESC") + " LIMIT 1 OFFSET 2")
def rel_skip_back(spark, sf_dir):
    return out(_sorted(spark, sf_dir).skip(-3), **OC)


@query("rel_skipmaster", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rel_skipmaster(spark, sf_dir):
    """Distinct customers that have orders."""
    r = Relation(table(spark, sf_dir, "customer"))
    r.slave(orders_of(spark, sf_dir), "c_custkey", "cust", type="scan", action="skip")
    return out(r.distinct_masters(), **CO)


@query("rel_eof", "SELECT false AS some_left, true AS none_left")
def rel_eof(spark, sf_dir):
    some = Relation(table(spark, sf_dir, "nation"))
    none = Relation(table(spark, sf_dir, "nation")).query("n_nationkey < 0")
    return spark.createDataFrame([(some.is_empty(), none.is_empty())], "some_left boolean, none_left boolean")


@query("rel_count", "SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') AS filtered, (SELECT count(*) FROM orders) AS plain")
def rel_count(spark, sf_dir):
    r = _orders_to_customers(spark, sf_dir, "blank", None)
    plain = r.count()
    return spark.createDataFrame([(r.query("customer->c_mktsegment = 'BUILDING'").count(), plain)], "filtered long, plain long")


@query("rel_count_filt", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 250000")
def rel_count_filt(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "orders")).query("o_totalprice > 250000")
    return r.composites().agg(F.count(F.lit(1)).alias("n"))


@query("rel_retain", "SELECT count(*) AS first, count(*) AS again FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def rel_retain(spark, sf_dir):
    r = _orders_to_customers(spark, sf_dir, "skip").retain()
    counts = r.count(), r.count()
    r.free()
    return spark.createDataFrame([counts], "first long, again long")


@query("rel_save", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE o_totalprice > 300000")
def rel_save(spark, sf_dir):
    """A relation out of its saved definition."""
    r = _orders_to_customers(spark, sf_dir, "skip").query("o_totalprice > 300000")
    again = Relation.load(r.save(), {n.alias: n.table for n in r.nodes})
    return out(again.composites(), **OC)


@query("rel_callback", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def rel_callback(spark, sf_dir):
    """A hook adds a condition to the filter."""
    r = Relation(table(spark, sf_dir, "orders")).on_query(lambda kind, text: f"({text}) .AND. o_orderstatus = 'F'")
    return out(r.query("o_totalprice > 300000").composites(), o_orderkey="orders__o_orderkey")


@query("rel_blank_mode", "SELECT o_orderkey, coalesce(c_name, '') AS c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE coalesce(c_acctbal, 0) < 100")
def rel_blank_mode(spark, sf_dir):
    """Filters see blanks for missing records; so does the result here."""
    r = _orders_to_customers(spark, sf_dir, "blank", blank_mode="blank").query("customer->c_acctbal < 100")
    return out(r.composites(), **OC)


@query("rel_optimizeable", "SELECT true AS plain, false AS computed")
def rel_optimizeable(spark, sf_dir):
    """Whether a filter reaches the scan."""
    r = Relation(table(spark, sf_dir, "orders"))
    a = r.query("o_totalprice > 1000").optimizeable()
    b = r.query("STR(o_totalprice) + DTOS(DATE()) = 'x'").optimizeable()
    return spark.createDataFrame([(a, b)], "plain boolean, computed boolean")


@query("rel_readbuf", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_totalprice > 400000")
def rel_readbuf(spark, sf_dir):
    """The composites of a filtered relation, in the order in which buffered reading hands them out."""
    r = Relation(table(spark, sf_dir, "orders")).query("o_totalprice > 400000")
    return r.sequenced("place").select(F.col("orders__o_orderkey").alias("o_orderkey"), "place")
