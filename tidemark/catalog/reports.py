"""Totals and control breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relation import Relation
from ..operators.report import Group, Report, Total
from ..operators.table import Tag
from .registry import query, table

BY_CUSTOMER = "ORDER BY o_custkey, o_orderkey"


def orders_by_customer(spark, sf_dir):
    """Orders in the order of their customers, numbered; a group's run is its key."""
    t = table(spark, sf_dir, "orders").with_tag(Tag("cust", "o_custkey"))
    return Relation(t, tag="cust").sequenced(columns=[F.col(f"orders__{c}").alias(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")])


def events_in_order(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return Relation(t).sort("ts").sequenced(columns=[F.col(f"events__{c}").alias(c) for c in ("event_id", "event_type", "value", "user_id")])




def cust():
    return Group("cust", F.col("o_custkey"))


def price():
    return F.col("o_totalprice")


def kind():
    return Group("type", F.col("event_type"))


def _whole(function, sql):
    def run(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", F.lit(0).cast("long").alias("_seq"))
        groups = [Group("flag", F.col("l_returnflag")), Group("status", F.col("l_linestatus"))]
        report = Report(rows, groups, [Total("total", function, F.col("l_quantity"), "status")], sorted_by_groups=True)
        return report.table("status", ["l_returnflag", "l_linestatus"]).drop("_seq").withColumn("total", F.round("total", 4) if function != "count" else F.col("total"))

    query(f"agg_{ {'average': 'avg'}.get(function, function)}", f"SELECT l_returnflag, l_linestatus, {sql} AS total FROM lineitem GROUP BY 1, 2")(run)


_whole("sum", "round(sum(l_quantity), 4)")
_whole("count", "count(*)")
_whole("average", "round(avg(l_quantity), 4)")
_whole("max", "round(max(l_quantity), 4)")
_whole("min", "round(min(l_quantity), 4)")


@query("agg_running", f"SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 6) AS mean, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey {BY_CUSTOMER})")
def agg_running(spark, sf_dir):
    totals = [Total("total", "sum", price(), "cust"), Total("n", "count", None, "cust"), Total("mean", "average", price(), "cust"), Total("most", "max", price(), "cust")]
    rows = Report(orders_by_customer(spark, sf_dir), [cust()], totals, sorted_by_groups=True).with_running()
    return rows.select("o_orderkey", F.round("total", 2).alias("total"), "n", F.round("mean", 6).alias("mean"), "most")


@query("agg_lookahead", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, count(*) OVER () AS n FROM orders")
def agg_lookahead(spark, sf_dir):
    totals = [Total("total", "sum", price(), "cust"), Total("n", "count")]
    rows = Report(orders_by_customer(spark, sf_dir), [cust()], totals, sorted_by_groups=True).with_lookahead()
    return rows.select("o_orderkey", F.round("total", 2).alias("total"), "n")


RUNS = """e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),
l AS (SELECT *, lag(event_type) OVER (ORDER BY seq) AS before FROM e),
r AS (SELECT *, sum(CASE WHEN seq = 1 OR event_type IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM l)"""


@query("agg_reset", f"WITH {RUNS} SELECT event_id, run::BIGINT AS run, round(sum(value) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS total FROM r")
def agg_reset(spark, sf_dir):
    """A total restarts when the type changes: a run, not a key."""
    rows = Report(events_in_order(spark, sf_dir), [kind()], [Total("total", "sum", F.col("value"), "type")]).with_running()
    return rows.select("event_id", F.col("run_type").alias("run"), F.round("total", 4).alias("total"))


@query("agg_cond_log", "SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 0), 2) AS total, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY 1")
def agg_cond_log(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount", F.lit(0).cast("long").alias("_seq"))
    test = F.col("l_discount") > 0.05
    totals = [Total("total", "sum", F.col("l_quantity"), "flag", test), Total("n", "count", None, "flag", test)]
    return Report(rows, [Group("flag", F.col("l_returnflag"))], totals, sorted_by_groups=True).table("flag", ["l_returnflag"]).select("l_returnflag", F.round("total", 2).alias("total"), "n")


@query("agg_cond_change", f"WITH {RUNS} SELECT event_id, round(sum(CASE WHEN seq = 1 OR event_type IS DISTINCT FROM before THEN value END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS total FROM r")
def agg_cond_change(spark, sf_dir):
    """Only rows whose type differs from the row's before are added."""
    total = Total("total", "sum", F.col("value"), None, F.col("event_type"), "change")
    return Report(events_in_order(spark, sf_dir), [], [total]).with_running().select("event_id", F.round("total", 4).alias("total"))


@query("grp_break", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def grp_break(spark, sf_dir):
    """Nested groups: sums of nations inside regions, of regions, and of all."""
    r = Relation(table(spark, sf_dir, "customer"))
    n = r.slave(table(spark, sf_dir, "nation").with_tag(Tag("key", "n_nationkey")), "c_nationkey", "key", action="skip")
    n.slave(table(spark, sf_dir, "region").with_tag(Tag("key", "r_regionkey")), "nation->n_regionkey", "key", action="skip")
    rows = r.composites().select(F.col("region__r_name").alias("r_name"), F.col("nation__n_name").alias("n_name"), F.col("customer__c_acctbal").alias("bal"))
    groups = [Group("region", F.col("r_name")), Group("nation", F.col("n_name"))]
    report = Report(rows, groups, [Total("n", "count"), Total("balance", "sum", F.col("bal"))], sorted_by_groups=True)
    return report.levels().select(F.col("region").alias("r_name"), F.col("nation").alias("n_name"), "n", F.round("balance", 2).alias("balance"))


NESTED = """e AS (SELECT *, user_id % 3 AS u, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),
l AS (SELECT *, lag(event_type) OVER (ORDER BY seq) AS t, lag(u) OVER (ORDER BY seq) AS v FROM e),
r AS (SELECT *, sum(CASE WHEN seq = 1 OR event_type IS DISTINCT FROM t THEN 1 ELSE 0 END) OVER w AS outer_run,
  sum(CASE WHEN seq = 1 OR event_type IS DISTINCT FROM t OR u IS DISTINCT FROM v THEN 1 ELSE 0 END) OVER w AS inner_run FROM l WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def nested(spark, sf_dir, totals):
    return Report(events_in_order(spark, sf_dir), [kind(), Group("user", F.col("user_id") % 3)], totals)


@query("grp_nested_running", f"""WITH {NESTED} SELECT event_id, outer_run::BIGINT AS outer_run, inner_run::BIGINT AS inner_run, round(sum(value) OVER o, 4) AS outer_total, count(*) OVER o AS outer_n,
round(sum(value) OVER i, 4) AS inner_total, max(value) OVER i AS inner_most, min(value) OVER a AS least, round(sum(value) OVER a, 4) AS total FROM r
WINDOW o AS (PARTITION BY outer_run ORDER BY seq ROWS UNBOUNDED PRECEDING), i AS (PARTITION BY inner_run ORDER BY seq ROWS UNBOUNDED PRECEDING), a AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def grp_nested_running(spark, sf_dir):
    """Totals so far of two levels of runs and of all rows."""
    value = F.col("value")
    totals = [Total("outer_total", "sum", value, "type"), Total("outer_n", "count", None, "type"), Total("inner_total", "sum", value, "user"), Total("inner_most", "max", value, "user"), Total("least", "min", value), Total("total", "sum", value)]
    rows = nested(spark, sf_dir, totals).with_running()
    return rows.select("event_id", F.col("run_type").alias("outer_run"), F.col("run_user").alias("inner_run"), F.round("outer_total", 4).alias("outer_total"), "outer_n", F.round("inner_total", 4).alias("inner_total"), "inner_most", "least", F.round("total", 4).alias("total"))


@query("grp_nested_lookahead", f"""WITH {NESTED} SELECT event_id, round(sum(value) OVER (PARTITION BY outer_run), 4) AS outer_total, count(*) OVER (PARTITION BY inner_run) AS inner_n, max(value) OVER (PARTITION BY inner_run) AS inner_most, count(*) OVER () AS n FROM r""")
def grp_nested_lookahead(spark, sf_dir):
    """Totals of whole runs of two levels, known from their first row on."""
    value = F.col("value")
    rows = nested(spark, sf_dir, [Total("outer_total", "sum", value, "type"), Total("inner_n", "count", None, "user"), Total("inner_most", "max", value, "user"), Total("n", "count")]).with_lookahead()
    return rows.select("event_id", F.round("outer_total", 4).alias("outer_total"), "inner_n", "inner_most", "n")


@query("grp_nested_table", f"""WITH {NESTED}, s AS (SELECT *, sum(value) OVER (PARTITION BY outer_run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS so_far, count(*) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS rows_so_far FROM r)
SELECT max(seq)::BIGINT AS seq, arg_max(event_type, seq) AS event_type, arg_max(u, seq) AS u, count(*) AS n, round(sum(value), 4) AS total, round(arg_max(so_far, seq), 4) AS so_far, arg_max(rows_so_far, seq) AS rows_so_far FROM s GROUP BY inner_run""")
def grp_nested_table(spark, sf_dir):
    """A row for each inner run, with totals of two outer levels so far."""
    value = F.col("value")
    totals = [Total("n", "count", None, "user"), Total("total", "sum", value, "user"), Total("so_far", "sum", value, "type"), Total("rows_so_far", "count")]
    rows = nested(spark, sf_dir, totals).table("user", ["event_type", "user_id"])
    return rows.select(F.col("_seq").alias("seq"), "event_type", (F.col("user_id") % 3).alias("u"), "n", F.round("total", 4).alias("total"), F.round("so_far", 4).alias("so_far"), "rows_so_far")


@query("grp_firstchange", """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),
l AS (SELECT *, lag(event_type) OVER (ORDER BY seq) AS t, lag(user_id % 3) OVER (ORDER BY seq) AS u FROM e)
SELECT event_id, (CASE WHEN seq = 1 OR event_type IS DISTINCT FROM t THEN 1 WHEN user_id % 3 IS DISTINCT FROM u THEN 2 ELSE 0 END)::INT AS level FROM l""")
def grp_firstchange(spark, sf_dir):
    """The outermost group that breaks with each row."""
    groups = [kind(), Group("user", F.col("user_id") % 3)]
    return Report(events_in_order(spark, sf_dir), groups).first_changes().select("event_id", F.col("first_change").alias("level"))


@query("grp_summary", "SELECT count(*) AS n, round(sum(o_totalprice), 1) AS total, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders")
def grp_summary(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice", F.lit(0).cast("long").alias("_seq"))
    totals = [Total("n", "count"), Total("total", "sum", price()), Total("mean", "average", price()), Total("most", "max", price()), Total("least", "min", price())]
    return Report(rows, [], totals).summary().select("n", F.round("total", 1).alias("total"), F.round("mean", 4).alias("mean"), "most", "least")


@query("grp_drive", f"WITH {RUNS} SELECT run::BIGINT AS run, max(event_type) AS event_type, count(*) AS n, round(sum(value), 4) AS total, max(seq)::BIGINT AS last_row FROM r GROUP BY run")
def grp_drive(spark, sf_dir):
    """A footer for each run."""
    report = Report(events_in_order(spark, sf_dir), [kind()], [Total("n", "count", None, "type"), Total("total", "sum", F.col("value"), "type")])
    rows = report.table("type", ["event_type", "run_type"])
    return rows.select(F.col("run_type").alias("run"), "event_type", "n", F.round("total", 4).alias("total"), F.col("_seq").alias("last_row"))


@query("agg_sink", f"""WITH {RUNS}, g AS (SELECT *, sum(value) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS so_far FROM r)
SELECT max(seq)::BIGINT AS seq, arg_max(event_id, seq) AS event_id, arg_max(event_type, seq) AS event_type, round(sum(value), 4) AS run_total, round(arg_max(so_far, seq), 4) AS so_far FROM g GROUP BY run""")
def agg_sink(spark, sf_dir):
    """The output table of a group: the run's last row, its total, and an outer total so far."""
    totals = [Total("run_total", "sum", F.col("value"), "type"), Total("so_far", "sum", F.col("value"))]
    rows = Report(events_in_order(spark, sf_dir), [kind()], totals).table("type", ["event_id", "event_type"])
    return rows.select(F.col("_seq").alias("seq"), "event_id", "event_type", F.round("run_total", 4).alias("run_total"), F.round("so_far", 4).alias("so_far"))


@query("snk_report", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def snk_report(spark, sf_dir):
    """The grouped table written and read again."""
    from .changes import folder

    rows = Report(orders_by_customer(spark, sf_dir), [cust()], [Total("n", "count", None, "cust"), Total("total", "sum", price(), "cust")], sorted_by_groups=True)
    rows.table("cust", ["o_custkey"]).drop("_seq").write.parquet(path := folder(spark))
    return spark.read.parquet(path).select("o_custkey", "n", F.round("total", 2).alias("total"))


@query("rep_query", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def rep_query(spark, sf_dir):
    """A report over a filtered relation."""
    r = Relation(table(spark, sf_dir, "orders")).query("o_totalprice > 100000")
    rows = r.composites().select(F.col("orders__o_orderstatus").alias("o_orderstatus"), F.lit(0).cast("long").alias("_seq"))
    return Report(rows, [Group("s", F.col("o_orderstatus"))], [Total("n", "count", None, "s")], sorted_by_groups=True).table("s", ["o_orderstatus"]).drop("_seq")


@query("rep_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS seq FROM orders")
def rep_sort(spark, sf_dir):
    r = Relation(table(spark, sf_dir, "orders")).sort("o_orderpriority")
    return r.sequenced("seq", [F.col("orders__o_orderkey").alias("o_orderkey")])


@query("fn_total", "SELECT o_custkey, round(sum(o_totalprice) / count(*), 6) AS mean FROM orders GROUP BY 1")
def fn_total(spark, sf_dir):
    """Totals used in an expression."""
    from ..operators.table import Table

    rows = Report(orders_by_customer(spark, sf_dir), [cust()], [Total("TOTAL", "sum", price(), "cust"), Total("N", "count", None, "cust")], sorted_by_groups=True).table("cust", ["o_custkey"])
    t = Table.of(rows.withColumnRenamed("_seq", "_recno"), "t")
    mean = t.compiler(totals={"TOTAL": F.col("TOTAL"), "N": F.col("N")}).compile("TOTAL() / N()").column
    return t.df.select("o_custkey", F.round(mean, 6).alias("mean"))
