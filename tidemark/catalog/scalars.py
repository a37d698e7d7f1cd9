"""Expression operators and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import currency, datelib
from ..operators import dml
from ..plans.sequence import numbered
from .registry import query, scalar, table

O, C, P = ("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey")

# Operators.
scalar("op_true", *O, {"a": (".T.", "true"), "b": (".TRUE.", "true")})
scalar("op_false", *O, {"a": (".F.", "false"), "b": (".FALSE.", "false")})
scalar("op_not", *O, {"a": (".NOT. o_totalprice > 200000", "NOT o_totalprice > 200000"), "b": ("! (o_orderstatus = 'F')", "o_orderstatus <> 'F'")})
scalar("op_or", *O, {"a": ("o_orderstatus = 'F' .OR. o_orderstatus = 'P' .OR. o_totalprice < 1000", "o_orderstatus IN ('F', 'P') OR o_totalprice < 1000")})
scalar("op_and", *O, {"a": ("o_orderstatus = 'F' .AND. o_totalprice > 100000 .AND. o_custkey < 500", "o_orderstatus = 'F' AND o_totalprice > 100000 AND o_custkey < 500")})
scalar("op_concat", *P, {"a": ("p_brand + p_type", "rpad(p_brand, 10, ' ') || rpad(p_type, 10, ' ')")})
scalar("op_concat_w", *P, {"a": ("p_name + '|'", "rpad(p_name, 20, ' ') || '|'")})
scalar("op_concat_trim", *P, {"a": ("TRIM(p_brand) + p_type", "rpad(p_brand || rpad(p_type, 10, ' '), 20, ' ')")})
scalar("op_add", *P, {"a": ("p_size + p_retailprice", "p_size + p_retailprice"), "b": ("p_size + 1", "(p_size + 1)::DOUBLE")})
scalar("op_add_date", *O, {"a": ("o_date + 30", "(o_orderdate::DATE + 30)"), "b": ("o_date - 7", "(o_orderdate::DATE - 7)")})
scalar("op_subconcat", *P, {"a": ("p_brand - p_type", "rpad(p_brand || rpad(p_type, 10, ' '), 20, ' ')")})
scalar("op_sub", *P, {"a": ("p_retailprice - p_size", "p_retailprice - p_size")})
scalar("op_sub_date", *O, {"a": ("o_date - STOD('19950101')", "(o_orderdate::DATE - DATE '1995-01-01')::DOUBLE"), "b": ("o_date - 1", "(o_orderdate::DATE - 1)")})
scalar("op_ne", *P, {"a": ("p_brand <> 'Brand#1'", "NOT starts_with(p_brand, 'Brand#1')"), "b": ("p_size # 10", "p_size <> 10"), "c": ("'Brand#11' <> p_brand", "NOT starts_with(rpad(p_brand, 10, ' '), 'Brand#11')")})
scalar("op_ge", *P, {"a": ("p_brand >= 'Brand#2'", "substr(rpad(p_brand, 10, ' '), 1, 7) >= 'Brand#2'"), "b": ("p_size => 25", "p_size >= 25")})
scalar("op_le", *P, {"a": ("p_brand <= 'Brand#2'", "substr(rpad(p_brand, 10, ' '), 1, 7) < 'Brand#2'"), "b": ("p_size =< 25", "p_size <= 25"), "c": ("25.5 <= p_size", "p_size >= 25.5")})
scalar("op_eq", *P, {"a": ("p_brand = 'Brand#1'", "starts_with(p_brand, 'Brand#1')"), "b": ("p_brand = 'Brand#1 '", "substr(rpad(p_brand, 10, ' '), 1, 8) = 'Brand#1 '"), "c": ("p_brand = p_type", "rpad(p_brand, 10, ' ') = rpad(p_type, 10, ' ')"), "d": ("10 = p_size", "p_size = 10")})
scalar("op_gt", *P, {"a": ("p_brand > 'Brand#2'", "substr(rpad(p_brand, 10, ' '), 1, 7) >= 'Brand#2'"), "b": ("p_name > p_type", "substr(rpad(p_name, 20, ' '), 1, 10) >= rpad(p_type, 10, ' ')"), "c": ("p_retailprice > 1000.5", "p_retailprice > 1000.5")})
scalar("op_lt", *P, {"a": ("p_brand < 'Brand#2'", "substr(rpad(p_brand, 10, ' '), 1, 7) < 'Brand#2'"), "b": ("p_type < p_name", "rpad(p_type, 10, ' ') <= substr(rpad(p_name, 20, ' '), 1, 10)")})
scalar("op_pow", *P, {"a": ("p_size ^ 2", "pow(p_size, 2)"), "b": ("2 ** 3 ^ 2", "64.0::DOUBLE")})
scalar("op_mul", *P, {"a": ("p_size * p_retailprice", "p_size * p_retailprice")})
scalar("op_div", *P, {"a": ("p_retailprice / p_size", "CASE WHEN p_size = 0 THEN 0 ELSE p_retailprice / p_size END"), "b": ("p_size / (p_size - p_size)", "0.0::DOUBLE")})
scalar("op_contain", *P, {"a": ("'ring' $ p_name", "contains(p_name, 'ring')"), "b": ("TRIM(p_type) $ p_name", "contains(p_name, p_type)")})


@query("op_flt", "SELECT p_partkey, (p_size::FLOAT + p_retailprice::FLOAT)::FLOAT AS a, (p_size::FLOAT - 1.5::FLOAT * 0)::FLOAT AS b, (p_size::FLOAT * p_size::FLOAT)::FLOAT AS c, CASE WHEN p_size = 0 THEN 0::FLOAT ELSE (p_retailprice::FLOAT::DOUBLE / p_size::FLOAT::DOUBLE)::FLOAT END AS d FROM part")
def op_flt(spark, sf_dir):
    """OP_ADD_FLT, OP_SUB_FLT, OP_MUL_FLT, OP_DIV_FLT: arithmetic of two 4-byte floats stays one."""
    from dataclasses import replace

    t = table(spark, sf_dir, "part")
    t = replace(t, df=t.df.withColumns({"fs": F.col("p_size").cast("float"), "fp": F.col("p_retailprice").cast("float"), "fz": F.lit(0).cast("float")}))
    return t.df.select("p_partkey", *(t.expr(e).alias(n) for n, e in {"a": "fs + fp", "b": "fs - fz", "c": "fs * fs", "d": "fp / fs"}.items()))


@query("op_cmp_cur", "SELECT o_orderkey, o_totalprice::DECIMAL(19,4) > 1000.0000 AS a, o_totalprice::DECIMAL(19,4) = (o_totalprice::DECIMAL(19,4)) AS b FROM orders")
def op_cmp_cur(spark, sf_dir):
    t = _currency(spark, sf_dir)
    return t.df.select("o_orderkey", t.expr("money > 1000").alias("a"), t.expr("money = money").alias("b"))


@query("op_cmp_dt", "SELECT o_orderkey, o_orderdate > TIMESTAMP '1997-01-01' AS a, o_orderdate <= TIMESTAMP '1998-06-30' AS b, o_orderdate::DATE = DATE '1997-01-01' AS c FROM orders")
def op_cmp_dt(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.df.select("o_orderkey", t.expr("o_orderdate > DATETIME(1997, 1, 1)").alias("a"), t.expr("o_orderdate <= DATETIME(1998, 6, 30, 0, 0, 0)").alias("b"), t.expr("o_date = STOD('19970101')").alias("c"))


def _currency(spark, sf_dir):
    from dataclasses import replace

    t = table(spark, sf_dir, "orders")
    df = t.df.withColumn("money", F.col("o_totalprice").cast("decimal(19,4)")).withMetadata("money", {"xtype": "Y", "width": 8, "dec": 4})
    return replace(t, df=df)


# Text functions.
scalar("fn_chr", *P, {"a": ("CHR(65)", "chr(65)"), "b": ("CHR(48 + p_size - p_size)", "'0'")})
scalar("fn_str", *P, {"a": ("STR(p_size)", "lpad(p_size::VARCHAR, 10, ' ')"), "b": ("STR(p_retailprice, 9, 2)", "lpad(printf('%.2f', round(p_retailprice, 2)), 9, ' ')"), "c": ("STR(p_retailprice * 1000, 5, 0)", "CASE WHEN length(printf('%.0f', round(p_retailprice * 1000, 0))) > 5 THEN '*****' ELSE lpad(printf('%.0f', round(p_retailprice * 1000, 0)), 5, ' ') END")})
scalar("fn_str_w", *P, {"a": ("STR(p_partkey, 8)", "lpad(p_partkey::VARCHAR, 8, ' ')")})
scalar("fn_strzero", *P, {"a": ("STRZERO(p_size, 6)", "lpad(p_size::VARCHAR, 6, '0')")})
scalar("fn_substr", *P, {"a": ("SUBSTR(p_name, 3, 4)", "substr(rpad(p_name, 20, ' '), 3, 4)"), "b": ("SUBSTR(p_type, 2)", "substr(rpad(p_type, 10, ' '), 2, 9)")})
scalar("fn_upper", *P, {"a": ("UPPER(p_name)", "upper(p_name)")})
scalar("fn_space", *P, {"a": ("SPACE(3) + p_brand", "'   ' || rpad(p_brand, 10, ' ')")})
scalar("fn_trim", *P, {"a": ("TRIM(p_brand)", "rtrim(p_brand)"), "b": ("TRIM(SPACE(2) + p_brand)", "'  ' || rtrim(p_brand)")})
scalar("fn_ltrim", *P, {"a": ("LTRIM(STR(p_size))", "p_size::VARCHAR"), "b": ("LTRIM(p_brand)", "rpad(p_brand, 10, ' ')")})
scalar("fn_alltrim", *P, {"a": ("ALLTRIM(SPACE(2) + p_brand)", "trim(p_brand)")})
scalar("fn_left", *P, {"a": ("LEFT(p_name, 5)", "left(rpad(p_name, 20, ' '), 5)")})
scalar("fn_right", *P, {"a": ("RIGHT(p_type, 4)", "right(rpad(p_type, 10, ' '), 4)"), "b": ("RIGHT(TRIM(p_type), 4)", "right(p_type, 4)")})
scalar("fn_padl", *P, {"a": ("PADL(TRIM(p_type), 12)", "lpad(p_type, 12, ' ')"), "b": ("PADL(p_name, 4)", "left(rpad(p_name, 20, ' '), 4)")})
scalar("fn_padr", *P, {"a": ("PADR(p_type, 12)", "rpad(p_type, 12, ' ')"), "b": ("PADR(p_name, 4)", "left(rpad(p_name, 20, ' '), 4)")})
scalar("fn_val", *P, {"a": ("VAL(SUBSTR(p_brand, 7))", "coalesce(try_cast(substr(p_brand, 7) AS DOUBLE), 0)"), "b": ("VAL(p_type)", "0.0::DOUBLE"), "c": ("VAL(STR(p_retailprice, 10, 2))", "round(p_retailprice, 2)")})
scalar("fn_keyequal", *P, {"a": ("KEYEQUAL(p_brand, 'Brand#12')", "p_brand = 'Brand#12'")})
scalar("fn_ascend", *P, {"a": ("ASCEND(p_size)", "lpad((1000000000000000 + p_size)::VARCHAR || '.000000', 23, '0')")})
scalar("fn_descend", *P, {"a": ("DESCEND(p_size)", "lpad((1000000000000000 - p_size)::VARCHAR || '.000000', 23, '0')")})


@query("fn_l2bin", "SELECT p_partkey, lower(printf('%02X%02X%02X%02X', (p_partkey & 255)::INT, ((p_partkey >> 8) & 255)::INT, ((p_partkey >> 16) & 255)::INT, ((p_partkey >> 24) & 255)::INT)) AS a FROM part")
def fn_l2bin(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.df.select("p_partkey", F.lower(F.hex(t.expr("L2BIN(p_partkey)"))).alias("a"))


@query("fn_descend_bin", "SELECT p_partkey, row_number() OVER (ORDER BY p_type DESC, p_partkey) AS a FROM part")
def fn_descend_bin(spark, sf_dir):
    """The order of descending keys, as ranks."""
    t = table(spark, sf_dir, "part")
    return numbered(t.df, [t.expr("DESCEND(p_type)"), F.col("p_partkey")], "a").select("p_partkey", "a")


# Dates and times.
scalar("fn_dtos", *O, {"a": ("DTOS(o_date)", "strftime(o_orderdate, '%Y%m%d')")})
scalar("fn_dtoc", *O, {"a": ("DTOC(o_date)", "strftime(o_orderdate, '%m/%d/%Y')"), "b": ("DTOC(o_date, 1)", "strftime(o_orderdate, '%Y%m%d')")})
scalar("fn_ttoc", *O, {"a": ("TTOC(o_orderdate, 1)", "strftime(o_orderdate, '%Y%m%d%H%M%S')")})
scalar("fn_datetime", *O, {"a": ("DATETIME(1999, 12, 31, 23, 59, 58)", "TIMESTAMP '1999-12-31 23:59:58'")})
scalar("fn_stod", *O, {"a": ("STOD(DTOS(o_date))", "o_orderdate::DATE"), "b": ("STOD('2001' + '0230')", "NULL::DATE")})
scalar("fn_ctod", *O, {"a": ("CTOD(DTOC(o_date))", "o_orderdate::DATE")})
scalar("fn_day", *O, {"a": ("DAY(o_date)", "day(o_orderdate)::DOUBLE"), "b": ("DAY(STOD('        '))", "0.0::DOUBLE")})
scalar("fn_month", *O, {"a": ("MONTH(o_date)", "month(o_orderdate)::DOUBLE")})
scalar("fn_year", *O, {"a": ("YEAR(o_date)", "year(o_orderdate)::DOUBLE")})


@query("fn_date", "SELECT o_orderkey, true AS a FROM orders")
def fn_date(spark, sf_dir):
    """Today differs from run to run, so the result tells that it is after every order."""
    t = table(spark, sf_dir, "orders")
    return t.df.select("o_orderkey", t.expr("DATE() > o_date").alias("a"))


@query("fn_time", "SELECT o_orderkey, 8 AS a, true AS b FROM orders")
def fn_time(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.df.select("o_orderkey", F.length(t.expr("TIME()")).alias("a"), t.expr("TIME()").rlike(r"^\d\d:\d\d:\d\d$").alias("b"))


@query("fn_dtlib", "SELECT o_orderkey, (dayofweek(o_orderdate) + 1)::INT AS dow, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name, ((year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0) AS leap, (o_orderdate::DATE - DATE '1970-01-01' + 2440588)::BIGINT AS julian FROM orders")
def fn_dtlib(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").df.select("o_orderkey", datelib.day_of_week(d).alias("dow"), datelib.day_name(d).alias("day_name"), datelib.month_name(d).alias("month_name"), datelib.is_leap(d).alias("leap"), datelib.julian_day(d).alias("julian"))


# Conditions, records, currency.
scalar("fn_iif", *O, {"a": ("IIF(o_totalprice > 200000, 1, 0)", "CASE WHEN o_totalprice > 200000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"), "b": ("IIF(o_orderstatus = 'F', o_date, o_date + 1)", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE ELSE o_orderdate::DATE + 1 END"), "c": ("IIF(o_custkey > 5, .T., .F.)", "o_custkey > 5")})
scalar("fn_iif_str", *O, {"a": ("IIF(o_totalprice > 200000, 'large', 'sm')", "CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'sm   ' END")})
scalar("fn_empty", *O, {"a": ("EMPTY(o_orderstatus)", "trim(o_orderstatus) = ''"), "b": ("EMPTY(o_custkey)", "o_custkey = 0"), "c": ("EMPTY(STOD('        '))", "true"), "d": ("EMPTY(SPACE(4))", "true"), "e": ("EMPTY(.F.)", "true")})
scalar("fn_del", *O, {"a": ("DEL()", "' '")})
scalar("fn_deleted", *O, {"a": ("DELETED()", "false")})
scalar("fn_reccount", *O, {"a": ("RECCOUNT()", "(SELECT count(*) FROM orders)::DOUBLE")})
scalar("fn_recno", *O, {"a": ("RECNO()", "(row_number() OVER (ORDER BY o_orderkey))::DOUBLE")})
scalar("fn_pageno", *O, {"a": ("PAGENO()", "1.0::DOUBLE")})
scalar("const_load", *O, {"a": ("'text'", "'text'"), "b": ("12.5", "12.5::DOUBLE"), "c": ("-3", "(-3.0)::DOUBLE"), "d": ('"quoted"', "'quoted'")})
scalar("fld_load", *O, {"a": ("o_custkey", "o_custkey::DOUBLE"), "b": ("o_orderstatus", "o_orderstatus"), "c": ("o_date", "o_orderdate::DATE"), "d": ("o_totalprice", "o_totalprice")})


@query("fn_calc", "SELECT o_orderkey, o_totalprice * 0.19 AS a, o_totalprice * 0.19 + o_totalprice AS b FROM orders")
def fn_calc(spark, sf_dir):
    t = table(spark, sf_dir, "orders").with_calc("TAX", "o_totalprice * 0.19").with_calc("GROSS", "TAX() + o_totalprice")
    return t.df.select("o_orderkey", t.expr("TAX()").alias("a"), t.expr("GROSS").alias("b"))


@query("cur_arith", """SELECT o_orderkey, (m + m)::DECIMAL(19,4) AS a, (m - 1.5)::DECIMAL(19,4) AS b, (m * 3)::DECIMAL(19,4) AS c, round(m::DOUBLE / 7, 2) AS d, (m % 100)::DECIMAL(19,4) AS e
FROM (SELECT o_orderkey, o_totalprice::DECIMAL(19,4) AS m FROM orders)""")
def cur_arith(spark, sf_dir):
    t = _currency(spark, sf_dir)
    m = F.col("money")
    return t.df.select("o_orderkey", currency.add(m, m).alias("a"), currency.subtract(m, F.lit("1.5")).alias("b"), currency.multiply(m, F.lit(3)).alias("c"), F.round(currency.divide(m, F.lit(7)).cast("double"), 2).alias("d"), currency.modulo(m, F.lit(100)).alias("e"))


@query("cur_cmp", "SELECT o_orderkey, (CASE WHEN m > 100000 THEN 1 WHEN m < 100000 THEN -1 ELSE 0 END)::INT AS a FROM (SELECT o_orderkey, o_totalprice::DECIMAL(19,4) AS m FROM orders)")
def cur_cmp(spark, sf_dir):
    return _currency(spark, sf_dir).df.select("o_orderkey", currency.compare(F.col("money"), F.lit(100000)).alias("a"))


@query("surf_money", "SELECT o_orderkey, printf('%.4f', o_totalprice::DECIMAL(19,4)) AS a, strftime(o_orderdate, '%Y%m%d%H:%M:%S') AS b FROM orders")
def surf_money(spark, sf_dir):
    return _currency(spark, sf_dir).df.select("o_orderkey", currency.to_text(F.col("money")).alias("a"), datelib.datetime_text(F.col("o_orderdate")).alias("b"))


@query("surf_text", "SELECT o_orderkey, rpad(o_orderpriority, 15, ' ') AS a FROM orders")
def surf_text(spark, sf_dir):
    """The stored text of a field, at its full width."""
    t = table(spark, sf_dir, "orders")
    return t.df.select("o_orderkey", t.compiler().compile("o_orderpriority").padded().alias("a"))


@query("surf_copy", "SELECT o_orderkey, o_totalprice::VARCHAR AS a, o_custkey::DOUBLE AS b FROM orders")
def surf_copy(spark, sf_dir):
    """Copying a field to one of another type converts it."""
    from ..types import FieldInfo

    t = table(spark, sf_dir, "orders")
    out = dml.modify(t, [FieldInfo("o_orderkey", "1"), FieldInfo("o_totalprice", "C"), FieldInfo("o_custkey", "B")])
    return out.df.select("o_orderkey", F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"))


@query("surf_memo", "SELECT doc_id, length(text) AS n, substr(text, 11, 20) AS part, text || '!' AS assigned FROM documents")
def surf_memo(spark, sf_dir):
    """Length, part and assignment of a memo."""
    t = dml.update(table(spark, sf_dir, "documents"), None, {"source": "source"})
    return t.df.select("doc_id", F.length("text").cast("long").alias("n"), F.substring("text", 11, 20).alias("part"), F.concat("text", F.lit("!")).alias("assigned"))
