"""Changing, creating and storing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml
from ..operators.table import DELETED, RECNO, Table, Tag
from ..plans.storage import new_folder
from ..sources import dbf, files
from ..types import FieldInfo
from .registry import query, table

N = "c_custkey, c_name, c_nationkey"
CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS recno FROM customer"


def folder(spark) -> str:
    return new_folder(spark, "table")


def customer(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def shown(t):
    return t.df.select("c_custkey", "c_name", "c_nationkey", F.col(RECNO).alias("recno"), F.col(DELETED).alias("deleted"))


@query("dml_append", f"SELECT *, false AS deleted FROM ({CUSTOMERS}) UNION ALL SELECT 1000000000, 'ATLANTIS', 1, (SELECT count(*) FROM customer) + 1, false UNION ALL SELECT 1000000001, 'LEMURIA', 2, (SELECT count(*) FROM customer) + 2, false")
def dml_append(spark, sf_dir):
    new = spark.createDataFrame([(1_000_000_000, "ATLANTIS", 1), (1_000_000_001, "LEMURIA", 2)], "c_custkey long, c_name string, c_nationkey int")
    t = customer(spark, sf_dir).with_tag(Tag("key", "c_custkey", unique="error"))
    return shown(dml.append(t, new, ["c_custkey"]))


@query("dml_appendblank", f"SELECT *, false AS deleted FROM ({CUSTOMERS}) UNION ALL SELECT 0, '', 0, (SELECT count(*) FROM customer) + 1, false")
def dml_appendblank(spark, sf_dir):
    return shown(dml.append_blank(customer(spark, sf_dir)))


@query("dml_update", f"SELECT c_custkey, CASE WHEN c_nationkey = 2 THEN 'R2 ' || rpad(c_name, 18, ' ') ELSE c_name END AS c_name, CASE WHEN c_nationkey = 2 THEN 9 ELSE c_nationkey END AS c_nationkey, recno, false AS deleted FROM ({CUSTOMERS})")
def dml_update(spark, sf_dir):
    return shown(dml.update(customer(spark, sf_dir), "c_nationkey = 2", {"c_name": "'R2 ' + c_name", "c_nationkey": "9"}))


@query("dml_assign", f"SELECT c_custkey * 2 AS c_custkey, c_name, c_nationkey, recno, false AS deleted FROM ({CUSTOMERS})")
def dml_assign(spark, sf_dir):
    """A number assigned to an integer field is converted."""
    return shown(dml.update(customer(spark, sf_dir), None, {"c_custkey": "c_custkey * 2"}))


@query("dml_delete", f"SELECT *, c_nationkey = 1 AS deleted FROM ({CUSTOMERS})")
def dml_delete(spark, sf_dir):
    return shown(dml.delete(customer(spark, sf_dir), "c_nationkey = 1"))


@query("dml_recall", f"SELECT *, c_nationkey = 1 AND c_custkey >= 10 AS deleted FROM ({CUSTOMERS})")
def dml_recall(spark, sf_dir):
    return shown(dml.recall(dml.delete(customer(spark, sf_dir), "c_nationkey = 1"), "c_custkey < 10"))


@query("dml_blank", f"SELECT CASE WHEN c_nationkey = 3 THEN 0 ELSE c_custkey END AS c_custkey, CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS c_name, CASE WHEN c_nationkey = 3 THEN 0 ELSE c_nationkey END AS c_nationkey, recno, false AS deleted FROM ({CUSTOMERS})")
def dml_blank(spark, sf_dir):
    return shown(dml.blank_records(customer(spark, sf_dir), "c_nationkey = 3"))


@query("dml_setnull", f"SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS c_nationkey, recno, false AS deleted FROM ({CUSTOMERS})")
def dml_setnull(spark, sf_dir):
    return shown(dml.set_null(customer(spark, sf_dir), "c_nationkey = 3", "c_nationkey"))


@query("dml_pack", f"SELECT {N}, row_number() OVER (ORDER BY c_custkey) AS recno, false AS deleted FROM customer WHERE c_nationkey <> 1")
def dml_pack(spark, sf_dir):
    return shown(dml.pack(dml.delete(customer(spark, sf_dir), "c_nationkey = 1")))


@query("dml_zap", f"SELECT {N}, row_number() OVER (ORDER BY c_custkey) AS recno, false AS deleted FROM ({CUSTOMERS}) WHERE recno NOT BETWEEN 5 AND 9")
def dml_zap(spark, sf_dir):
    return shown(dml.zap(customer(spark, sf_dir), 5, 9))


@query("dml_check", "SELECT 'cust' AS tag, true AS good UNION ALL SELECT 'all', true")
def dml_check(spark, sf_dir):
    t = table(spark, sf_dir, "orders").with_tag(Tag("cust", "o_custkey", unique="continue")).with_tag(Tag("all", "o_orderkey", unique="error"))
    return spark.createDataFrame(list(t.check().items()), "tag string, good boolean")


@query("ddl_add", "SELECT c_custkey, c_name, '' AS note, 0::DECIMAL(8,2) AS amount FROM customer")
def ddl_add(spark, sf_dir):
    t = dml.add_fields(customer(spark, sf_dir), [FieldInfo("note", "C", 10), FieldInfo("amount", "N", 8, 2)])
    return t.df.select("c_custkey", "c_name", "note", "amount")


@query("ddl_drop", "SELECT * EXCLUDE (c_name) FROM customer")
def ddl_drop(spark, sf_dir):
    return dml.drop_fields(customer(spark, sf_dir), ["C_NAME"]).df.drop(RECNO, DELETED)


@query("ddl_modify", "SELECT c_custkey::VARCHAR AS c_custkey, left(c_name, 4) AS c_name, c_nationkey::DOUBLE AS c_nationkey, false AS flag FROM customer")
def ddl_modify(spark, sf_dir):
    fields = [FieldInfo("c_custkey", "C", 12), FieldInfo("c_name", "C", 4), FieldInfo("c_nationkey", "B"), FieldInfo("flag", "L")]
    return dml.modify(customer(spark, sf_dir), fields).df.drop(RECNO, DELETED)


@query("ddl_replace", "SELECT r_regionkey AS c_custkey, r_name AS c_name, 0 AS c_nationkey, row_number() OVER (ORDER BY r_regionkey) AS recno, false AS deleted FROM region")
def ddl_replace(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("c_custkey"), F.col("r_name").alias("c_name"))
    return shown(dml.replace_contents(customer(spark, sf_dir), rows, ["c_custkey"]))


@query("ddl_info", "SELECT * FROM (VALUES (1, 'n_nationkey', 'I'), (2, 'n_name', 'C'), (3, 'n_regionkey', 'I')) t(ordinal, name, type)")
def ddl_info(spark, sf_dir):
    told = table(spark, sf_dir, "nation").describe()
    return spark.createDataFrame([(i, f["name"], f["type"]) for i, f in enumerate(told, 1)], "ordinal int, name string, type string")


@query("txn_rollback", f"SELECT *, false AS deleted FROM ({CUSTOMERS})")
def txn_rollback(spark, sf_dir):
    t = dml.start(customer(spark, sf_dir))
    return shown(dml.rollback(dml.delete(t, "c_nationkey = 1")))


@query("txn_commit", f"SELECT *, c_nationkey = 1 AS deleted FROM ({CUSTOMERS})")
def txn_commit(spark, sf_dir):
    return shown(dml.commit(dml.delete(dml.start(customer(spark, sf_dir)), "c_nationkey = 1")))


@query("surf_unappend", f"SELECT *, false AS deleted FROM ({CUSTOMERS})")
def surf_unappend(spark, sf_dir):
    return shown(dml.unappend(dml.append_blank(customer(spark, sf_dir))))


@query("snk_create", "SELECT 0::BIGINT AS records, 3 AS fields")
def snk_create(spark, sf_dir):
    t = files.create_table(spark, [FieldInfo("ID", "I"), FieldInfo("NAME", "C", 20), FieldInfo("PRICE", "N", 10, 2)], "made")
    return t.df.agg(F.count(F.lit(1)).alias("records")).withColumn("fields", F.lit(len(t.fields)))


@query("snk_temp", "SELECT c_name FROM customer WHERE c_nationkey = 0")
def snk_temp(spark, sf_dir):
    """A temporary table, by name."""
    customer(spark, sf_dir).filter("c_nationkey = 0").df.createOrReplaceTempView("tidemark_temp")
    return spark.table("tidemark_temp").select("c_name")


@query("snk_copy", f"SELECT *, false AS deleted FROM ({CUSTOMERS})")
def snk_copy(spark, sf_dir):
    files.write_table(customer(spark, sf_dir), path := folder(spark))
    return shown(files.read_table(spark, path, "customer"))


@query("snk_dbf", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate::DATE AS o_date, o_custkey < 100 AS deleted, row_number() OVER (ORDER BY o_orderkey) AS recno FROM orders")
def snk_dbf(spark, sf_dir):
    """Orders written as DBF files, with deletion marks, and opened again."""
    t = dml.delete(table(spark, sf_dir, "orders"), "o_custkey < 100")
    fields = {"O_KEY": ("o_orderkey", FieldInfo("O_KEY", "I")), "O_STATUS": ("o_orderstatus", FieldInfo("O_STATUS", "C", 1)), "O_PRICE": ("o_totalprice", FieldInfo("O_PRICE", "B")), "O_PRIO": ("o_orderpriority", FieldInfo("O_PRIO", "C", 15)), "O_DATE": ("o_date", FieldInfo("O_DATE", "D"))}
    rows = t.df.select(*(F.col(c).cast(f.spark_type()).alias(n, metadata=f.metadata()) for n, (c, f) in fields.items()), RECNO, DELETED)
    dbf.write_dbf(Table(rows, "orders"), path := folder(spark))
    back = dbf.open_dbf(spark, path, "orders").df
    return back.select(*(F.col(n).cast("long").alias(c) if n == "O_KEY" else F.col(n).alias(c) for n, (c, _) in fields.items()), F.col(DELETED).alias("deleted"), F.col(RECNO).alias("recno"))


@query("src_dbf_memo", "SELECT doc_id, text, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def src_dbf_memo(spark, sf_dir):
    """Documents as a DBF table with a memo file beside it, and its memos read."""
    docs = table(spark, sf_dir, "documents").df.select(F.col("doc_id").cast("int").alias("ID", metadata=FieldInfo("ID", "I").metadata()), F.col("text").alias("NOTE", metadata=FieldInfo("NOTE", "M").metadata()), RECNO, DELETED)
    dbf.write_dbf(Table(docs, "documents"), path := folder(spark), encoding="utf-8")
    back = dbf.open_dbf(spark, path, "documents", encoding="utf-8").df
    return back.select(F.col("ID").cast("long").alias("doc_id"), F.col("NOTE").alias("text"), F.octet_length("NOTE").cast("long").alias("n_bytes"))


@query("snk_compress", f"SELECT *, false AS deleted FROM ({CUSTOMERS})")
def snk_compress(spark, sf_dir):
    files.write_table(customer(spark, sf_dir), path := folder(spark), compression="gzip")
    return shown(files.read_table(spark, path, "customer"))


@query("snk_text", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def snk_text(spark, sf_dir):
    """Fixed-width text, written and imported."""
    lines = customer(spark, sf_dir).df.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, " "), F.rpad("c_name", 18, " "), F.lpad(F.col("c_nationkey").cast("string"), 3, " ")).alias("value"))
    lines.write.text(path := folder(spark))
    t = files.import_text(spark, path, [FieldInfo("c_custkey", "1", 10), FieldInfo("c_name", "C", 18), FieldInfo("c_nationkey", "I", 3)], "customer")
    return t.df.select("c_custkey", "c_name", "c_nationkey")


@query("snk_memofile", "SELECT doc_id, length(text) AS n FROM documents")
def snk_memofile(spark, sf_dir):
    """Memos written to files, one each, and read back whole."""
    return _through_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _through_files(spark, docs):
    files.write_memo_files(docs, path := folder(spark), "doc_id", "text")
    return files.open_memo_files(spark, path).select("doc_id", F.length("text").cast("long").alias("n"))
