"""Derived views over the driver tables used by the checks and the bench.

* ``sales``: orders joined to customer and nation (survey concept map: Sales ->
  o_totalprice, Date -> o_orderdate, Location -> n_name, Category -> c_mktsegment);
* ``doc_labels``: documents left-joined to labels (the null source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.catalog import ROW_ID, TableSet


def sales_view(t: TableSet) -> DataFrame:
    orders = t["orders"]
    customer = t.plain("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = t.plain("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # orders x customer: both grow with the data -> shuffle join on the key
    oc = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    ocn = oc.join(nation, "c_nationkey")
    return ocn.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("date"),
        F.col("n_name").alias("location"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_totalprice").alias("sales"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col(ROW_ID),
    )


def doc_labels_view(t: TableSet) -> DataFrame:
    docs = t["documents"].select("doc_id", "lang", "source", "n_chars", ROW_ID)
    return docs.join(t.plain("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


SALES_SQL = """(SELECT o_orderkey AS order_id, o_orderdate AS date, n_name AS location,
        c_mktsegment AS category, o_totalprice AS sales, o_orderstatus AS status,
        o_orderpriority AS priority
   FROM orders JOIN customer ON o_custkey = c_custkey
               JOIN nation ON c_nationkey = n_nationkey)"""

DOC_LABELS_SQL = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
   FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
