"""Stacking layers and set operations on their rows."""

from pyspark.sql import functions as F

from geoquarry.operators import union as op

from .base import layer, query, table, with_layers


@query(
    "u1_union_relaxed",
    f"""{with_layers('points', 'nongeo')}
SELECT _unique_id, c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS kind, c_acctbal AS amount, NULL AS value FROM points
UNION ALL SELECT _unique_id, event_id, event_type, NULL, value FROM nongeo""",
)
def u1_union_relaxed(spark, sf_dir):
    points = layer(spark, sf_dir, "points").selectExpr(
        "_unique_id", "CAST(c_custkey AS INT) AS key", "c_nationkey AS kind", "c_acctbal AS amount"
    )
    other = layer(spark, sf_dir, "nongeo").selectExpr("_unique_id", "event_id AS key", "event_type AS kind", "value")
    return op.stack([points, other])


@query(
    "u2_dedup_first",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) AS r WHERE n = 1",
)
def u2_dedup_first(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return op.first_per_key(df, "o_custkey", F.col("o_orderkey"))


@query(
    "u3_replace",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def u3_replace(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    new = df.filter("o_orderstatus = 'F'").selectExpr("o_orderkey", "-o_totalprice AS o_totalprice")
    return op.replace_rows(df.select("o_orderkey", "o_totalprice"), new, "o_orderkey")


@query(
    "u4_still_missing",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def u4_still_missing(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    seen = table(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey")
    return op.still_missing(customers, seen, "c_custkey")
