"""Statistics of layers."""

from pyspark.sql import functions as F

from geoquarry.operators import profile as op
from geoquarry.operators.layer_sql import with_totals
from geoquarry.operators.prepare import large_areas
from geoquarry.operators.sample import hidden_rows, sample_per_layer

from .base import INSIDE, VIEWPORT, layer, point_layer, query, table, with_layers

DIRTY = with_layers("dirty")


@query("a1_counts", f"{with_layers('points')} SELECT __file_path, count(*) AS n_rows FROM points GROUP BY __file_path")
def a1_counts(spark, sf_dir):
    return op.rows_per(layer(spark, sf_dir, "points"), "__file_path")


@query(
    "a2_buffer_hint",
    f"""{with_layers('metric_boxes')} SELECT max((maxx - minx) * (maxy - miny)) AS max_area,
max((maxx - minx) * (maxy - miny)) < 10000 AS buffer_hint FROM metric_boxes""",
)
def a2_buffer_hint(spark, sf_dir):
    df = layer(spark, sf_dir, "metric_boxes")
    return op.buffer_hint(df.withColumn("area", F.expr("(maxx - minx) * (maxy - miny)")))


@query(
    "a3_mean_min",
    f"""{DIRTY} SELECT 'v' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS n_missing,
round(avg(v) FILTER (WHERE NOT isnan(v)), 6) AS mean, min(v) FILTER (WHERE NOT isnan(v)) AS min,
max(v) FILTER (WHERE NOT isnan(v)) AS max FROM dirty
UNION ALL SELECT 'few', count(*), 0, round(avg(few), 6), min(few), max(few) FROM dirty""",
)
def a3_mean_min(spark, sf_dir):
    return op.column_statistics(layer(spark, sf_dir, "dirty"), ["v", "few"]).withColumn("mean", F.round("mean", 6))


@query(
    "a4_distinct",
    f"{DIRTY} SELECT count(DISTINCT v) FILTER (WHERE NOT isnan(v)) AS v, count(DISTINCT few) AS few, count(DISTINCT segment) AS segment FROM dirty",
)
def a4_distinct(spark, sf_dir):
    return op.distinct_counts(layer(spark, sf_dir, "dirty"), ["v", "few", "segment"])


@query(
    "a5_mode",
    """WITH cells AS (SELECT 'l_shipmode' AS c, l_returnflag AS v FROM lineitem WHERE FALSE
UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem),
counts AS (SELECT c, v, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY c, v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r, count(*) OVER (PARTITION BY c) AS d FROM counts)
SELECT c AS "column", v AS mode, n AS mode_rows, d AS n_distinct FROM ranked WHERE r = 1""",
)
def a5_mode(spark, sf_dir):
    return op.modes(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "a6_total_bounds",
    f"""{with_layers('boxes')} SELECT *, (minx + maxx) / 2 AS center_x, (miny + maxy) / 2 AS center_y FROM
(SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM boxes) AS t""",
)
def a6_total_bounds(spark, sf_dir):
    return op.total_bounds(layer(spark, sf_dir, "boxes"))


@query(
    "a7_missing_flags",
    f"""{DIRTY} SELECT 'v' AS "column", bool_or(v IS NULL OR isnan(v)) AS any_missing, bool_or(v IS NULL) AS any_null FROM dirty
UNION ALL SELECT 'segment', bool_or(segment IS NULL), bool_or(segment IS NULL) FROM dirty
UNION ALL SELECT 'few', bool_or(few IS NULL), bool_or(few IS NULL) FROM dirty""",
)
def a7_missing_flags(spark, sf_dir):
    return op.missing_flags(layer(spark, sf_dir, "dirty"), ["v", "segment", "few"])


@query(
    "a9_extremes",
    f"{DIRTY} SELECT min(v) AS lowest, max(v) AS highest FROM dirty WHERE NOT isnan(v)",
)
def a9_extremes(spark, sf_dir):
    return op.extremes(layer(spark, sf_dir, "dirty"), "v")


@query(
    "a10_median_rule",
    """SELECT l_suppkey, median(l_quantity) > 10 AS large FROM lineitem GROUP BY l_suppkey""",
)
def a10_median_rule(spark, sf_dir):
    return large_areas(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query("a11_all_null", f"{with_layers('nongeo')} SELECT _unique_id, __file_path, event_id, event_type, value FROM nongeo")
def a11_all_null(spark, sf_dir):
    return op.drop_all_null(layer(spark, sf_dir, "nongeo"))


@query(
    "a12_agg_broadcast",
    "SELECT l_orderkey, l_linenumber, l_quantity, round(sum(l_quantity) OVER (), 2) AS quantity_sum, "
    "max(l_shipdate) OVER () AS last_ship FROM lineitem",
)
def a12_agg_broadcast(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    out = with_totals(df, quantity_sum=F.round(F.sum("l_quantity"), 2), last_ship=F.max("l_shipdate"))
    return out.drop("l_shipdate")


@query(
    "a13_layer_sizes",
    f"""{with_layers('listing')} SELECT regexp_extract(name, '^/data/[^/]+', 0) AS layer, CAST(sum(size) AS BIGINT) AS total_size,
sum(size) > 100000000 AS is_large FROM listing GROUP BY ALL""",
)
def a13_layer_sizes(spark, sf_dir):
    files = layer(spark, sf_dir, "listing").withColumn("layer", F.regexp_extract("name", "^/data/[^/]+", 0))
    return op.layer_sizes(files)


@query(
    "a14_profile",
    """WITH cells AS (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem), means AS (SELECT c, avg(v) AS m FROM cells GROUP BY c)
SELECT c AS "column", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing, round(avg(v), 4) AS mean, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max,
count(*) FILTER (WHERE v > m) AS n_above_mean FROM cells JOIN means USING (c) GROUP BY c""",
)
def a14_profile(spark, sf_dir):
    df = op.profile_layer(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])
    return df.withColumn("mean", F.round("mean", 4))


@query(
    "a14_suggestions",
    """WITH m AS (SELECT avg(o_totalprice) AS p, avg(o_custkey) AS c, avg(o_orderkey) AS k FROM orders)
SELECT NULL AS "column", 'default' AS rule, (SELECT count(*) FROM orders) AS n_rows
UNION ALL SELECT 'o_totalprice', 'above mean', (SELECT count(*) FROM orders, m WHERE o_totalprice > p)
UNION ALL SELECT 'o_custkey', 'above mean', (SELECT count(*) FROM orders, m WHERE o_custkey > c)
UNION ALL SELECT 'o_orderkey', 'above mean', (SELECT count(*) FROM orders, m WHERE o_orderkey > k)
UNION ALL SELECT 'o_orderstatus', 'mode', (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus) AS t)
UNION ALL SELECT 'o_orderdate', 'mode', (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderdate) AS t)
UNION ALL SELECT 'o_orderpriority', 'mode', (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) AS t)""",
)
def a14_suggestions(spark, sf_dir):
    return op.suggest_queries(table(spark, sf_dir, "orders")).select("column", "rule", "n_rows")


@query("o2_table_budget", "SELECT TRUE AS over_small, count(*) * 3 > 500000000 AS over_large, FALSE AS with_limit FROM lineitem")
def o2_table_budget(spark, sf_dir):
    """Whether a table view of three columns may hold a table, and a query with a limit."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    found = {
        "over_small": op.exceeds_table_budget(df, budget=3000),
        "over_large": op.exceeds_table_budget(df, budget=500_000_000),
        "with_limit": op.exceeds_table_budget(df, "SELECT * FROM df LIMIT 5", budget=3000),
    }
    return df.limit(1).select(*[F.lit(v).alias(k) for k, v in found.items()])


@query(
    "w3_sample",
    f"""{with_layers('points')} SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey
ORDER BY md5(concat('7|', _unique_id)), _unique_id) AS r FROM points) AS ranked WHERE r <= 20""",
)
def w3_sample(spark, sf_dir):
    df = layer(spark, sf_dir, "points")
    return sample_per_layer(df, "c_nationkey", "_unique_id", 20, 7).select("c_custkey", "c_nationkey")


@query(
    "w3_sample_one_layer",
    """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('0|', CAST(l_orderkey AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR), '.', CAST(l_partkey AS VARCHAR))),
l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) AS ranked WHERE r <= 10000""",
)
def w3_sample_one_layer(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "'all' AS layer",
        "concat(CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING), '.', CAST(l_partkey AS STRING)) AS id",
    )
    return sample_per_layer(df, "layer", "id", 10_000).select("l_orderkey", "l_linenumber")


@query(
    "w3_hidden_rows",
    f"{with_layers('points')} SELECT c_mktsegment, count(*) AS n_rows, count(*) > 300 AS rows_are_hidden FROM points GROUP BY c_mktsegment",
)
def w3_hidden_rows(spark, sf_dir):
    return hidden_rows(layer(spark, sf_dir, "points"), "c_mktsegment", 300)


@query(
    "o1_topk",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def o1_topk(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    mean = df.agg(F.avg("o_totalprice")).scalar()
    return df.filter(F.col("o_totalprice") > mean).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    "a8_legend_values",
    f"{with_layers('points')} SELECT DISTINCT c_mktsegment AS value FROM points WHERE x <= 14 AND x >= 9 AND y <= 62 AND y >= 59",
)
def a8_legend_values(spark, sf_dir):
    from geoquarry.operators.classify import visible_values

    return visible_values(point_layer(spark, sf_dir), "c_mktsegment", VIEWPORT)


@query(
    "s14_file_stats",
    f"""{with_layers('boxes')} SELECT __file_path, count(*) AS n_rows, min(minx) AS minx, min(miny) AS miny,
max(maxx) AS maxx, max(maxy) AS maxy FROM boxes GROUP BY __file_path""",
)
def s14_file_stats(spark, sf_dir):
    return op.file_statistics(layer(spark, sf_dir, "boxes"))
