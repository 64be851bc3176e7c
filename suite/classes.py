"""Breaks, classes and colours."""

from pyspark.sql import functions as F

from geoquarry.functions import colors
from geoquarry.operators import classify as op

from .base import VIEWPORT, layer, point_layer, query, table, with_layers

DIRTY = with_layers("dirty")


def _sums(source: str, column: str) -> str:
    return f"""hist AS (SELECT {column} AS v, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE {column} IS NOT NULL AND NOT isnan({column}) GROUP BY 1),
sums AS (SELECT v, row_number() OVER (ORDER BY v) AS i, sum(n) OVER (ORDER BY v) AS n, sum(n * v) OVER (ORDER BY v) AS s, sum(n * v * v) OVER (ORDER BY v) AS q FROM hist),
ends AS (SELECT min(v) AS lo, max(v) AS hi, max(n) AS n FROM sums), last AS (SELECT * FROM sums ORDER BY i DESC LIMIT 1)"""


def _cost(low: str | None, high: str) -> str:
    if low is None:
        return f"({high}.q - {high}.s * {high}.s / {high}.n)"
    return f"({high}.q - {low}.q - ({high}.s - {low}.s) * ({high}.s - {low}.s) / ({high}.n - {low}.n))"


BEST3 = (
    "best AS (SELECT a.v AS b1, b.v AS b2, last.v AS b3, "
    f"{_cost(None, 'a')} + {_cost('a', 'b')} + {_cost('b', 'last')} AS cost "
    "FROM sums a JOIN sums b ON a.i < b.i JOIN last ON b.i < last.i ORDER BY cost LIMIT 1)"
)
BEST4 = (
    "best AS (SELECT a.v AS b1, b.v AS b2, c.v AS b3, last.v AS b4, "
    f"{_cost(None, 'a')} + {_cost('a', 'b')} + {_cost('b', 'c')} + {_cost('c', 'last')} AS cost "
    "FROM sums a JOIN sums b ON a.i < b.i JOIN sums c ON b.i < c.i JOIN last ON c.i < last.i ORDER BY cost LIMIT 1)"
)


def _breaks_table(spark, breaks):
    return spark.createDataFrame(list(enumerate(breaks)), "idx long, value double")


@query(
    "c1_breaks",
    f"""WITH {_sums('lineitem', 'l_quantity')}, {BEST4}
SELECT CAST(0 AS BIGINT) AS idx, lo AS value FROM ends UNION ALL SELECT 1, b1 FROM best UNION ALL SELECT 2, b2 FROM best
UNION ALL SELECT 3, b3 FROM best UNION ALL SELECT 4, b4 FROM best""",
)
def c1_breaks(spark, sf_dir):
    return _breaks_table(spark, op.natural_breaks(table(spark, sf_dir, "lineitem"), "l_quantity", 4))


@query(
    "c1_breaks_refined",
    f"""{DIRTY}, {_sums('dirty', 'v')}, {BEST3}
SELECT CAST(0 AS BIGINT) AS idx, lo AS value FROM ends UNION ALL SELECT 1, b1 FROM best UNION ALL SELECT 2, b2 FROM best
UNION ALL SELECT 3, b3 FROM best""",
)
def c1_breaks_refined(spark, sf_dir):
    """Many values in few bins, so the breaks come from repeated refinement."""
    return _breaks_table(spark, op.natural_breaks(layer(spark, sf_dir, "dirty"), "v", 3, max_bins=128))


@query("c2_few_values", f"{DIRTY} SELECT row_number() OVER (ORDER BY few) - 1 AS idx, CAST(few AS DOUBLE) AS value FROM (SELECT DISTINCT few FROM dirty) AS d")
def c2_few_values(spark, sf_dir):
    return _breaks_table(spark, op.natural_breaks(layer(spark, sf_dir, "dirty"), "few", 5))


CLASSED = f"""{DIRTY}, {_sums('dirty', 'v')}, {BEST3}, classed AS (
SELECT c_custkey, v, CASE WHEN v IS NULL OR isnan(v) THEN NULL WHEN v < b1 THEN 0 WHEN v < b2 THEN 1 WHEN v < b3 THEN 2 ELSE 3 END AS class_idx,
lo, b1, b2, b3 FROM dirty, best, ends)"""
RAMP4 = "[" + ", ".join(f"'{c}'" for c in ("#440154", "#31688e", "#35b779", "#fde725")) + "]"


@query("c3_classes", f"{CLASSED} SELECT c_custkey, class_idx, {RAMP4}[class_idx + 1] AS color FROM classed")
def c3_classes(spark, sf_dir):
    df = layer(spark, sf_dir, "dirty")
    classed = op.classify(df, "v", op.natural_breaks(df, "v", 3), 3)
    return classed.select("c_custkey", F.col("_class").alias("class_idx"), F.col("_color").alias("color"))


@query(
    "c4_legend",
    f"""{CLASSED} SELECT DISTINCT i AS class_idx, [lo, b1, b2, b3][i + 1] AS lower, [b1, b2, b3, b3][i + 1] AS upper,
concat(CAST(round([lo, b1, b2, b3][i + 1], 1) AS VARCHAR), ' - ', CAST(round([b1, b2, b3, b3][i + 1], 1) AS VARCHAR)) AS label,
{RAMP4}[i + 1] AS color FROM classed, range(4) AS r(i)""",
)
def c4_legend(spark, sf_dir):
    df = layer(spark, sf_dir, "dirty")
    return op.legend(spark, op.natural_breaks(df, "v", 3), 3).withColumn("class_idx", F.col("class_idx").cast("long"))


@query(
    "c5_ramp",
    f"""{DIRTY} SELECT c_custkey, ['#f7fcf5', '#c8e9c1', '#75c477', '#228a44', '#00441b'][CASE few WHEN 3 THEN 4 ELSE few END + 1] AS color FROM dirty""",
)
def c5_ramp(spark, sf_dir):
    """Four values in a ramp for five colours: the last class has the last colour."""
    df = layer(spark, sf_dir, "dirty")
    classed = op.classify(df, "few", op.natural_breaks(df, "few", 4), 4, "Greens")
    return classed.select("c_custkey", F.col("_color").alias("color"))


CATEGORY_SQL = f"""{DIRTY}, fresh AS (SELECT segment, row_number() OVER (ORDER BY segment) AS i FROM
(SELECT DISTINCT segment FROM dirty WHERE segment IS NOT NULL AND segment <> 'BUILDING') AS d)
SELECT [columns] CASE WHEN dirty.segment IS NULL THEN '#969696' WHEN dirty.segment = 'BUILDING' THEN '#006400'
ELSE [{', '.join(f"'{c}'" for c in colors.PALETTE)}][i + 1] END AS color FROM dirty LEFT JOIN fresh ON dirty.segment = fresh.segment"""


@query("c6_categorical", CATEGORY_SQL.replace("[columns]", "c_custkey,"))
def c6_categorical(spark, sf_dir):
    df = layer(spark, sf_dir, "dirty")
    mapping = op.category_colors(df, "segment", {"BUILDING": "darkgreen"})
    return op.classify_categories(df, "segment", mapping).select("c_custkey", F.col("_color").alias("color"))


@query("c6_legend", CATEGORY_SQL.replace("[columns]", "DISTINCT coalesce(dirty.segment, 'Missing') AS label,"))
def c6_legend(spark, sf_dir):
    df = layer(spark, sf_dir, "dirty")
    return op.category_legend(df, "segment", op.category_colors(df, "segment", {"BUILDING": "darkgreen"}))


@query(
    "c7_hashed_color",
    """WITH d AS (SELECT c_name, md5(c_name) AS m FROM customer),
rgb AS (SELECT c_name, m, CAST(concat('0x', substr(m, 1, 2)) AS INTEGER) AS r, CAST(concat('0x', substr(m, 3, 2)) AS INTEGER) AS g,
CAST(concat('0x', substr(m, 5, 2)) AS INTEGER) AS b FROM d)
SELECT c_name, concat('#', CASE WHEN abs(r - g) + abs(r - b) > 50 THEN substr(m, 1, 2)
ELSE lower(printf('%02x', (r + 128) % 256)) END, substr(m, 3, 4)) AS color FROM rgb""",
)
def c7_hashed_color(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_name", colors.hashed_color(F.col("c_name")).alias("color"))


@query(
    "c9_column_absent",
    f"""{with_layers('points', 'nongeo')}
SELECT _unique_id, '#969696' AS color FROM nongeo UNION ALL
SELECT _unique_id, CASE c_mktsegment WHEN 'BUILDING' THEN '#ff0000' ELSE '#0000ff' END FROM points""",
)
def c9_column_absent(spark, sf_dir):
    """Layers without the coloured column are drawn in the colour for missing values."""
    from geoquarry.operators.union import stack

    both = stack([
        layer(spark, sf_dir, "points").select("_unique_id", "c_mktsegment"),
        layer(spark, sf_dir, "nongeo").select("_unique_id"),
    ])
    named = dict.fromkeys(["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "blue") | {"BUILDING": "red"}
    colored = op.classify_categories(both, "c_mktsegment", op.category_colors(both, "c_mktsegment", named))
    return colored.select("_unique_id", F.col("_color").alias("color"))


@query(
    "c10_force_categorical",
    f"""{DIRTY} SELECT c_custkey, [{', '.join(f"'{c}'" for c in colors.PALETTE)}][few + 1] AS color FROM dirty""",
)
def c10_force_categorical(spark, sf_dir):
    df = layer(spark, sf_dir, "dirty")
    assert not op.is_numeric(df, "few", categorical=True)
    return op.classify_categories(df, "few", op.category_colors(df, "few")).select(
        "c_custkey", F.col("_color").alias("color")
    )


@query("c11_by_color", f"{CLASSED} SELECT {RAMP4}[class_idx + 1] AS _color, count(*) AS n FROM classed GROUP BY 1")
def c11_by_color(spark, sf_dir):
    df = layer(spark, sf_dir, "dirty")
    return op.color_groups(op.classify(df, "v", op.natural_breaks(df, "v", 3), 3))


NAMED = "red green blue"


@query(
    "c12_named_color",
    """SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN '#ff0000' WHEN 'green' THEN '#008000'
WHEN 'blue' THEN '#0000ff' END AS color FROM part""",
)
def c12_named_color(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", colors.named_color(F.split("p_name", " ")[0]).alias("color"))


@query(
    "c8_layer_color",
    f"""{with_layers('points', 'nongeo')} SELECT _unique_id, '{colors.PALETTE[0]}' AS color FROM points
UNION ALL SELECT _unique_id, '#ffd700' FROM nongeo""",
)
def c8_layer_color(spark, sf_dir):
    from geoquarry.plans.view import ViewSpec, build_view

    paths = {"/layers/customer_points.parquet": None, "/layers/events.csv": None}
    tables = {
        "/layers/customer_points.parquet": layer(spark, sf_dir, "points"),
        "/layers/events.csv": layer(spark, sf_dir, "nongeo"),
    }
    view = build_view(ViewSpec(paths, color_dict={"events": "gold"}, max_rows=10**9), tables)
    return view.features.select("_unique_id", F.col("_color").alias("color"))
