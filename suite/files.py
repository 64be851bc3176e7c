"""File inventory, readers, writers and streaming."""

from pyspark.sql import functions as F

from geoquarry.functions import geometry as geo
from geoquarry.functions.crs import reproject_xy
from geoquarry.functions.text import match_terms
from geoquarry.functions.wkb import to_wkb
from geoquarry.operators.prepare import with_hash_ids, with_split_index, with_unique_id
from geoquarry.operators.profile import file_statistics
from geoquarry.session import scratch_path
from geoquarry.sources import geoparquet, listing, readers, sinks
from geoquarry.sources import inventory as op
from geoquarry.sources import zones as zone
from geoquarry.streaming import ingest, state

from .base import VIEWPORT, layer, point_layer, query, table, with_layers
from .classes import BEST3, _sums

LISTING = with_layers("listing")


def mixed_folder(spark, sf_dir, blank=True):
    """The customers in part files of other types and columns, an empty one and one of noise."""
    target = scratch_path(spark, "my files" if blank else "mixed")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    text = df.filter("c_custkey % 3 = 1").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    small = df.filter("c_custkey % 3 = 2").withColumn("c_nationkey", F.col("c_nationkey").cast("short"))
    for part in (
        df.filter("c_custkey % 3 = 0").drop("c_acctbal"),
        text,
        small.withColumn("extra", F.col("c_custkey") % 5),
    ):
        part.coalesce(2).write.mode("append").parquet(target)
    noise = spark.createDataFrame([("no parquet here",)], "value string")
    noise.coalesce(1).write.mode("append").text(target)
    return target


@query(
    "s8_mixed_files",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS c_acctbal,
CAST(c_nationkey AS BIGINT) AS nation, CASE WHEN c_custkey % 3 = 2 THEN c_custkey % 5 END AS extra FROM customer""",
)
def s8_mixed_files(spark, sf_dir):
    """Every row of files whose columns and types differ."""
    rows = readers.read_parquet(spark, mixed_folder(spark, sf_dir))
    return rows.select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("long").alias("nation"), "extra"
    )


@query("s11_skips_reported", "SELECT 'not a parquet file' AS error, count(DISTINCT 1) AS n_files, 1 AS has_rows FROM customer")
def s11_skips_reported(spark, sf_dir):
    """The file of noise is named, and the other files have their rows."""
    target = mixed_folder(spark, sf_dir)
    has_rows = readers.read_parquet(spark, target).agg(F.max(F.lit(1)).alias("has_rows"))
    skipped = readers.skipped_files(spark, target).groupBy("error").agg(F.count("*").alias("n_files"))
    return skipped.join(F.broadcast(has_rows))  # one row each


@query(
    "p7_file_path",
    """SELECT CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS part, count(*) AS n_rows, TRUE AS is_listed
FROM customer GROUP BY ALL""",
)
def p7_file_path(spark, sf_dir):
    """Paths of rows are those of the listing, also below a folder with a blank in its name."""
    target = scratch_path(spark, "my paths")
    df = table(spark, sf_dir, "customer").withColumn(
        "part", F.element_at(F.array(*map(F.lit, "abc")), (F.col("c_custkey") % 3 + 1).cast("int"))
    )
    df.write.partitionBy("part").parquet(target)
    rows = readers.read_parquet(spark, target)
    listed = op.list_files(spark, target).select(F.col("name").alias("__file_path"), F.lit(True).alias("listed"))
    found = rows.join(listed, "__file_path", "left")
    return found.groupBy("part").agg(
        F.count("*").alias("n_rows"), F.bool_and(F.coalesce("listed", F.lit(False))).alias("is_listed")
    )


@query(
    "p6_ids_csv",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, 0 AS n_null FROM customer",
)
def p6_ids_csv(spark, sf_dir):
    """Each row of a CSV folder has an id of its own."""
    target = scratch_path(spark, "my csv") + ".csv"
    table(spark, sf_dir, "customer").write.option("header", True).csv(target)
    rows = with_hash_ids(readers.read_table(spark, target))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("_unique_id").alias("n_ids"),
        F.count_if(F.col("_unique_id").isNull()).alias("n_null"),
    )


@query("p10_conflicts", "SELECT 'c_custkey' AS \"column\", 2 AS n_types FROM customer LIMIT 1")
def p10_conflicts(spark, sf_dir):
    """Columns whose type differs between the files of a layer; the two widths of integers are one."""
    catalogue = readers.file_catalogue(spark, mixed_folder(spark, sf_dir))
    found = op.schema_conflicts(catalogue)
    return found.filter("column = 'c_custkey'").select("column", F.size("types").alias("n_types"))


@query(
    "s15_prune_metric",
    f"""{with_layers('points')} SELECT _unique_id FROM points WHERE x BETWEEN 8 AND 10 AND y BETWEEN 70 AND 71""",
)
def s15_prune_metric(spark, sf_dir):
    """Files whose boxes are in metres and lie across the central meridian of their zone."""
    target = scratch_path(spark, "metric")
    rows = reproject_xy(point_layer(spark, sf_dir).selectExpr("*", "x AS mx", "y AS my"), "mx", "my", 4326, 25832)
    sinks.write_layer(rows, target, cell=9.0, files=4)
    metric = file_statistics(
        readers.read_parquet(spark, target).withColumns({"minx": F.col("mx"), "maxx": F.col("mx"), "miny": F.col("my"), "maxy": F.col("my")})
    )
    stats = readers.stats_to_4326(metric, 25832)
    return readers.read_in_bounds(spark, target, stats, (8, 70, 10, 71)).select("_unique_id")


@query("s1_list_files", "SELECT DISTINCT concat('nation=', CAST(c_nationkey AS VARCHAR)) AS directory, 'file' AS type FROM customer")
def s1_list_files(spark, sf_dir):
    """Write the points by nation and list what was written."""
    target = scratch_path(spark, "list")
    points = layer(spark, sf_dir, "points").withColumnRenamed("c_nationkey", "nation")
    points.write.partitionBy("nation").parquet(target)
    files = op.search(op.list_files(spark, target), ".parquet")
    return files.select(F.regexp_extract("name", r"(nation=\d+)/[^/]*$", 1).alias("directory"), "type").distinct()


@query(
    "s1_one_level",
    """SELECT concat('/nation=', CAST(c_nationkey AS VARCHAR)) AS entry, 'directory' AS type, 0 AS size, TRUE AS untimed, TRUE AS same_below
FROM customer GROUP BY ALL""",
)
def s1_one_level(spark, sf_dir):
    """The folders of one level; below them sizes and times are those of the recursive listing."""
    target = scratch_path(spark, "level")
    points = layer(spark, sf_dir, "points").withColumnRenamed("c_nationkey", "nation")
    points.write.partitionBy("nation").parquet(target)
    level = listing.list_level(spark, target)
    key = [F.regexp_replace("name", "/[^/]*$", "").alias("folder"), "name", "size", "updated"]
    below = listing.list_folders(level.filter("type = 'directory'")).select(*key, F.lit(True).alias("below"))
    whole = op.list_files(spark, target).select(*key)
    both = below.join(whole, ["folder", "name", "size", "updated"], "full")
    alike = both.groupBy("folder").agg(
        (F.count("below") == F.count(F.lit(1))).alias("all_listed"), F.count("below").alias("n_below")
    )
    n_whole = whole.groupBy("folder").agg(F.count(F.lit(1)).alias("n_whole"))
    found = level.join(alike.join(n_whole, "folder"), level["name"] == F.col("folder"), "left")
    return found.select(
        F.concat(F.lit("/"), F.element_at(F.split("name", "/"), -1)).alias("entry"),
        "type",
        "size",
        F.col("updated").isNull().alias("untimed"),
        (F.col("all_listed") & (F.col("n_below") == F.col("n_whole"))).alias("same_below"),
    )


@query(
    "s13_incremental_breaks",
    f"""{with_layers('dirty')}, {_sums('dirty', 'v')}, {BEST3}
SELECT CAST(0 AS BIGINT) AS idx, lo AS value FROM ends UNION ALL SELECT 1, b1 FROM best UNION ALL SELECT 2, b2 FROM best
UNION ALL SELECT 3, b3 FROM best""",
)
def s13_incremental_breaks(spark, sf_dir):
    """Breaks of a layer whose files come in two visits, from the summaries of its rounds."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "grown", "check"))
    rows = layer(spark, sf_dir, "dirty").select("c_custkey", "v")
    for odd in (0, 1):
        rows.filter(F.col("c_custkey") % 2 == odd).repartition(2).write.mode("append").parquet(source)
        stream = ingest.stream_files(spark, source, rows.schema, max_files=1)
        state.ingest_with_state(stream, target, checkpoint, ["v"])
    breaks = state.LayerState(spark, target).breaks("v", 3, max_bins=128)
    return spark.createDataFrame(list(enumerate(breaks)), "idx long, value double")


@query(
    "s2_match_terms",
    """SELECT doc_id FROM documents WHERE (contains(lower(text), 'data') OR contains(lower(text), 'the'))
AND (contains(lower(text), 'con') OR contains(lower(text), 'license')) AND contains(lower(text), 'an')""",
)
def s2_match_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter(match_terms(F.col("text"), "Data | the, con|License , an,", case_sensitive=False)).select("doc_id")


@query(
    "s2_search_listing",
    f"{LISTING} SELECT name, size FROM listing WHERE (contains(name, '2021') OR contains(name, '2022')) AND contains(name, 'set3')",
)
def s2_search_listing(spark, sf_dir):
    return op.search(layer(spark, sf_dir, "listing"), "2021|2022, set3").select("name", "size")


@query("s3_sort_listing", f"{LISTING} SELECT name, size, CASE WHEN size % 3 = 0 THEN NULL ELSE updated END AS updated FROM listing")
def s3_sort_listing(spark, sf_dir):
    listing = layer(spark, sf_dir, "listing").withColumn("updated", F.expr("CASE WHEN size % 3 = 0 THEN NULL ELSE updated END"))
    return op.sort_listing(listing, "updated").select("name", "size", "updated")


@query(
    "s4_dataset_rollup",
    f"""{LISTING}, parts AS (SELECT regexp_extract(name, '^(.*\\.parquet)/', 1) AS dataset, * FROM listing)
SELECT dataset, CAST(sum(size) AS BIGINT) AS size, max(updated) AS updated FROM parts WHERE dataset <> '' GROUP BY dataset""",
)
def s4_dataset_rollup(spark, sf_dir):
    return op.dataset_sizes(layer(spark, sf_dir, "listing"))


@query(
    "s5_loadable",
    f"""{LISTING}, dirs AS (SELECT DISTINCT regexp_extract(name, '^/data/[^/]+/[^/]+', 0) AS name FROM listing
UNION SELECT DISTINCT regexp_extract(name, '^/data/[^/]+', 0) FROM listing UNION SELECT '/data')
SELECT name, round(size / 1000000, 2) AS mb, TRUE AS is_loadable FROM listing
UNION ALL SELECT name, CAST(0 AS DOUBLE), regexp_matches(name, '\\.(parquet|tif|txt)$') FROM dirs""",
)
def s5_loadable(spark, sf_dir):
    return op.loadable(op.with_directories(layer(spark, sf_dir, "listing")))


@query(
    "s6_layer_files",
    f"{LISTING} SELECT name, size FROM listing WHERE starts_with(name, '/data/year=2021/set1.parquet/')",
)
def s6_layer_files(spark, sf_dir):
    return op.layer_files(layer(spark, sf_dir, "listing"), "/data/year=2021/set1.parquet")


@query("s7_row_slice", "SELECT event_id, event_type FROM events WHERE event_id BETWEEN 4000 AND 7999")
def s7_row_slice(spark, sf_dir):
    """The second batch of 4,000 rows of a file; row n of the file has event id n."""
    events = readers.read_parquet(spark, f"{sf_dir}/events.parquet")
    return readers.row_slice(events, 4000, 1).select("event_id", "event_type")


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("s8_footers", " UNION ALL ".join(f"SELECT '{t}' AS layer, count(*) AS n_rows FROM {t}" for t in TABLES))
def s8_footers(spark, sf_dir):
    """Rows of every table, from the footers of all files of the folder."""
    files = op.search(op.list_files(spark, sf_dir), ".parquet")
    found = readers.read_footers(spark, files)
    layer_name = F.regexp_extract("__file_path", r"([a-z]+)\.parquet", 1).alias("layer")
    return found.groupBy(layer_name).agg(F.sum("n_rows").alias("n_rows"))


@query("s9_csv", "SELECT c_custkey, c_mktsegment, c_acctbal, CAST(NULL AS DOUBLE) AS minx FROM customer")
def s9_csv(spark, sf_dir):
    target = scratch_path(spark, "customers") + ".csv"
    table(spark, sf_dir, "customer").write.option("header", True).csv(target)
    back = readers.read_table(spark, target, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return back.select("c_custkey", "c_mktsegment", "c_acctbal", "minx")


@query(
    "s10_geojson",
    f"{with_layers('points')} SELECT _unique_id, x AS minx, y AS maxy, CAST(0 AS DOUBLE) AS area FROM points",
)
def s10_geojson(spark, sf_dir):
    target = scratch_path(spark, "points") + ".geojson"
    points = layer(spark, sf_dir, "points").withColumn("geometry", to_wkb(geo.point(F.col("x"), F.col("y"))))
    sinks.write_geojson_lines(points, target)
    back = readers.read_geojson(spark, target, "_unique_id string", lines=True)
    return back.select("_unique_id", "minx", "maxy", "area")


@query(
    "s10_geojson_inferred",
    f"{with_layers('points')} SELECT c_mktsegment, count(*) AS n, sum(c_custkey) AS keys, max(x) AS right_most FROM points GROUP BY c_mktsegment",
)
def s10_geojson_inferred(spark, sf_dir):
    """Properties and their types come from the features."""
    target = scratch_path(spark, "inferred") + ".geojson"
    place = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    feature = F.struct(F.struct("c_mktsegment", "c_custkey").alias("properties"), place.alias("geometry"))
    layer(spark, sf_dir, "points").select(F.to_json(feature)).write.text(target)
    back = readers.read_geojson(spark, target, lines=True)
    return back.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.max("maxx").alias("right_most")
    )


@query("s13_stream_ingest", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def s13_stream_ingest(spark, sf_dir):
    """Read the event file as a stream into a parquet layer, then count what arrived."""
    schema = table(spark, sf_dir, "events").schema
    target = scratch_path(spark, "ingest")
    stream = ingest.stream_files(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    ingest.ingest(stream, f"{target}/data", f"{target}/checkpoint")
    arrived = spark.read.parquet(f"{target}/data")
    return arrived.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    "s15_prune_files",
    f"{with_layers('points')} SELECT _unique_id, c_custkey FROM points WHERE x <= 14 AND x >= 9 AND y <= 62 AND y >= 59",
)
def s15_prune_files(spark, sf_dir):
    """Write the points by place, then read the viewport from the files that can hold it."""
    target = scratch_path(spark, "placed")
    sinks.write_layer(point_layer(spark, sf_dir), target, cell=2.0, files=8)
    stats = file_statistics(readers.read_parquet(spark, target))
    found = readers.read_in_bounds(spark, target, stats, VIEWPORT)
    return found.select("_unique_id", "c_custkey")


@query(
    "s15_surviving_files",
    f"""{with_layers('points')} SELECT __file_path FROM points GROUP BY __file_path
HAVING min(x) <= 4.5 AND max(x) >= 4.0 AND min(y) <= 57.5 AND max(y) >= 57""",
)
def s15_surviving_files(spark, sf_dir):
    stats = file_statistics(point_layer(spark, sf_dir))
    return readers.surviving_files(stats, (4.0, 57.0, 4.5, 57.5)).select("__file_path")


@query(
    "s15_zone_map",
    f"{with_layers('points')} SELECT _unique_id, c_custkey FROM points WHERE x <= 14 AND x >= 9 AND y <= 62 AND y >= 59",
)
def s15_zone_map(spark, sf_dir):
    """The viewport from files with a row group in it, as the zone map of the layer knows them."""
    target = scratch_path(spark, "zoned")
    sinks.write_layer(point_layer(spark, sf_dir), target, cell=2.0, files=8)
    zones = zone.zone_map(spark, target, scratch_path(spark, "zones"))
    return zone.read_in_zones(spark, target, zones, VIEWPORT).select("_unique_id", "c_custkey")


@query(
    "s14_zone_statistics",
    f"""{with_layers('points')} SELECT CAST(c_nationkey % 5 AS INTEGER) AS part, count(*) AS n_rows, min(x) AS minx, min(y) AS miny,
max(x) AS maxx, max(y) AS maxy FROM points GROUP BY ALL""",
)
def s14_zone_statistics(spark, sf_dir):
    """Rows and boxes of folders, from the footers of their files, without reading a row."""
    target = scratch_path(spark, "by part")
    rows = point_layer(spark, sf_dir).withColumn("part", (F.col("c_nationkey") % 5).cast("int"))
    rows.write.partitionBy("part").parquet(target)
    stats = zone.zone_statistics(zone.zone_map(spark, target, scratch_path(spark, "zones")))
    part = F.regexp_extract("__file_path", r"part=(\d+)/", 1).cast("int").alias("part")
    return stats.groupBy(part).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.min(c).alias(c) for c in ("minx", "miny")],
        *[F.max(c).alias(c) for c in ("maxx", "maxy")],
    )


NUMBERED = """WITH numbered AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)"""


def _sorted_events(spark, sf_dir):
    """Events in one text file's order."""
    return table(spark, sf_dir, "events").select("event_id", "event_type").repartition(1).sortWithinPartitions("event_id")


@query(
    "p9_split_csv",
    f"{NUMBERED} SELECT event_id, concat('events ', CAST(n + 1 AS VARCHAR)) AS split_index FROM numbered",
)
def p9_split_csv(spark, sf_dir):
    """Running counts along a CSV file that several tasks read."""
    target = scratch_path(spark, "csv") + ".csv"
    _sorted_events(spark, sf_dir).write.option("header", True).csv(target)
    rows = readers.read_table(spark, target, "event_id long, event_type string", positions=True)
    named = rows.withColumn("__file_path", F.concat(F.lit(target), F.lit("/events.csv")))
    return with_split_index(named).select("event_id", "split_index")


@query(
    "p6_ids_geojson",
    f"{NUMBERED} SELECT event_id, concat('0.', CAST(n AS VARCHAR)) AS _unique_id FROM numbered",
)
def p6_ids_geojson(spark, sf_dir):
    """File and row number as ids of features, one to a line."""
    target = scratch_path(spark, "features") + ".geojson"
    point = F.lit('{"type": "Feature", "geometry": {"type": "Point", "coordinates": [10.5, 60.25]}, "properties": {"event_id": ')
    _sorted_events(spark, sf_dir).select(F.concat(point, F.col("event_id").cast("string"), F.lit("}}"))).write.text(target)
    rows = readers.read_geojson(spark, target, "event_id long", lines=True, positions=True)
    return with_unique_id(rows).select("event_id", "_unique_id")


@query(
    "s8_geoparquet_layer",
    f"""{with_layers('points')} SELECT c_custkey, round(x, 6) AS minx, round(y, 6) AS maxy, CAST(0 AS DOUBLE) AS area,
CASE WHEN c_nationkey = 7 THEN c_acctbal END AS extra_7 FROM points""",
)
def s8_geoparquet_layer(spark, sf_dir):
    """Two folders of files in two CRSs under differing column names, each file by its footer."""
    target = scratch_path(spark, "geo")
    rows = layer(spark, sf_dir, "points").select("c_custkey", "c_nationkey", "x", "y", F.col("c_acctbal").alias("extra"))
    metric = reproject_xy(rows.selectExpr("*", "x AS mx", "y AS my"), "mx", "my", 4326, 25832)
    for part in (0, 1, 7):
        mine = (F.col("c_nationkey") == 7) if part == 7 else (F.col("c_nationkey") != 7) & (F.col("c_nationkey") % 2 == part)
        x, y, name, crs = ("mx", "my", "shape", "EPSG:25832") if part == 1 else ("x", "y", "geometry", "EPSG:4326")
        wkb = to_wkb(geo.point(F.col(x), F.col(y))).alias(name)
        extra = [F.col("extra").alias("extra_7")] if part == 7 else []
        geoparquet.write_geoparquet(metric.filter(mine).select("c_custkey", *extra, wkb), target, crs, name)
    found = geoparquet.read_geoparquet(spark, target)
    return found.select(
        "c_custkey", F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"), "area", "extra_7"
    )
