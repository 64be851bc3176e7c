"""Listing in tasks, mergeable summaries, layers that grow, axes of rasters."""

from functools import reduce

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.operators import classify, raster
from geoquarry.sources import inventory, listing
from geoquarry.streaming.ingest import stream_files
from geoquarry.streaming.state import LayerState, ingest_with_state


def names(df, root):
    return sorted((r["name"].removeprefix(str(root)), r["type"]) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "my data"
    for path in ("a.txt", "part=1/b.txt", "part=1/deep/c.txt", "part=2/d.txt", "_hidden", "_x=1/e.txt", ".f"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    (root / "empty").mkdir()
    return root


def test_level_has_its_entries_alone(spark, folder):
    assert names(listing.list_level(spark, str(folder)), folder) == [
        ("/_x=1", "directory"), ("/a.txt", "file"), ("/empty", "directory"),
        ("/part=1", "directory"), ("/part=2", "directory"),
    ]
    assert names(listing.list_level(spark, f"{folder}/empty/"), folder) == []
    assert ("/_hidden", "file") in names(listing.list_level(spark, str(folder), hidden=True), folder)
    with pytest.raises(PySparkException):
        listing.list_level(spark, f"{folder}/none").collect()


@pytest.mark.parametrize("per_task", [1, 256])
def test_tree_agrees_with_recursive_listing(spark, folder, per_task):
    tree = listing.list_tree(spark, str(folder), folders_per_task=per_task)
    files = tree.filter("type = 'file'").select("name", "size", "updated", "type")
    other = inventory.list_files(spark, str(folder)).select(*files.columns)
    assert sorted(files.collect()) == sorted(other.collect())
    folders = names(tree.filter("type = 'directory'"), folder)
    assert ("/part=1/deep", "directory") in folders and ("/empty", "directory") in folders
    shallow = listing.list_tree(spark, str(folder), depth=2)
    assert "/part=1/deep/c.txt" not in dict(names(shallow, folder))
    assert "/part=1/deep" in dict(names(shallow, folder))


def test_folders_gone_have_no_entries(spark, folder):
    rows = spark.createDataFrame([(str(folder / "part=2"),), (str(folder / "gone"),)], "name string")
    assert names(listing.list_folders(rows), folder) == [("/part=2/d.txt", "file")]


@pytest.mark.parametrize("offset", [0.0, 1e6, -5e8])
def test_summaries_of_parts_add_up(spark, offset):
    df = spark.range(3000).select(
        (F.lit(offset) + F.pow((F.col("id") * 7919) % 3001, F.lit(1.3)) * F.lit(0.37) - 900).alias("v"), (F.col("id") % 5).alias("part")
    )
    odd = spark.createDataFrame([(float("nan"), 0), (None, 1), (float("inf"), 2), (0.0, 3), (-0.0, 4)], "v double, part long")
    df = df.unionByName(odd.filter("v IS NULL OR v != 0" if offset else "true"))
    whole = {r["bin"]: r for r in classify.value_bins(df, "v").collect()}
    parts = [classify.value_bins(df.filter(F.col("part") == p), "v") for p in range(5)]
    merged = classify.merge_bins(reduce(DataFrame.unionByName, parts))
    for row in merged.collect():
        same = whole.pop(row["bin"])
        assert (row["n"], row["low"], row["high"]) == (same["n"], same["low"], same["high"])
        assert row["s"] == pytest.approx(same["s"]) and row["q"] == pytest.approx(same["q"])
    assert not whole
    for k in (2, 5):
        breaks = classify.breaks_from_bins(merged, df, "v", k, 64)
        assert breaks == classify.natural_breaks(df, "v", k)
        assert len(breaks) == k + 1


def test_bins_cover_all_doubles(spark):
    values = [5e-324, -5e-324, 2.2e-308, 1.7976931348623157e308, 0.0, 1.0, -1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = classify.value_bins(df, "v").orderBy("bin").collect()
    assert [r["low"] for r in rows] == sorted(values)
    assert classify.value_bins(df.filter("false"), "v").collect() == []


def stream(spark, source):
    return stream_files(spark, source, "v double, f string", max_files=1).withColumn("__file_path", F.col("f"))


def test_growing_layer_after_a_failure_is_the_batch(spark, tmp_path, monkeypatch):
    import geoquarry.streaming.state as state

    monkeypatch.setattr(state, "ROUNDS_PER_MERGE", 3)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "layer", "check"))
    rows = spark.range(4000).select(
        (F.pow((F.col("id") * 7919) % 4001, F.lit(1.3)) * F.lit(0.25) - 300).alias("v"), F.concat(F.lit("f"), F.col("id") % 5).alias("f")
    )
    for k in range(5):
        rows.filter(F.col("f") == f"f{k}").coalesce(1).write.mode("append").parquet(source)
    held = LayerState(spark, target)
    assert held.last_round() == -1 and held.breaks("v") == []

    write, torn = LayerState._write, []

    def fail_once(self, df, table, number):
        if (table, number) in {("bins", 1), ("merged", 3)} and (table, number) not in torn:
            torn.append((table, number))
            raise RuntimeError("lost")
        write(self, df, table, number)

    monkeypatch.setattr(LayerState, "_write", fail_once)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            ingest_with_state(stream(spark, source), target, checkpoint, ["v"])
        assert held.last_round() in (0, 3)
    ingest_with_state(stream(spark, source), target, checkpoint, ["v"])
    assert held.last_round() == 4 and held._rounds("merged") == [3]
    assert held.rows().count() == 4000
    assert {r["__file_path"]: r["n_rows"] for r in held.files().collect()} == dict.fromkeys([f"f{k}" for k in range(5)], 800)
    whole = {r["bin"]: r["n"] for r in classify.value_bins(rows, "v").collect()}
    assert {r["bin"]: r["n"] for r in held.bins("v").collect()} == whole
    for k in (3, 6):
        assert held.breaks("v", k, 128) == classify.natural_breaks(rows, "v", k)
    ingest_with_state(stream(spark, source), target, checkpoint, ["v"])
    assert held.rows().count() == 4000


def pixels(spark, xs, ys, raster_id=1):
    rows = [(raster_id, float(x), float(y), 1.0) for x in xs for y in ys]
    return spark.createDataFrame(rows, "raster_id int, x double, y double, value double")


def test_axis_numbers(spark):
    df = pixels(spark, [3, 1, 2], [5, 6]).unionByName(pixels(spark, [10, 20], [0], None))
    got = sorted((r["raster_id"] or 0, r["at"], r["number"]) for r in raster.axis(df, "x").collect())
    assert got == [(0, 10.0, 0), (0, 20.0, 1), (1, 1.0, 0), (1, 2.0, 1), (1, 3.0, 2)]


def test_uneven_axes_raise_and_rounding_does_not(spark):
    near = [0.1 * k for k in range(40)]
    found = raster.raster_bounds(pixels(spark, near, near, None)).first()
    assert found["resolution"] == pytest.approx(0.1) and found["raster_id"] is None
    for xs, ys in (([0, 1, 3, 4, 5.33], [0, 1, 2]), ([0, 1, 2, 3], [0, 0.5, 3])):
        with pytest.raises(PySparkException, match="uneven|unlike|differ"):
            raster.raster_bounds(pixels(spark, xs, ys)).collect()
    with pytest.raises(PySparkException, match="unevenly"):
        raster.raster_bounds(pixels(spark, [0, 1, 3, 3.9, 4], [0, 1, 2])).collect()


def test_bounds_do_not_expand_pixels(spark, capsys):
    raster.raster_bounds(pixels(spark, [0, 1], [0, 1])).explain()
    assert "Expand" not in capsys.readouterr().out


def test_joined_layer_without_rows_is_an_error(spark):
    from geoquarry.operators.filters import QueryError, try_query
    from geoquarry.operators.layer_sql import run_sql

    df = spark.createDataFrame([(1, "a")], "k int, v string")
    text = "SELECT df.k FROM df LEFT JOIN other USING (k)"
    assert run_sql(df, text, {"other": df}).count() == 1
    with pytest.raises(QueryError, match="other.*no rows"):
        run_sql(df, text, {"other": df.filter("k > 1")})
    # Layers that the query doesn't name may be empty, and so may its own.
    assert run_sql(df, "SELECT k FROM df", {"other": df.filter("k > 1")}).count() == 1
    assert run_sql(df.filter("k > 1"), text, {"other": df}).count() == 0
    kept, message = try_query(df, text, {"other": df.filter("k > 1")})
    assert kept.count() == 1 and "no rows" in message
