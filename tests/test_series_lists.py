"""Scans as one list a target: the same cells, and the same steps along them, as row by row."""

from pyspark.sql import functions as F
from test_hot_target import points

from skyweave.functions.numeric import rounded
from skyweave.operators import bands, windows


def test_lists_hold_the_cells_and_give_the_same_steps(spark):
    table = points(spark).where("target_id is not null")
    grid = bands.line_grid(spark, 750.0, 5000.0, 25.0)
    cells = bands.dual_scan(table, grid).select("target_id", "line_nm", "q", "support").localCheckpoint()
    lists = bands.series_of(bands.dual_scan(table, grid, packed=("q", "support"))).localCheckpoint()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lists.select("target_id", F.inline("cells"))) == rows(cells)
    maxima = lists.withColumn("maxima", windows.list_maxima("cells", "q"))
    assert rows(maxima.select("target_id", F.inline("maxima")).select("target_id", "line_nm", "q")) == rows(windows.local_maxima(cells, ["target_id"], "line_nm", "q").select("target_id", "line_nm", "q"))
    crossings = lists.select("target_id", windows.list_crossings("cells", "q", 4.0), F.array_max("cells.q"))
    assert rows(crossings) == rows(windows.up_crossings(cells, ["target_id"], "line_nm", "q", 4.0))
    index = lambda c: F.round((c["line_nm"] - 750.0) / 25.0)
    picks = maxima.select("target_id", F.posexplode(windows.list_picks("maxima", index, "q", 5, 4, 0.5)).alias("k", "p")).select("target_id", F.col("k") + 1, "p.i", "p.q")
    indexed = cells.select("target_id", F.round((F.col("line_nm") - 750.0) / 25.0).cast("long").alias("i"), "q")
    assert rows(picks) == rows(windows.nms_topk(indexed, ["target_id"], "i", "q", 5, 4, 0.5))
    near = lists.select("target_id", F.inline(windows.list_nearest("cells", "line_nm", "q", F.lit(2000.0), 80.0, 3))).select("target_id", "line_nm")
    want = windows.nearest_k(cells.where("abs(line_nm - 2000) <= 80"), ["target_id"], F.abs(F.col("line_nm") - 2000.0), [F.col("line_nm")], 3)
    assert rows(near) == rows(want.select("target_id", "line_nm"))


def test_a_scan_has_more_partitions_for_more_input(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/some points"
    points(spark).write.parquet(path)
    table, least = spark.read.parquet(path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bands._parts(table) == least
    monkeypatch.setattr(bands, "PART_BYTES", 1000)
    assert bands._parts(table) > least
    scores = bands.dual_scan(table, bands.line_grid(spark, 800.0, 4900.0, 410.0))
    assert scores.rdd.getNumPartitions() == bands._parts(table)


def test_rounding_without_decimals(spark):
    values = [(0.125, 0.13), (-0.125, -0.13), (1e300, 1e300), (2.5, 2.5), (0.0, 0.0), (None, None), (float("inf"), float("inf"))]
    rows = spark.createDataFrame(values, "a double, b double").select(rounded(F.col("a"), 2).alias("r"), "b").collect()
    assert all(r.r == r.b for r in rows)
    assert spark.createDataFrame([(float("nan"),)], "a double").select(F.isnan(rounded(F.col("a"), 2))).first()[0]
