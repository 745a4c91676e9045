"""Projection with distortion, written catalogs and what of them is read, pruned shards."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import projection
from skyweave.plans import frame_queries
from skyweave.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_pixels_come_back_through_the_sky(t):
    """Pixel to sky by the forward polynomial, sky to pixel by its inverse."""
    grid = t.view("sip_frames").crossJoin(t.spark.range(0, 121).select((F.col("id") % 11 * 102.0 + 1.0).alias("px"), (F.floor(F.col("id") / 11) * 99.0 + 1.0).alias("py")))
    wcs = {k: F.col(k) for k in projection.WCS}
    terms = lambda side: {x: F.col(f"{side}_{x[0]}{x[1]}") for x in projection.sip_terms(3)}
    ra, dec = sky.pixel_to_world(F.col("px"), F.col("py"), wcs, terms("a"), terms("b"))
    back = projection.project(grid.withColumns({"ra": ra, "dec": dec}))
    worst = back.agg(F.max(F.abs(F.col("x_pix") - F.col("px"))).alias("x"), F.max(F.abs(F.col("y_pix") - F.col("py"))).alias("y"), F.min("status").alias("s"), F.count_if(F.col("x_pix").isNull()).alias("n")).first()
    assert worst.x < 1e-6 and worst.y < 1e-6 and worst.s == "in_frame" and worst.n == 0
    # the distortion matters: without it places are off by pixels
    plain = projection.project(grid.withColumns({"ra": ra, "dec": dec}).drop(*(f"{s}_{p}{q}" for s in "ab" for p, q in projection.sip_terms(3))))
    assert plain.agg(F.max(F.abs(F.col("x_pix") - F.col("px")))).first()[0] > 0.5


def test_projection_without_distortion_is_the_tangent_plane(spark):
    rows = [(f"f{k}", 10.0 + k, 20.0, 100.0, 50.0, -0.01, 0.0, 0.0, 0.01, 200, 100, 10.0 + k + dx, 20.0 + dy) for k in range(3) for dx in (-0.5, 0.0, 1.2, 180.0) for dy in (-0.4, 0.3)]
    df = spark.createDataFrame(rows, "frame_id string, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double, naxis1 int, naxis2 int, ra double, dec double")
    x, y = sky.world_to_pixel(F.col("ra"), F.col("dec"), {k: F.col(k) for k in projection.WCS})
    wanted = df.select("frame_id", "ra", "dec", x.alias("x"), y.alias("y"))
    got = {(r.frame_id, r.ra, r.dec): r for r in projection.project(df).collect()}
    for r in wanted.collect():
        g = got[r.frame_id, r.ra, r.dec]
        if r.x is None:
            assert (g.status, g.x_pix, g.edge_distance_pix) == ("behind", None, None)
        else:
            assert abs(g.x_pix - r.x) < 1e-9 and abs(g.y_pix - r.y) < 1e-9
            assert g.status == ("in_frame" if 1 <= r.x <= 200 and 1 <= r.y <= 100 else "outside")
    zero = projection.project(df, one_based=False).collect()
    assert all(abs(z.x_pix + 1.0 - got[z.frame_id, z.ra, z.dec].x_pix) < 1e-9 for z in zero if z.x_pix is not None)


def test_a_distortion_without_inverse_is_said(spark):
    df = spark.createDataFrame([("f", 0.0, 0.0, 1.0, 1.0, 0.01, 0.0, 0.0, 0.01, 9, 9, 3.0, 0.0, 0.01)], "frame_id string, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double, naxis1 int, naxis2 int, ra double, dec double, a_20 double")
    assert projection.project(df.withColumn("a_20", F.lit(-0.01))).first().status == "not_converged"


def test_scalar_and_vector_propagation_agree(spark):
    """Proper motion of one literal and of a column of stars gives the same place."""
    stars = [(10.0, 20.0, 2016.0, 100.0, -50.0), (359.9999, -89.0, 2016.0, 5000.0, 10.0), (180.0, 0.0, None, 1.0, 1.0), (45.0, 60.0, 2015.5, None, 3.0)]
    df = spark.createDataFrame(stars, "ra double, dec double, epoch double, pmra double, pmdec double")
    many = df.select("*", *(c.alias(n) for n, c in sky.propagate(F.col("ra"), F.col("dec"), F.col("epoch"), F.col("pmra"), F.col("pmdec"), F.lit(60000.0)).items())).collect()
    for r in many:
        one = spark.range(1).select(*(c.alias(n) for n, c in sky.propagate(*(F.lit(v).cast("double") for v in (r.ra, r.dec, r.epoch, r.pmra, r.pmdec)), F.lit(60000.0)).items())).first()
        assert (one.ra_obs_deg, one.dec_obs_deg, one.moved) == (r.ra_obs_deg, r.dec_obs_deg, r.moved)


def test_cells_cover_their_boxes(spark):
    rng = np.random.default_rng(2)
    boxes = [(f"b{k}", float(a), float(a + w), float(d), float(min(90.0, d + h))) for k, (a, w, d, h) in enumerate(zip(rng.uniform(-20, 380, 25), rng.uniform(0, 50, 25), rng.uniform(-90, 80, 25), rng.uniform(0, 30, 25), strict=True))]
    boxes += [("all", 0.0, 360.0, -90.0, 90.0), ("point", 5.0, 5.0, 7.0, 7.0), ("pole", 0.0, 400.0, 88.0, 90.0)]
    found = {}
    for r in sky.cells_of_boxes(spark.createDataFrame(boxes, "frame_id string, ra_low double, ra_high double, dec_low double, dec_high double"), 3, "frame_id").collect():
        found.setdefault(r.frame_id, set()).add(r.hpx)
    for name, a, b, d, e in boxes:
        inside = sky.pixels_of(rng.uniform(a, b, 400), rng.uniform(d, e, 400), 3)
        assert set(inside.tolist()) <= found[name]
    assert len(found["all"]) == 768 and len(found["point"]) < 20


def executed(df):
    """The executed plan's text, and how many files its scans of a written catalog have read."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = df._jdf.queryExecution()
        run.executedPlan().executeCollect()
        leaves = run.executedPlan().collectLeaves()
        scans = [leaves.apply(k) for k in range(leaves.size())]
        files = [s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles")]
        return run.executedPlan().toString(), sum(files)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_footprints_read_only_their_cells(t):
    catalog = frame_queries.write_sky_catalog(t)
    few = frame_queries._northern(t).orderBy("frame_id").limit(1)
    few = t.spark.createDataFrame(few.collect(), few.schema).where("dec_low > 10e0")
    pruned = frame_queries.footprints(catalog, few)
    plan, files = executed(pruned)
    assert "dynamicpruning" in plan and re.search(r"PartitionFilters: \[[^\]]*hpx", plan)
    assert 0 < files < 0.4 * len(catalog.inputFiles())
    placed = catalog.drop("hpx", "hpx_level").withColumn("hpx", sky.nested_pixel(F.col("ra"), F.col("dec"), frame_queries.LEVEL).cast("int"))
    assert sorted(pruned.collect()) == sorted(frame_queries.footprints(placed, few).collect())


def test_shard_prefixes_become_partition_filters(t):
    plan, files = executed(frame_queries.pruned_shards(t))
    assert files
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "StartsWith(campaign" in filters and "source" in filters


def test_great_circle_of_written_catalog(t):
    """Rows and partitions of the written catalog are those of the catalog."""
    catalog = frame_queries.write_sky_catalog(t)
    assert catalog.count() == t.catalog.count() and set(catalog.columns) == {*t.catalog.columns, "hpx", "hpx_level"}
    cells = {r.hpx for r in catalog.select("hpx").distinct().collect()}
    assert len(cells) > 50 and max(cells) < 12 * 4**frame_queries.LEVEL and math.isclose(catalog.agg(F.sum("ra")).first()[0], t.catalog.agg(F.sum("ra")).first()[0])


def test_full_frames_meet_the_brightest_alone(spark, monkeypatch):
    """Frames of a crowded sky are done with its brightest sources, a sparse one goes on to the whole catalog;
    the rows are those of all pairs."""
    stars = [(k, 100.0 + (k * 7919 % 1000) / 50, 20.0 + (k * 104729 % 997) / 50, 8.0 + (k * 31 % 1009) / 100) for k in range(4000)] + [(9000 + k, 201.0 + k / 10, 31.0, 15.0) for k in range(5)]
    catalog = spark.createDataFrame(stars, "source_id long, ra double, dec double, phot_g_mean_mag double").withColumn("hpx", sky.nested_pixel(F.col("ra"), F.col("dec"), frame_queries.LEVEL).cast("int"))
    frames = spark.createDataFrame([(f"f{k}", 100.0 + k, 109.0 + k, 21.0 + k, 30.0 + k) for k in range(8)] + [("sparse", 200.0, 203.0, 30.0, 32.0)], "frame_id string, ra_low double, ra_high double, dec_low double, dec_high double")
    want = frame_queries.footprints(catalog, frames, 10_000).where("place <= 4").collect()
    offered, inner = [], frame_queries.tables.sources_of_footprints
    monkeypatch.setattr(frame_queries.tables, "sources_of_footprints", lambda c, f, *a: offered.append(c.count() * f.count()) or inner(c, f, *a))
    got = frame_queries.footprints(catalog, frames, 1).collect()
    assert sorted(got) == sorted(r for r in want if r.place == 1) and len(got) == 9
    assert len(offered) > 1 and sum(offered) < 0.6 * 4005 * 9
    assert sorted(frame_queries.footprints(catalog, frames, 4).collect()) == sorted(want)


def test_distortion_is_solved_in_batches(spark):
    """The inverse is one step of the plan, not a dozen columns; a missing coefficient counts as 0, a null place stays null."""
    df = spark.createDataFrame([(10.0, 20.0, 1e-4, None), (None, 1.0, 1e-4, 0.0)], "u double, v double, a_20 double, b_02 double")
    out = sky.undistorted(df, "u", "v", {(2, 0): F.col("a_20")}, {(0, 2): F.col("b_02")})
    got = out.collect()
    assert math.isclose(got[0].u + 1e-4 * got[0].u ** 2, 10.0, abs_tol=1e-9) and got[0].v == 20.0 and got[0].sip_residual < 1e-9
    assert got[1].u is None and got[1].sip_residual is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Project") <= 3
