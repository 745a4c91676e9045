"""Properties and brute-force versions of operators that SQL doesn't express."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyweave.functions import numeric, sky, strings
from skyweave.operators import bands, candidates, photometry, spectra, windows
from skyweave.schemas import nan_to_null, provenance_guard, require_columns
from skyweave.sources import fits, tables
from skyweave.streaming import status


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_nms_matches_literal_replay(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for s in range(20):
        q = rng.integers(0, 8, 60).astype(float)
        rows += [(s, k, float(v)) for k, v in enumerate(q)]
        peaks = [k for k in range(60) if q[k] >= (q[k - 1] if k else -1) and q[k] >= (q[k + 1] if k < 59 else -1)]
        chosen = []
        while len(chosen) < 5:
            left = [k for k in peaks if all(abs(k - c) > 4 for c in chosen)]
            if not left:
                break
            chosen.append(max(left, key=lambda k: (q[k], k)))
        want[s] = chosen
    got = windows.nms_topk(spark.createDataFrame(rows, "s int, i long, q double"), ["s"], "i", "q", 5, 4).toPandas()
    assert {s: g.sort_values("pick")["i"].tolist() for s, g in got.groupby("s")} == want


def test_greedy_match_is_one_to_one(spark):
    rng = np.random.default_rng(1)
    make = lambda p, n: [(f"t{k % 3}", f"{p}{k}", float(rng.integers(0, 100)), float(rng.random())) for k in range(n)]
    a, b = make("a", 40), make("b", 40)
    schema = "target_id string, id string, x double, score double"
    got = candidates.greedy_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 5.0).collect()
    pairs = [(r.left_id, r.right_id) for r in got if r.left_id and r.right_id]
    assert len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs})
    assert sorted(r.left_id for r in got if r.left_id) == sorted(x[1] for x in a)
    assert sorted(r.right_id for r in got if r.right_id) == sorted(x[1] for x in b)
    used, want = set(), set()
    for r in sorted(a, key=lambda r: (-r[3], r[1])):
        near = [c for c in sorted(b, key=lambda c: (-c[3], c[1])) if c[0] == r[0] and c[1] not in used and abs(c[2] - r[2]) <= 5]
        if near:
            used.add(near[0][1])
            want.add((r[1], near[0][1]))
    assert set(pairs) == want


def test_band_join_is_an_equi_join(spark):
    rng = np.random.default_rng(2)
    a = spark.createDataFrame([(int(k % 4), float(v)) for k, v in enumerate(rng.random(200) * 100)], "k int, x double")
    b = spark.createDataFrame([(int(k % 4), float(v)) for k, v in enumerate(rng.random(200) * 100)], "k int, y double")
    joined = bands.band_join(a, b, ["k"], "x", "y", 2.0)
    want = a.alias("a").join(b.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.abs(F.col("x") - F.col("y")) <= 2.0)).count()
    assert joined.count() == want > 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        bands.band_join(a, b, ["k"], "x", "y", 0.0)


def test_noise_free_line_has_its_closed_form_score(spark):
    wave = np.linspace(1.0, 2.0, 400)
    sigma = math.sqrt(0.02**2 + 1e-6) / 2.354820045
    t = np.exp(-0.5 * ((wave - 1.5) / sigma) ** 2)
    rows = [("t", float(w), 0.02, float(100 + 50 * r), 2.0) for w, r in zip(wave, t)]
    points = spark.createDataFrame(rows, "target_id string, cwave_um double, cband_um double, flux double, unc double")
    got = bands.scan(points, bands.line_grid(spark, 1500.0, 1500.0, 1.0)).first()
    used = t >= 1e-3
    assert abs(got["amp"] - 50) < 0.2 and abs(got["snr"] - got["amp"] * math.sqrt((t[used] ** 2).sum()) / 2.0) < 1e-6


def test_clusters_split_at_gaps(spark):
    rows = [("a", x, s) for x, s in ((0.0, 1.0), (10.0, 5.0), (20.0, 5.0), (50.1, 2.0), (80.1, 9.0))]
    got = windows.gap_clusters(spark.createDataFrame(rows, "t string, x double, s double"), ["t"], "x", 30.0, "s").orderBy("min_x").collect()
    assert [(r.min_x, r.max_x, r.peak_x) for r in got] == [(0.0, 20.0, 10.0), (50.1, 80.1, 80.1)]


def test_nested_pixels_agree_and_round_trip(spark):
    rng = np.random.default_rng(3)
    ra, dec = rng.random(3000) * 360, np.degrees(np.arcsin(rng.random(3000) * 2 - 1))
    df = spark.createDataFrame(pd.DataFrame({"ra": ra, "dec": dec}))
    for level in (0, 3, 7):
        p = np.array([r[0] for r in df.select(sky.nested_pixel(F.col("ra"), F.col("dec"), level)).collect()])
        assert (p == sky.pixels_of(ra, dec, level)).all() and p.min() >= 0 and p.max() < 12 * 4**level
        if level:
            assert (p >> 2 == sky.pixels_of(ra, dec, level - 1)).all()
        n = min(12 * 4**level, 3000)
        c = sky.pixel_center(F.col("id"), level)
        centers = spark.range(n).select("id", c[0].alias("ra"), c[1].alias("dec")).toPandas()
        assert (sky.pixels_of(centers["ra"].to_numpy(), centers["dec"].to_numpy(), level) == centers["id"]).all()
    corners = spark.range(768).select(sky.pixel_corners(F.col("id"), 3).alias("c")).select(F.size("c").alias("n")).distinct().collect()
    assert [r.n for r in corners] == [4]


def test_polygon_over_360_and_motion(spark):
    pts = spark.createDataFrame([(359.5, 0.0), (0.5, 0.0), (1.5, 0.0), (180.0, 0.0)], "ra double, dec double")
    inside = sky.sky_prefilter(pts, "ra", "dec", [(359.0, -1.0), (1.0, -1.0), (1.0, 1.0), (359.0, 1.0)]).collect()
    assert sorted(r.ra for r in inside) == [0.5, 359.5]
    m = sky.propagate(F.lit(10.0), F.lit(20.0), F.lit(2016.0), F.lit(None).cast("double"), F.lit(5.0), F.lit(61000.0))
    assert one(spark, m["ra_obs_deg"], m["moved"])[:] == (10.0, False)
    m = sky.propagate(F.lit(10.0), F.lit(60.0), F.lit(2000.0), F.lit(3600.0), F.lit(-1800.0), F.lit(51544.5 + 365.25))
    got = one(spark, m["ra_obs_deg"].alias("r"), m["dec_obs_deg"].alias("d"))
    assert abs(got.r - (10.0 + 0.001 / 0.5)) < 1e-6 and abs(got.d - (60 - 0.0005)) < 1e-6


def test_special_functions(spark):
    for q in (0.0, 0.5, 4.0, 30.0):
        want = 0.5 if q <= 0 else 0.5 * math.erfc(math.sqrt(q / 2))
        assert abs(one(spark, numeric.p_local(F.lit(q)))[0] - want) <= 2e-7 * max(want, 1e-300) + 1e-12
    for v in (1550.0, 0.1, 123456.0, 1.25, -3.5, 100000.5, 0.00012345):
        assert one(spark, numeric.general_format(F.lit(v)))[0] == f"{v:g}"
    assert one(spark, strings.integer_ranges(F.lit("3-5,9,4,x,7-6")))[0] == [3, 4, 5, 9]
    assert one(spark, numeric.ratio(F.lit(1.0), F.lit(0.0)))[0] is None
    assert one(spark, numeric.clip01(F.lit(float("nan"))))[0] == 0.0


def test_samples_are_whole_and_spread(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(rng.random((500, 3)) * 10)]
    df = spark.createDataFrame(rows, "id long, x double, y double, m double")
    got = windows.tiled_sample(df, F.col("x"), F.col("y"), ["m", "id"], 64).collect()
    assert len(got) == 64 and len({r.tile for r in got}) == 16 and len({r.id for r in got}) == 64
    assert windows.tiled_sample(df, F.col("x"), F.col("y"), ["m", "id"], 5).count() == 5
    strata = windows.stratified_sample(df, "m", ["m", "id"], 60).groupBy("stratum").count().collect()
    assert sum(r["count"] for r in strata) == 60 and {r["count"] for r in strata} == {6}
    assert windows.evenly_spaced(df.withColumn("g", F.lit(1)), ["g"], [F.col("x"), F.col("id")], 24).count() == 24


def test_photometry_recovers_flux(spark):
    image = photometry.gaussian_psf(48, 22.3, 23.1, 1.2) * 500 + 7
    frame = spark.createDataFrame([("f", image.tolist(), np.ones((48, 48)).tolist(), np.zeros((48, 48), int).tolist())], "frame_id string, image array<array<double>>, variance array<array<double>>, flags array<array<int>>")
    targets = spark.createDataFrame([("f", "a", 22.3, 23.1), ("f", "edge", 1.0, 1.0)], "frame_id string, target_id string, x double, y double")
    got = {r.target_id: r for r in photometry.aperture_photometry(frame, targets, 6.0, 8.0, 12.0).collect()}
    assert abs(got["a"].flux - 500) < 1 and abs(got["a"].background - 7) < 1e-6 and got["edge"].status == "outside_or_edge"
    fit = photometry.psf_photometry(frame.crossJoin(targets.where("target_id = 'a'").select("target_id", (F.col("x") - 0.5).alias("x"), "y"))).first()
    assert abs(fit.psf_flux - 500) < 1e-6 and fit.dx == 0.5 and abs(fit.psf_background - 7) < 1e-9
    assert math.isnan(photometry.bilinear(np.ones((3, 3)), np.array([5.0]), np.array([0.0]))[0])


def test_fits_and_catalog_sources(spark, tmp_path):
    array = np.arange(12, dtype="f4").reshape(3, 4)
    (tmp_path / "a.fits").write_bytes(fits.write_image(array, {"DETECTOR": 3, "CRVAL1": 10.5, "MJD-OBS": 60000.25, "OBJECT": "it's"}))
    (tmp_path / "b.fits").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[1]: r for r in fits.frame_manifest(spark, str(tmp_path)).collect()}
    assert (got["a.fits"].naxis1, got["a.fits"].naxis2, got["a.fits"].detector, got["a.fits"].ra_center_deg) == (4, 3, 3, 10.5)
    assert got["b.fits"].header_error
    header, back = next(fits.read_units((tmp_path / "a.fits").read_bytes()))
    assert (back == array).all()
    (tmp_path / "ids.txt").write_text("# c\n a \n\nb\na\n")
    assert sorted(r[0] for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "p.csv").write_text("1|10.0|-5.0|\\N\n2|400.0|0.0|3\n")
    assert [tuple(r) for r in tables.read_point_source_text(spark, str(tmp_path / "p.csv"), "id long, ra double, dec double, m int").collect()] == [(1, 10.0, -5.0, None)]
    cat = spark.createDataFrame([(k, k % 5) for k in range(50)], "source_id long, hpx long")
    tables.write_catalog(cat, str(tmp_path / "cat"), 3, 4)
    assert spark.read.parquet(str(tmp_path / "cat")).where("hpx = 2 and hpx_level = 3").count() == 10
    assert tables.cached_query(cat, str(tmp_path / "cache"), "q", 1).count() == 50 == tables.cached_query(cat.limit(1), str(tmp_path / "cache"), "q", 1).count()
    (tmp_path / "plan.json").write_text('{"plan_id": "p", "injections": [{"injection_id": "i", "target_id": "t", "frames": [{"image_id": "a", "line_response": 0.5, "status": "written"}, {"image_id": "b", "line_response": 0.7, "status": "skipped"}]}]}')
    r = tables.read_injections(spark, str(tmp_path / "plan.json")).first()
    assert (r.injection_id, r.max_response, r.frames_written) == ("i", 0.7, 1)


def test_schema_guards(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double").withColumn("wavelength_source", F.lit("other"))
    assert nan_to_null(df).first()["a"] is None
    with pytest.raises(ValueError):
        require_columns(df, "zz")
    with pytest.raises(ValueError):
        provenance_guard(df)


def test_pairs_keep_first_and_quadrature(spark):
    cols = "target_id string, image_id string, cwave_um double, cband_um double, detector int, aperture_flux_uJy double, psf_flux_uJy double, aperture_flux_unc_uJy double, fatal_flag_present boolean"
    a = spark.createDataFrame([("t", "i", 1.0, 0.1, 1, 5.0, 5.0, 3.0, None), ("t", "i", 2.0, 0.1, 1, 9.0, 9.0, 3.0, True)], cols)
    b = spark.createDataFrame([("t", "i", 1.0, 0.1, 1, 2.0, 2.0, 4.0, False)], cols)
    r = spectra.paired_delta(a, b).collect()
    assert len(r) == 1 and (r[0].delta_flux, r[0].delta_unc, r[0].fatal_flag_present) == (3.0, 5.0, False)


def test_status_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    lines = [(1.0, "field_start", "a"), (2.0, "field_start", "b"), (3.0, "field_done", "a"), (4.0, "field_retry", "b"), (5.0, "field_error", "b"), (6.0, "note", "a")]
    for k, (t, e, i) in enumerate(lines):
        (source / f"{k}.json").write_text(f'{{"time": {t}, "event": "{e}", "image_id": "{i}", "attempt": 1}}\n')
    q = status.start_fold(status.read_events(spark, str(source)), str(tmp_path / "cp"), "folded")
    q.processAllAvailable()
    q.stop()
    got = {r.image_id: (r.status, r.retries, r.events) for r in spark.table("folded").collect()}
    assert got == {"a": ("done", 0, 2), "b": ("error", 1, 3)}
    c = status.counters(spark.table("folded"), 5).first()
    assert (c.done, c.error, c.queued) == (1, 1, 3)
    assert [r.image_id for r in status.snapshot(spark.table("folded")).collect()] == ["b", "a"]
