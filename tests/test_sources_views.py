"""Readers on odd files, and the views on nulls, ties and empty tables."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import numeric, sky, strings
from skyweave.operators import ml, pixels, review, runs, spectra
from skyweave.sources import fits, tables


def test_star_csv_with_preamble(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("# %ECSV 1.0\n# ---\n# - {name: ra}\nra,source_id,extra,dec\n1.5,7,x,2\nbad,8,,\n")
    got = tables.read_star_csv(spark, str(tmp_path / "a.csv.gz"), ["source_id", "ra", "dec"]).collect()
    assert [tuple(r) for r in got] == [(7, 1.5, 2.0), (8, None, None)]
    with pytest.raises(ValueError, match="parallax"):
        tables.read_star_csv(spark, str(tmp_path / "a.csv.gz"), ["source_id", "parallax"])


def test_targets_from_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("target_id,ra_deg\na,1.5\nb,\n")
    assert [tuple(r) for r in tables.read_targets(spark, str(tmp_path / "t.csv"), "target_id").collect()] == [("a", 1.5), ("b", None)]
    with pytest.raises(ValueError, match="dec_deg"):
        tables.read_targets(spark, str(tmp_path / "t.csv"), "dec_deg")
    (tmp_path / "none.csv").write_text("target_id,ra_deg\n")
    with pytest.raises(ValueError, match="no targets"):
        tables.read_targets(spark, str(tmp_path / "none.csv"), "target_id")
    (tmp_path / "m.yaml").write_text("targets:\n- {target_id: 7, ra_deg: '1.5', dec_deg: -2, pmra_masyr: '', parallax_mas: 3}\n- {target_id: b, ra_deg: 0, dec_deg: 0, notes: x}\n")
    rows = tables.read_manual_targets(spark, str(tmp_path / "m.yaml")).collect()
    assert [(r.target_id, r.ra_deg, r.pmra_masyr, r.parallax_mas, r.priority_score, r.notes) for r in rows] == [("7", 1.5, None, 3.0, 0.0, ""), ("b", 0.0, None, None, 0.0, "x")]
    (tmp_path / "bad.yaml").write_text("targets:\n- {target_id: 7, dec_deg: -2}\n")
    with pytest.raises(KeyError):
        tables.read_manual_targets(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "empty.yaml").write_text("")
    assert tables.read_manual_targets(spark, str(tmp_path / "empty.yaml")).count() == 0


def test_manifests_of_all_kinds(spark, tmp_path):
    doc = {"injections": [
        {"injection_id": "i1", "target_id": 17, "line_family": "er", "nominal_line_nm": 1550, "injected_line_nm": "1551.5", "find_me_snr": "many", "line_flux_uJy": 9, "frames_written": "2", "frames": [{"injected_flux_uJy": None}, {"injected_flux_uJy": "4.5"}, {}]},
        {"injection_id": "i2", "frames": []}, {"injection_id": "i3"},
    ]}
    (tmp_path / "injection_manifest.json").write_text(json.dumps(doc, indent=1))
    for reader, (texts, numbers, counts) in tables.MANIFEST_READERS.items():
        rows = tables.read_manifest(spark, str(tmp_path / "injection_manifest.json"), reader).orderBy("injection_id").collect()
        assert len(rows) == 3 and rows[0].asDict().keys() == {*texts, *numbers, *counts}
        assert (rows[0].target_id, rows[0].injected_line_nm, rows[0].find_me_snr, rows[0].frames_written, rows[1].frames_written) == ("17", 1551.5, None, 2, 0)
        if "max_frame_flux_uJy" in numbers:
            assert [r.max_frame_flux_uJy for r in rows] == [4.5, 0.0, 0.0]
    assert rows[0].manifest_path.endswith("injection_manifest.json")


def test_event_log_is_reset(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "k int, event string")
    path = str(tmp_path / "log")
    tables.append_events(events, path)
    tables.append_events(events, path)
    read = lambda: spark.read.schema("k int, event string").json(path)
    assert read().count() == 4 and [r.k for r in tables.read_jsonl_tail(spark, path, 2, "k").collect()] == [2, 2]
    tables.reset_events(spark, path)
    assert read().count() == 0
    tables.append_events(events, path)
    assert read().count() == 2


def test_nested_rows_become_flat(spark):
    df = spark.createDataFrame([((1, (2.5, "x")), [1, 2]), (None, None)], "a struct<n:int, b: struct<v:double, w:string>>, c array<int>")
    got = tables.flattened(df)
    assert got.columns == ["a_n", "a_b_v", "a_b_w", "c"] and [tuple(r) for r in got.collect()] == [(1, 2.5, "x", [1, 2]), (None, None, None, None)]
    assert tables.prefixed(got, "gpu", ["c"]).columns == ["c", "gpu_a_n", "gpu_a_b_v", "gpu_a_b_w"]


def test_score_tables(spark):
    rows = [("t", "i", 1.0, 0.1, "5.5", 1.0, True), ("t", "j", 1.0, 0.1, "none", None, None)]
    p = spark.createDataFrame(rows, "target_id string, image_id string, cwave_um double, cband_um double, psf_flux_uJy string, psf_flux_unc_uJy double, path_override_applied boolean")
    got = spectra.score_table(p, "psf").collect()
    assert [(r.score_flux_uJy, r.score_mode, r.path_override_applied) for r in got] == [(5.5, "raw_spectrum", True), (None, "raw_spectrum", None)]
    with pytest.raises(ValueError, match="aperture_flux_uJy"):
        spectra.score_table(p)


def test_quality_gate_skips_missing_columns(spark):
    p = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "target_id string")
    q = spark.createDataFrame([("a", "good", 60), ("b", "review", 90), ("c", "good", 10)], "target_id string, category string, n_usable int")
    assert spectra.quality_gate(p, q).count() == 2 and spectra.quality_gate(p, q.select("target_id")).count() == 4
    wide = q.withColumns({"span_nm": F.lit(5000.0), "corr": F.lit(None).cast("double"), "frac_delta": F.lit(2.0)})
    assert spectra.quality_gate(p, wide).count() == 0 and spectra.quality_gate(p, wide.drop("frac_delta")).count() == 2


PIX = "frame_id string, y int, x int, value double, variance double, flags long"
TARGETS = "frame_id string, target_id string, x double, y double"


def test_raw_apertures_and_cutouts(spark):
    pix = spark.createDataFrame([("f", i, j, 3.0 + (10.0 if (i, j) == (10, 10) else 0.0), 4.0, 8 if (i, j) == (10, 11) else 0) for i in range(24) for j in range(24) if (i, j) != (0, 0)], PIX)
    frames = pixels.pack_frames(pix)
    targets = spark.createDataFrame([("f", "a", 10.0, 10.0), ("f", "corner", 0.4, 0.4), ("f", "out", 24.0, 3.0), ("f", "none", None, 1.0)], TARGETS)
    got = {r.target_id: r for r in pixels.centre_aperture(frames, targets, (24, 24), 2.5, 4.0, 7.0, 8).collect()}
    a = got["a"]
    assert (a.n_pixels, a.n_good, a.flags, a.fatal_flag_present, a.background) == (21, 20, 8, True, 3.0) and a.flux == pytest.approx(10.0) and a.flux_unc == pytest.approx(math.sqrt(80.0))
    assert (got["out"].status, got["none"].status) == ("outside_image", "bad_position") and got["corner"].n_pixels - got["corner"].n_good == 1
    bad = pixels.centre_aperture(pixels.pack_frames(pix.withColumn("flags", F.lit(8).cast("long"))), targets.limit(1), (24, 24), 2.5, 4.0, 7.0, 8).first()
    assert (bad.status, bad.n_good, bad.flux) == ("insufficient_good_pixels", 0, None)
    cuts = {r.target_id: r for r in pixels.cutouts(frames, targets, (24, 24), 5).collect()}
    assert set(cuts) == {"a", "corner"} and cuts["a"].cutout[12] == 13.0 and len(cuts["a"].cutout) == 25
    assert [v is None for v in cuts["corner"].cutout].count(True) == 17 and cuts["corner"].cutout[12] is None
    stats = {r.target_id: r for r in pixels.cutout_statistics(pixels.cutouts(frames, targets, (24, 24), 5), 8).collect()}
    assert (stats["a"].median, stats["a"].mad, stats["a"].central, stats["a"].n_fatal, stats["corner"].central) == (3.0, 0.0, 13.0, 1, None)
    s = pixels.stretch(pixels.cutouts(frames, targets, (24, 24), 5)).first()
    sd = np.std([v for c in cuts.values() for v in c.cutout if v is not None])
    assert (s.vmin, s.vmax) == (pytest.approx(3.0 - 3 * sd), pytest.approx(3.0 + 12 * sd))  # no MAD: the deviation
    flat = pixels.stretch(pixels.cutouts(pixels.pack_frames(pix.withColumn("value", F.lit(2.0))), targets, (24, 24), 5)).first()
    assert (flat.vmin, flat.vmax) == (-1.0, 14.0)
    assert pixels.cutouts(frames, targets.limit(0), (24, 24)).count() == 0


def test_model_runs_and_catalog(spark):
    status = spark.createDataFrame([("a", 5, "", "", None, "", 0), ("b", 9, "done", "t", "d", "v1", 3), ("x", None, None, None, None, None, None)], "run_name string, mtime int, status string, model_type string, dataset_name string, model_version string, examples int")
    cards = spark.createDataFrame([("a", 1, "card", "/x/ds/", "v0", 7), ("c", 2, "only", None, None, 0)], "run_name string, mtime int, model_type string, dataset_dir string, model_version string, example_count int")
    got = [(r.run_name, r.status, r.model_type, r.dataset_name, r.model_version, r.examples) for r in runs.model_runs(status, cards).collect()]
    assert got == [("b", "done", "t", "d", "v1", 3), ("a", "unknown", "card", "ds", "v0", 7), ("c", "unknown", "only", None, None, None), ("x", "unknown", None, None, None, None)]
    assert [r.run_name for r in runs.model_runs(status, cards, "V0").collect()] == ["a"]
    listing = spark.createDataFrame([("r1", 100.0), ("../r", 500.0), ("..", 5.0), ("r 2", 1.0), ("r3", None)], "run_name string, mtime double")
    rows = runs.run_catalog(listing, {"s": spark.createDataFrame([("r1", 3)], "run_name string, n int")}, F.lit(999.0)).collect()
    assert [(r.run_name, r.s_n, r.is_active) for r in rows] == [("r1", 3, True), ("r3", None, False)]


def test_tiles(spark):
    stars = spark.createDataFrame([(k, k % 3, 10.0 + (k * 7) % 50 / 10) for k in range(100)] + [(500, 0, None)], "source_id long, cell int, phot_g_mean_mag double").withColumns({"ra": F.lit(0.0), "dec": F.lit(0.0)})
    got = runs.tile_targets(stars, F.col("cell"), 8, 20, 6).collect()
    by = {}
    for r in got:
        by.setdefault(r.hpx, []).append(r)
    for cell, rows in by.items():
        want = sorted((10.0 + (k * 7) % 50 / 10, k) for k in range(100) if k % 3 == cell)[:20]
        assert [(r.phot_g_mean_mag, r.source_id) for r in sorted(rows, key=lambda r: r.place)] == want and [r.batch_index for r in sorted(rows, key=lambda r: r.place)] == [p // 6 for p in range(20)]
    s = {r.tile_id: (r.target_count, r.batch_count) for r in runs.tile_summaries(runs.tile_targets(stars, F.col("cell"), 8, 20, 6)).collect()}
    assert s == {f"hpx_nside0008_nested_{k:08d}": (20, 4) for k in range(3)}


def test_projection_and_export(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [None, 2.0])], "vec_id int, e array<double>")
    got = {r.vec_id: r for r in ml.export_embeddings(v, "vec_id", "e", spark.createDataFrame([(1, "n")], "vec_id int, object_name string"), 3).collect()}
    assert (got[1].shape_embedding_000, got[1].shape_embedding_001, got[1].shape_embedding_002, got[1].object_name) == (0.6, 0.8, None, "n")
    assert (got[2].shape_embedding_000, got[3].shape_embedding_000, got[3].shape_embedding_001, got[3].object_name) == (0.0, None, 1.0, None)
    p = spark.range(3000).selectExpr("concat('t', id) as target_id", "cast(id % 3 as int) as cluster_id", "concat('Run', id % 7) as run_name")
    assert ml.projection_points(p, limit=5).count() == 1000 and ml.projection_points(p, cluster=1).count() == 1000
    one, two = (sorted(r.target_id for r in ml.projection_points(q, limit=1000).collect()) for q in (p, p.repartition(5)))
    assert one == two and ml.projection_points(p, "run3", ("run_name",)).where("run_name != 'Run3'").count() == 0
    assert ml.projection_clusters(p, {"m": "nothing"}).columns == ["cluster_id", "n"]


def test_frames_as_files_and_back(spark):
    pix = spark.createDataFrame([("f", i, j, math.sin(i * 7 + j), 1.0, (i * j) % 3) for i in range(5) for j in range(4) if (i + j) % 6] + [("g", 2, 3, 1.5, 1.0, 1)], PIX)
    files = fits.frame_bytes(pixels.pack_frames(pix), (5, 4))
    back = fits.frame_pixels(files.union(spark.createDataFrame([("bad", b"junk"), ("none", None)], "frame_id string, content binary")))
    assert sorted(map(tuple, back.collect())) == sorted((r.frame_id, r.y, r.x, r.value, r.flags) for r in pix.collect())


def test_inspection_of_the_best_candidate(spark):
    c = spark.createDataFrame([("t", 1500.0, 9.0, "c1"), ("t", 1003.0, 2.0, "c2"), ("t", 996.0, 2.0, "c0"), ("u", 1500.0, None, "c4"), ("u", 2000.0, 1.0, "c5"), ("v", None, 1.0, "c6")], "target_id string, peak_nm double, score double, candidate_id string")
    best = review.best_near(c, 1000.0)
    assert {r.target_id: r.candidate_id for r in best.collect()} == {"t": "c0", "u": "c5", "v": "c6"}
    points = spark.createDataFrame([("t", f"i{k}", 0.98 + 0.004 * k, 0.02, 1, 5.0) for k in range(12)] + [("t", "far", 3.0, 0.02, 1, 5.0), ("u", "x", 2.0, 0.02, 1, 5.0)], "target_id string, image_id string, cwave_um double, cband_um double, detector int, aperture_flux_uJy double")
    rows = review.inspection(points, best.select("target_id", "peak_nm"), most=3).collect()
    assert {r.image_id for r in rows if r.target_id == "t" and r.is_support} == {"i3", "i4", "i5"} and len(rows) == 13


def test_scalars(spark):
    one = spark.range(1)
    assert sky.ra_clause("ra", 350.0, 375.0) == "(ra >= 350.0D or ra <= 15.0D)" and sky.ra_clause("ra", 10.0, 20.0) == "(ra >= 10.0D and ra <= 20.0D)" and sky.ra_clause("ra", 0.0, 360.0) == "true"
    weight = one.select(*(c.alias(n) for n, c in strings.payload_weight(F.lit("é" * 10)).items())).first()
    assert (weight.n_bytes, weight.tokens_4, weight.tokens_3, weight.tokens_2p5) == (20, 2, 3, 4)
    flux = one.select(numeric.to_micro_jansky(F.lit(2.0), F.lit(3.0)).alias("f"), numeric.variance_to_micro_jansky(F.lit(2.0), F.lit(3.0)).alias("v")).first()
    assert flux.f == pytest.approx(6 * 23.50443053909789) and flux.v == pytest.approx(2.0 * (3 * 23.50443053909789) ** 2)
    assert one.select(strings.first_known(F.lit(None).cast("string"), F.lit("b"), default="c").alias("x")).first().x == "b"
    assert one.select(sky.flat_distance(F.lit(11.0), F.lit(60.0), 10.0, 60.0).alias("d")).first().d == pytest.approx(0.5)


def test_a_detectors_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task holds all rows of a detector: a folder has a file from each split of the table."""
    from skyweave.plans import registry, view_queries

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    listed, inner = [], view_queries.tables.list_files
    monkeypatch.setattr(view_queries.tables, "list_files", lambda *a: listed.append(inner(*a)) or listed[0])
    assert sorted(registry.queries()["s11_file_listing"](spark, str(tmp_path)).collect()) == [(f"detector={k}", True) for k in sorted({1 + r.l_linenumber % 6 for r in spark.read.parquet(str(tmp_path / "lineitem.parquet")).select("l_linenumber").distinct().collect()})]
    assert listed[0].count() > 6
