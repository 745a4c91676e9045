"""Registered queries without SQL, each against its definition on the whole of a small table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import candidates
from skyweave.plans import registry
from skyweave.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def rows(spark, name):
    return registry.queries()[name](spark, SF)


def test_nested_pixels_contain_their_sources(spark, t):
    got = rows(spark, "p7_nested_pixel").join(t.catalog.select("source_id", "ra", "dec"), "source_id").toPandas()
    assert len(got) == t.catalog.count()
    assert got.pixel.tolist() == sky.pixels_of(got.ra.to_numpy(), got.dec.to_numpy(), 5).tolist()
    assert got.from_center.max() < math.degrees(math.sqrt(math.pi / 3) / 32)


def test_pixel_corners_surround_their_centres(spark, t):
    got = rows(spark, "p8_pixel_corners").collect()
    assert {r.pixel for r in got} == set(sky.pixels_of(*(t.catalog.select("ra", "dec").toPandas().to_numpy().T), 3).tolist())
    for r in got:
        xyz = [np.array([math.cos(math.radians(c.dec)) * math.cos(math.radians(c.ra)), math.cos(math.radians(c.dec)) * math.sin(math.radians(c.ra)), math.sin(math.radians(c.dec))]) for c in r.corners]
        middle = sum(xyz) / np.linalg.norm(sum(xyz))
        ra, dec = math.degrees(math.atan2(middle[1], middle[0])) % 360, math.degrees(math.asin(middle[2]))
        assert sky.pixels_of(np.array([ra]), np.array([dec]), 3)[0] == r.pixel


def test_samples(spark, t):
    catalog = t.catalog.select("source_id", "ra", "dec", F.col("phot_g_mean_mag").alias("mag")).toPandas()
    tiled = rows(spark, "p24_tiled_sample").toPandas()
    lo, hi = catalog[["ra", "dec"]].min(), catalog[["ra", "dec"]].max()
    place = lambda c: np.minimum(3, np.floor((catalog[c] - lo[c]) / (hi[c] - lo[c]) * 4)).astype(int)
    catalog["tile"] = place("dec") * 4 + place("ra")
    catalog = catalog.sort_values(["mag", "source_id"])
    first = catalog.groupby("tile").head(4)
    rest = catalog[~catalog.source_id.isin(first.source_id)].head(64 - len(first))
    assert set(tiled.source_id) == set(first.source_id) | set(rest.source_id) and len(tiled) == 64
    assert dict(zip(tiled.source_id, tiled.tile, strict=True)) == {s: k for s, k in zip(catalog.source_id, catalog.tile, strict=True) if s in set(tiled.source_id)}
    strata = rows(spark, "p25_stratified_sample").toPandas()
    m0, m1 = catalog.mag.min(), catalog.mag.max()
    catalog["stratum"] = np.minimum(9, np.floor((catalog.mag - m0) / (m1 - m0) * 10)).astype(int)
    want = catalog.groupby("stratum").head(6)
    fill = catalog[~catalog.source_id.isin(want.source_id)].head(60 - len(want))
    assert set(strata.source_id) == set(want.source_id) | set(fill.source_id)
    seeded, again = (rows(spark, "p26_seeded_sample").toPandas().sort_values("source_id").reset_index(drop=True) for _ in range(2))
    sizes = catalog.groupby(np.floor(catalog.mag)).size().clip(upper=5)
    assert seeded.equals(again) and seeded.groupby("bin").size().to_dict() == {int(k): v for k, v in sizes.to_dict().items()}


def test_capped_pick_takes_three_a_target(spark, t):
    got = rows(spark, "o9_capped_pick").toPandas()
    order = t.points.select("target_id", "image_id", F.xxhash64(F.lit(7), "target_id", "image_id", "cwave_um").alias("h")).toPandas().sort_values(["h", "image_id"])
    want = order.groupby("target_id").head(3).head(50)
    assert list(zip(got.target_id, got.image_id, strict=True)) == list(zip(want.target_id, want.image_id, strict=True))


def test_augmented_views_are_a_seeded_subset_with_noise(spark, t):
    got = rows(spark, "m2_augmented_view").toPandas()
    points = t.points.select("target_id", "cwave_um", "aperture_flux_uJy", "aperture_flux_unc_uJy").toPandas()
    both = got.merge(points.drop_duplicates(["target_id", "cwave_um"], keep=False), on=["target_id", "cwave_um"])
    noise = (both.flux - both.aperture_flux_uJy) / (0.05 * both.aperture_flux_unc_uJy)
    assert 0.77 < len(got) / len(points) < 0.83 and abs(noise.mean()) < 0.06 and 0.95 < noise.std() < 1.05
    assert got.sort_values(["target_id", "cwave_um", "flux"]).reset_index(drop=True).equals(rows(spark, "m2_augmented_view").toPandas().sort_values(["target_id", "cwave_um", "flux"]).reset_index(drop=True))


@pytest.mark.parametrize("name", ["f6_p_values", "f6_p_values_1nm"])
def test_p_values_by_the_error_function(spark, name):
    for r in rows(spark, name).collect():
        local = 0.5 * math.erfc(math.sqrt(r.max_q / 2)) if r.max_q > 0 else 0.5
        assert r.p_local == pytest.approx(local, rel=1e-6, abs=1e-300)
        assert r.p_global == pytest.approx(min(1.0, local + r.crossings * math.exp(-0.5 * (r.max_q - 4))) if r.max_q > 0 else 1.0, rel=1e-6, abs=1e-300)


@pytest.mark.parametrize(("name", "scan", "step", "k", "apart", "least"), [("w7_nms_topk", "f5_dual_flux_scan", 25.0, 5, 4, 0.0), ("w7_nms_topk_1nm", "f5_dual_flux_scan_1nm", 1.0, 10, 10, 2.25)])
def test_picks_are_greedy(spark, name, scan, step, k, apart, least):
    cells = rows(spark, scan).toPandas()
    cells["i"] = ((cells.line_nm - 750) / step).round().astype(int)
    got = rows(spark, name).toPandas()
    for target, own in cells.sort_values("i").groupby("target_id"):
        q, i = own.q.to_numpy(), own.i.to_numpy()
        picks = got[got.target_id == target].sort_values("pick")
        assert len(picks) <= k and (np.diff(np.sort(picks.line_index)) > apart).all() and (picks.q >= round(least, 2)).all()
        at = dict(zip(i.tolist(), q.tolist(), strict=True))
        assert all(abs(at[x] - y) < 0.02 for x, y in zip(picks.line_index, picks.q, strict=True)) and (np.diff(picks.q) <= 0).all()
        # what is left could not be picked: it is near a pick, no peak, too low, or below the last of k picks
        peak = (q >= np.append(-1, q[:-1]) - 0.01) & (q >= np.append(q[1:], -1) - 0.01)
        for x, y, p in zip(i, q, peak, strict=True):
            if p and y > max(least, picks.q.min() if len(picks) == k else least) + 0.02:
                assert (np.abs(picks.line_index - x) <= apart).any()


def test_local_maxima_of_the_fine_scan(spark):
    cells = rows(spark, "f5_dual_flux_scan_1nm").toPandas().sort_values(["target_id", "line_nm"])
    got = set(map(tuple, rows(spark, "w6_local_maxima_1nm").select("target_id", "line_nm").toPandas().to_numpy()))
    for target, own in cells.groupby("target_id"):
        q, line = own.q.to_numpy(), own.line_nm.to_numpy()
        left, right = np.append(-1, q[:-1]), np.append(q[1:], -1)
        sure, never = (q > left + 0.02) & (q > right + 0.02), (q < left - 0.02) | (q < right - 0.02)
        assert all((target, x) in got for x in line[sure]) and not any((target, x) in got for x in line[never])


def greedy_by_definition(left, right, tolerance):
    """Left rows (target, id, x, score) by score take the best free right row within reach."""
    order = lambda r: (r[3] is None, -(r[3] or 0), r[1])
    free, out = sorted(right, key=order), []
    for t, i, x, _ in sorted(left, key=order):
        hit = next((r for r in free if r[0] == t and x is not None and r[2] is not None and abs(r[2] - x) <= tolerance), None)
        out.append((t, i, hit[1] if hit else None))
        if hit:
            free.remove(hit)
    return sorted(out + [(r[0], None, r[1]) for r in free], key=str)


@pytest.mark.parametrize("batch", [10_000, 3])
def test_greedy_match_by_definition(spark, batch):
    random.seed(batch)
    make = lambda n, s: [(f"t{random.randrange(3)}", f"{s}{k}", None if k % 17 == 0 else round(random.uniform(0, 300), 1), None if k % 23 == 0 else float(random.randrange(9))) for k in range(n)]
    left, right = make(120, "a"), make(90, "b")
    schema = "target_id string, id string, x double, score double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for a, b in ((left, right), (left, right[:1]), (left[:5], []), ([], right[:5]), ([], [])):
            got = candidates.greedy_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 4.0).collect()
            assert sorted(map(tuple, got), key=str) == greedy_by_definition(a, b, 4.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("name", "scan", "gap"), [("j7_greedy_match", "v15_scan_driver", 30.0), ("j7_greedy_match_5nm", "v15_scan_driver_5nm", 30.0)])
def test_joint_candidates_of_all_targets(spark, name, scan, gap):
    clusters = rows(spark, scan).toPandas()
    side = lambda kind: [(r.target_id, f"{r.target_id}::{kind}::{r.cluster_index}", r.peak_x, r.peak_score) for r in clusters[clusters.flux_kind == kind].itertuples()]
    got = rows(spark, name).toPandas().astype(object)
    pairs = sorted(((r.target_id, r.aperture_cluster_id if r.has_aperture else None, r.psf_cluster_id if r.has_psf else None) for r in got.itertuples()), key=str)
    assert pairs == greedy_by_definition(side("aperture"), side("psf"), gap)
    assert got.joint_candidate_id.is_unique


@pytest.mark.parametrize(("name", "joint"), [("x28_configured_quality", "j7_greedy_match"), ("x28_configured_quality_5nm", "j7_greedy_match_5nm")])
def test_quality_rules_by_hand(spark, name, joint):
    """The published default rules, candidate by candidate."""
    limit, weight = candidates.DEFAULT_RULES["thresholds"], candidates.DEFAULT_RULES["weights"]
    given = {r.joint_candidate_id: r for r in rows(spark, joint).collect()}
    got = rows(spark, name).collect()
    assert len(got) == len(given)
    for r in got:
        c = given[r.joint_candidate_id]
        both, peak = c.has_aperture and c.has_psf, max(c.aperture_peak_snr or 0.0, c.psf_peak_snr or 0.0)
        support = (min if both else max)(c.aperture_support, c.psf_support)
        detectors, frames = len(c.detectors.split(",")), len(c.best_frame_ids.split(","))
        ratio = c.flux_ratio if c.flux_ratio and c.flux_ratio > 0 else None
        failed = [
            (not both, "missing_aperture_or_psf_match"), (c.flagged_points_sum > limit["max_flagged_points_sum"], "too_many_flagged_points"), (c.aperture_support < limit["min_aperture_support"], "aperture_support_too_low"),
            (c.psf_support < limit["min_psf_support"], "psf_support_too_low"), (detectors < 1, "detector_count_too_low"), (frames < 2, "frame_count_too_low"), (ratio is None, "flux_ratio_missing_or_invalid"),
            (ratio is not None and ratio < 0.3, "psf_aperture_flux_ratio_too_low"), (ratio is not None and ratio > 3.0, "psf_aperture_flux_ratio_too_high"), ((c.aperture_peak_snr or 0) > 1000, "aperture_snr_pathologically_high"),
            ((c.psf_peak_snr or 0) > 1000, "psf_snr_pathologically_high"), (c.cluster_width_nm > 120, "cluster_too_wide"),
        ]
        why = [n for f, n in failed if f]
        score = (weight["both_methods_bonus"] if both else -weight["missing_method_penalty"]) + support * weight["support_per_point"] + min(detectors, 4) * weight["detector_per_detector"] + min(frames, 8) * weight["frame_per_frame"]
        score += math.log10(max(peak, 1.0)) * weight["snr_log_bonus"] - c.flagged_points_sum * weight["flagged_point_penalty"] - (2.0 if ratio is None else abs(math.log10(ratio))) * weight["flux_ratio_penalty_per_log10"]
        score -= c.cluster_width_nm / 100 * weight["cluster_width_penalty_per_100nm"] + len(why) * weight["failed_threshold_penalty"]
        assert r.reject_reasons == ",".join(why) and r.quality_score == pytest.approx(score)
        assert r.quality_category == ("high_confidence" if score >= 70 and not why else "review" if score >= 35 else "reject")


@pytest.mark.parametrize("name", ["x25_review_grades", "x25_review_grades_1nm"])
def test_grades_follow_their_reasons(spark, name):
    got = rows(spark, name).toPandas()
    assert len(got) and set(got.review_grade) <= set("SABCD") and not got.duplicated(["target_id", "line_nm"]).any()
    science = ~got.reject_reasons.str.contains("p_global_above_alpha")
    assert ((got.reject_reasons == "") == got.review_grade.isin(list("SAB"))).all() and (got.review_grade.isin(["D"]) == ~science).all()
    crowded = got.groupby("target_id").line_nm.transform("size") > 3
    assert (got.reject_reasons.str.contains("too_many_competing_peaks") == crowded).all()


def test_diagnostic_windows_of_the_fine_scan(spark):
    cells = rows(spark, "f5_dual_flux_scan_1nm").select("target_id", "line_nm").toPandas()
    picks = rows(spark, "w7_nms_topk_1nm").toPandas()
    got = rows(spark, "f8_diagnostic_window_1nm").toPandas()
    lines = {k: v.to_numpy() for k, v in cells.groupby("target_id").line_nm}
    want = {(r.target_id, r.line_index + 750.0): int((np.abs(lines[r.target_id] - r.line_index - 750.0) <= 80).sum()) for r in picks.itertuples()}
    assert got.groupby(["target_id", "peak_nm"]).size().to_dict() == {k: min(v, 201) for k, v in want.items()}


def test_random_views(spark, t):
    whole = {(r.target_id, r.image_id, r.cwave_um, r.features[0], r.features[6]): r.features for r in rows(spark, "m1_point_features").collect()}
    sizes = t.points.groupBy("target_id").count().toPandas().set_index("target_id")["count"]
    got = rows(spark, "m2_random_view").collect()
    kept = {}
    noise = []
    for r in got:
        kept[r.target_id] = kept.get(r.target_id, 0) + 1
        before = whole.get((r.target_id, r.image_id, r.cwave_um, r.features[0], r.features[6]))
        assert before is not None and all(r.features[k] == before[k] for k in (0, 1, *range(6, 13)))
        noise += [r.features[k] - before[k] for k in range(2, 6)]
    assert kept == {k: min(384, max(2, round(n * 0.78))) for k, n in sizes.items()}
    assert abs(np.mean(noise)) < 0.001 and 0.009 < np.std(noise) < 0.011
    again = rows(spark, "m2_random_view").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_point_features_by_numpy(spark, t):
    got = rows(spark, "m1_point_features").toPandas()
    points = t.points.toPandas()
    assert len(got) == len(points)
    target = points.target_id.iloc[0]
    own, mine = points[points.target_id == target].sort_values(["cwave_um", "image_id"]), got[got.target_id == target].sort_values(["cwave_um", "image_id"])
    f = np.array([list(v) for v in mine.features])
    for column, k in (("aperture_flux_uJy", 2), ("psf_flux_uJy", 3)):
        v = own[column].to_numpy()
        scale = 1.4826 * np.median(np.abs(v - np.median(v)))
        assert np.allclose(f[:, k], np.clip((v - np.median(v)) / scale, -12, 12), atol=1e-5)
    w = own.cwave_um.to_numpy()
    assert np.allclose(f[:, 0], w, atol=1e-6) and np.allclose(f[:, 11], (w - w.min()) / (w.max() - w.min()), atol=1e-6)
    assert np.allclose(f[:, 4], np.clip(own.aperture_flux_uJy / own.aperture_flux_unc_uJy, -50, 50) / 50, atol=1e-6)
    assert f[:, 9].tolist() == own.fatal_flag_present.astype(float).tolist() and f[:, 10].tolist() == own.detector.astype(float).tolist()


def test_clusters_are_nearest_centres(spark, t):
    got = rows(spark, "m8_clusters").toPandas()
    v = {r.vec_id: np.array(r.embedding) for r in t.table("embeddings").collect()}
    x = np.array([v[k] for k in got.vec_id])
    assert len(got) == len(v) and got.cluster_id.nunique() <= 10
    centres = np.array([x[got.cluster_id == c].mean(axis=0) for c in sorted(got.cluster_id.unique())])
    order = sorted(got.cluster_id.unique())
    nearest = np.array(order)[((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    assert (nearest == got.cluster_id).mean() > 0.9  # the centres moved once more after the last assignment
    plane = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(x @ plane.T), np.abs(got[["x", "y"]].to_numpy()), atol=1e-6)


def test_every_query_without_sql_is_tested_by_value():
    """No registered query is only counted."""
    here = open(__file__, encoding="utf-8").read() + open(__file__.replace("test_values", "test_pixels"), encoding="utf-8").read() + open(__file__.replace("test_values", "test_inference"), encoding="utf-8").read()
    missing = sorted(n for n in set(registry.queries()) - set(registry.oracle_sql()) if f'"{n}"' not in here)
    assert missing == []
