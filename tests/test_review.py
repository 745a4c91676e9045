"""Review operators, quality rules and scalar functions on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import numeric, sky, strings
from skyweave.operators import bands, candidates, review

JOINT = "joint_candidate_id string, has_aperture boolean, has_psf boolean, aperture_support int, psf_support int, flagged_points_sum int, detectors string, best_frame_ids string, flux_ratio double, cluster_width_nm double, aperture_peak_snr double, psf_peak_snr double"


def test_quality_rules_take_the_published_sections(spark):
    joint = spark.createDataFrame([("a", True, True, 2, 2, 9, "1", "f1", 0.2, 150.0, 2000.0, 9.0), ("b", True, False, 4, 0, 0, "1,2", "f1,f2", None, None, 12.0, None)], JOINT)
    strict = {r.joint_candidate_id: r for r in candidates.configured_quality(joint).collect()}
    assert strict["a"].quality_category == "reject" and "aperture_snr_pathologically_high" in strict["a"].reject_reasons
    loose = {"thresholds": {"max_flagged_points_sum": 25, "min_aperture_support": 2, "min_psf_support": 2, "min_frame_count": 1, "flux_ratio_psf_aperture_min": 0.1, "flux_ratio_psf_aperture_max": 10.0, "max_aperture_peak_snr": 1e6, "max_cluster_width_nm": 180.0}, "weights": {"base": 5.0}, "categories": {"review": {"min_quality_score": 25.0}}, "version": 1}
    got = {r.joint_candidate_id: r for r in candidates.configured_quality(joint, loose).collect()}
    assert got["a"].quality_pass and got["a"].reject_reasons == ""
    want = 5 + 25 + 2 * 4 + 2 + 1 + 8 * math.log10(2000) - 9 * 12 - abs(math.log10(0.2)) * 12 - 1.5 * 5
    assert got["a"].quality_score == pytest.approx(want)
    assert set(got["b"].reject_reasons.split(",")) == {"missing_aperture_or_psf_match", "psf_support_too_low", "flux_ratio_missing_or_invalid"}
    for wrong in ({"limits": {}}, {"thresholds": {"max_peak_snr": 3}}):
        with pytest.raises(ValueError):
            candidates.configured_quality(joint, wrong)


def test_greedy_match_is_one_to_one(spark):
    rng = np.random.default_rng(3)
    schema = "target_id string, id string, x double, score double"
    a = [(f"t{k % 3}", f"a{k}", float(rng.integers(0, 40)), float(rng.integers(0, 9))) for k in range(60)]
    b = [(f"t{k % 4}", f"b{k}", float(rng.integers(0, 40)), float(rng.integers(0, 9))) for k in range(60)]
    got = {(r.target_id, r.left_id, r.right_id) for r in candidates.greedy_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3.0).collect()}
    want, used = set(), set()
    for t, i, x, s in sorted(a, key=lambda r: (-r[3], r[1])):
        partner = next((c for c in sorted(b, key=lambda r: (-r[3], r[1])) if c[0] == t and c[1] not in used and abs(c[2] - x) <= 3.0), None)
        used.add(partner[1] if partner else None)
        want.add((t, i, partner[1] if partner else None))
    want |= {(t, None, i) for t, i, _, _ in b if i not in used}
    assert got == want


def test_review_filters_and_orders(spark):
    rows = [("j1", "science", "c1", "c1_a", "A", True, 5.0, None, "3"), ("j2", "baseline", "c2", "c1_b", "B", None, None, 7.0, "4"), ("j3", "injected_raw", "c1", "x", "A", False, 9.0, 1.0, None)]
    df = spark.createDataFrame(rows, "joint_candidate_id string, source string, campaign string, run_name string, tier string, quality_pass boolean, psf_peak_snr double, aperture_peak_snr double, detectors string")
    ids = lambda **how: sorted(r[0] for r in review.filter_candidates(df, **how).collect())
    assert ids() == ["j1"] and ids(quality="all") == ["j1", "j2"] and ids(source="all", quality="reject") == ["j2", "j3"]
    assert ids(source="injected", quality="all") == ["j3"] and ids(quality="all", campaign="c1") == ["j1", "j2"]
    assert ids(source="all", quality="all", min_snr=6.0) == ["j2", "j3"] and ids(source="all", quality="all", text="C1_") == ["j1", "j2"]
    assert ids(source="other", quality="all") == [] and ids(source="all", quality="all", tier="B") == ["j2"]
    assert [r[0] for r in review.candidate_page(df, "snr").collect()] == ["j3", "j1", "j2"]
    assert review.candidate_page(df, "unknown", 1, 1).count() == 2
    states = {r.tile_id: r for r in review.tile_states(spark.createDataFrame([(1, "done"), (1, "done"), (2, "pending"), (2, "failed"), (3, "odd")], "tile_id int, state string")).collect()}
    assert (states[1].status, states[1].done, states[2].status, states[3].campaigns) == ("done", 2, "failed", 1)


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    image = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(5.0)))
    assert value(numeric.bilinear(image, F.lit(0.5), F.lit(0.5))) == 2.0 and value(numeric.bilinear(image, F.lit(1.0), F.lit(1.0))) == 5.0
    assert value(numeric.bilinear(image, F.lit(1.01), F.lit(0.0))) is None
    assert value(numeric.snr_feature(F.lit(5.0), F.lit(0.0))) == 0.0 and value(numeric.snr_feature(F.lit(-1e9), F.lit(1.0))) == -1.0
    assert value(numeric.robust_norm(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))) == 0.0
    assert value(strings.query_parameter(F.lit("a=1+2%203&a=4"), "a")) == "1+2 3" and value(strings.query_parameter(F.lit("b=1"), "a")) is None
    assert value(strings.log_time(F.lit("x === 1970-01-01T00:01:00 run"))) == 60 and value(strings.log_time(F.lit("=== soon"))) is None
    pair = lambda name, known=None: tuple(value(c) for c in strings.campaign_and_target(F.lit(name), known))
    assert pair("a_b_c_injected") == ("a_b", "a_b_c") and pair("x_cvj_7_baseline") == ("x", "cvj_7") and pair("alone") == ("", "alone")
    assert pair("g1_t5", ["g1"]) == ("g1", "t5") and pair("g1", ["g1"]) == ("g1", "g1")
    sources = spark.createDataFrame([(359.5, 1.0), (1.0, 0.0), (3.0, 0.0), (0.0, 89.0)], "ra double, dec double")
    assert sky.cone(sources, 0.0, 0.0, 2.0).count() == 2 and sky.cone(sources, 180.0, 89.5, 3.0).count() == 1
    assert value(bands.line_response(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0))) == 1.0


def test_scan_agrees_with_a_loop(spark):
    """The folded scan against the definition, with empty targets, flags, nulls and a wide group."""
    rng = np.random.default_rng(4)
    rows = [(f"t{k % 3}", float(1.0 + rng.random()), 0.02, float(rng.normal(10, 2)), float(rng.choice([0.0, 1.0, 2.0])), bool(rng.random() < 0.1)) for k in range(700)]
    rows += [("few", 1.5, 0.02, 3.0, 1.0, False), ("t0", None, 0.02, 3.0, 1.0, False), ("t1", 1.5, 0.02, None, 1.0, False), (None, 1.5, 0.02, 1.0, None, None)]
    points = spark.createDataFrame(rows, "target_id string, cwave_um double, cband_um double, flux double, unc double, fatal_flag_present boolean")
    for kind in ("median", "mean"):
        got = {(r.target_id, r.line_nm): r for r in bands.scan(points, bands.line_grid(spark, 900.0, 2100.0, 40.0), continuum=kind, window_um=0.1).collect()}
        level, want = (np.median if kind == "median" else np.mean), {}
        for target in ("t0", "t1", "t2"):
            own = np.array([r[1:5] for r in rows if r[0] == target and not r[5] and None not in r[1:4]])
            for line in np.arange(900.0, 2101.0, 40.0):
                near = own[np.abs(own[:, 0] - line / 1000) <= 0.1]
                t = np.exp(-0.5 * ((near[:, 0] - line / 1000) / (np.sqrt(near[:, 1] ** 2 + 1e-6) / 2.354820045)) ** 2)
                used = (t >= 1e-3) & (near[:, 3] > 0)
                if used.sum() < 2:
                    continue
                off = near[t <= 0.25, 2]
                c = level(off) if len(off) >= 3 else level(near[:, 2]) if len(near) >= 3 else level(own[:, 2])
                w = 1 / near[used, 3] ** 2
                want[target, line] = (t[used] * (near[used, 2] - c) * w).sum() / np.sqrt((t[used] ** 2 * w).sum()), c, used.sum()
        assert set(got) == set(want)
        for k, (snr, c, n) in want.items():
            assert got[k].snr == pytest.approx(snr) and got[k].continuum == pytest.approx(c) and got[k].support == n
    assert bands.scan(points, bands.line_grid(spark, 900.0, 900.0, 1.0).where("false")).count() == 0
