"""A target with a third of all points: the scans deal it over its segments, and give what they gave."""

import numpy as np
from pyspark.sql import functions as F

from skyweave.operators import bands

POINTS = "target_id string, cwave_um double, cband_um double, aperture_flux_uJy double, aperture_flux_unc_uJy double, psf_flux_uJy double, psf_flux_unc_uJy double, fatal_flag_present boolean"


def points(spark, n=3000):
    rng = np.random.default_rng(1)
    names = ["hot" if k % 3 == 0 else f"t{k % 37}" for k in range(n)]
    w, f = rng.uniform(0.75, 5.0, n), rng.normal(100, 10, n)
    return spark.createDataFrame([(names[k] if k % 50 else None, float(w[k]), float(w[k] / 60), float(f[k]), 5.0, float(f[k] * 1.02), 6.0, k % 11 == 0) for k in range(n)], POINTS)


def brute(rows, line_um):
    """The matched filter of one target at one line, from its definition."""
    x, band, f, u = (np.array(v) for v in zip(*rows, strict=True))
    near = np.abs(x - line_um) <= 0.18
    if not near.any():
        return None
    sigma = np.hypot(band[near], 0.001) / 2.354820045
    t = np.exp(-0.5 * ((x[near] - line_um) / sigma) ** 2)
    quiet, used = t <= 0.25, t >= 1e-3
    if used.sum() < 2:
        return None
    level = np.median(f[near][quiet]) if quiet.sum() >= 3 else np.median(f[near]) if near.sum() >= 3 else np.median(f)
    t, d, w = t[used], f[near][used] - level, 1 / u[near][used] ** 2
    return (t * d * w).sum() / np.sqrt((t * t * w).sum())


def test_scan_of_a_hot_target(spark):
    table = points(spark)
    grid = bands.line_grid(spark, 800.0, 4900.0, 410.0)
    scores = bands.scan(table.withColumnsRenamed({"aperture_flux_uJy": "flux", "aperture_flux_unc_uJy": "unc"}), grid)
    got = {(r.target_id, r.line_nm): r.snr for r in scores.collect()}
    series = {}
    for r in table.where("not fatal_flag_present").collect():
        series.setdefault(r.target_id, []).append((r.cwave_um, r.cband_um, r.aperture_flux_uJy, r.aperture_flux_unc_uJy))
    want = {(k, 800.0 + 410.0 * i): brute(v, 0.8 + 0.41 * i) for k, v in series.items() for i in range(11) if len(v) >= 8}
    want = {k: v for k, v in want.items() if v is not None}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_a_hot_target_lies_in_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small here
    try:
        dealt = bands._by_segment(points(spark).select("target_id", "cwave_um", "cband_um"), 0.18)
        spread = dealt.where("target_id = 'hot'").select(F.spark_partition_id().alias("p"), "_segment").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in spread}) > 3 and len(spread) == len({r._segment for r in spread})


def test_both_fluxes_of_a_hot_target(spark):
    table = points(spark)
    grid = bands.line_grid(spark, 800.0, 4900.0, 410.0)
    whole = {(r.target_id, r.line_nm): r.joint_rho for r in bands.dual_scan(table, grid).collect()}
    alone = {(r.target_id, r.line_nm): r.joint_rho for r in bands.dual_scan(table.where("target_id = 'hot'").coalesce(1), grid).collect()}
    assert alone and all(abs(whole[k] - v) < 1e-9 for k, v in alone.items())
