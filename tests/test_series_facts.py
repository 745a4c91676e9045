"""Facts of series against Spark's own aggregates, whatever the batches."""

import math

import pytest
from pyspark.sql import functions as F

from skyweave.operators import dataset, spectra

POINTS = "run_name string, target_id string, cwave_um double, aperture_flux_uJy double, psf_flux_uJy double, aperture_flux_unc_uJy double, fatal_flag_present boolean"
KEYS = ["target_id", "run_name"]


@pytest.fixture(scope="module")
def points(spark):
    """Series of 1 to 60 points with nulls, flags, NaN and equal values, and null keys."""
    rows = []
    for t in range(60):
        for k in range(t + 1):
            v = (k * 7919 + t * 104729) % 101
            flux = None if v % 17 == 3 else float("nan") if t == 41 and k == 5 else 4.25 if t % 10 == 9 else float(v) - 20.0
            rows.append((None if t % 13 == 0 else f"r{t % 3}", None if t == 26 else f"t{t // 2}", None if v % 23 == 1 else 1.0 + v / 30.0, flux, None if v % 5 == 0 else 4.25 if t % 10 == 9 else v * 0.9 - 17.0 + k, 0.0 if v % 11 == 0 else None if v % 19 == 0 else 2.0 + v % 3, {0: True, 1: None}.get(v % 8, False)))
    return spark.createDataFrame(rows, POINTS)


def marked(points):
    flag = F.coalesce("fatal_flag_present", F.lit(False))
    known = lambda c: F.col(c).isNotNull()
    named = {"_x": "cwave_um", "_a": "aperture_flux_uJy", "_p": "psf_flux_uJy", "_u": "aperture_flux_unc_uJy"}
    return points.select(*KEYS, *(F.col(c).alias(n) for n, c in named.items()), flag.alias("_flag"), (~flag & known("cwave_um") & known("aperture_flux_uJy")).alias("_good"), (~flag & known("aperture_flux_uJy") & known("psf_flux_uJy")).alias("_both"))


def near(a, b):
    return a is b is None or (a is not None and b is not None and (a == pytest.approx(b, rel=1e-12, abs=1e-12) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_facts_equal_aggregates(spark, points, batch):
    rows, before = marked(points), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    good, both, larger = F.col("_good"), F.col("_both"), F.greatest(F.abs("_a"), F.abs("_p"))
    when = lambda m, c: F.when(m, c)
    mid = rows.groupBy(*KEYS).agg(F.median(when(good, F.col("_a"))).alias("_mid")).withColumnsRenamed({"target_id": "_t", "run_name": "_r"})
    same = F.col("target_id").eqNullSafe(F.col("_t")) & F.col("run_name").eqNullSafe(F.col("_r"))
    want = rows.join(mid, same).groupBy(*KEYS).agg(
        F.count(F.lit(1)), F.count_if("_flag"), F.count_if(good), (F.max(when(good, F.col("_x"))) - F.min(when(good, F.col("_x")))) * 1000.0, F.median(when(good & (F.col("_u") > 0), F.abs(F.try_divide("_a", "_u")))), F.count_if(good & (F.col("_u") > 0)),
        F.median(when(good, F.abs(F.col("_a") - F.col("_mid")))), F.stddev_pop(when(good, F.col("_a"))), F.count_if(both), F.median(when(both & (larger > 0), F.try_divide(F.abs(F.col("_a") - F.col("_p")), larger))),
    )
    want = {(r[0], r[1]): r[2:] for r in want.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = spectra.series_facts(rows, KEYS).drop("jag", "corr").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) == 60
    assert all(near(a, b) for r in got for a, b in zip(r[2:], want[r[0], r[1]], strict=True))


def test_steps_and_correlation(spark):
    rows = [("r", "a", 1.0 + k, float(k * k), 3.0 * k * k + 1.0, 1.0, False) for k in (4, 2, 0, 1, 3)] + [("r", "b", 1.0, 2.0, 2.0, 1.0, False), ("r", "b", 2.0, 9.0, None, 1.0, False)]
    got = {r.target_id: r for r in spectra.series_facts(marked(spark.createDataFrame(rows, POINTS)), KEYS).collect()}
    assert (got["a"].jag, got["a"].corr) == (1.0, pytest.approx(1.0)) and (got["b"].jag, got["b"].corr) == (None, None)
    assert spectra.series_facts(marked(spark.createDataFrame([], POINTS)), KEYS).count() == 0


def test_a_series_of_one_value_has_a_quality(spark):
    """Its fluxes have no correlation, which Spark's own aggregate takes for a division by zero."""
    rows = [("r", "flat", 0.75 + 0.05 * k, 0.1, 0.1, 0.01, False) for k in range(60)]
    q = dataset.quality_of(spark.createDataFrame(rows, POINTS)).first()
    whole = spectra.spectrum_quality(spark.createDataFrame(rows, POINTS), "run_name").first()
    assert (whole["corr"], whole["smoothness"], q.n_usable) == (None, 0.5, 60)
