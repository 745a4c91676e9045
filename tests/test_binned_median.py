"""Binned medians are sorted within their bins, and two backends' rows need no join."""

import statistics

from pyspark.sql import functions as F

from skyweave.operators import spectra
from skyweave.sources import tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_binned_median(spark):
    rows = [(t, 0.01 * k, None if k % 7 == 0 else float((k * 37) % 11)) for t in ("a", "b", None) for k in range(1, 60)] + [("c", 1.0, None), ("d", None, 2.0)]
    df = spectra.binned_median(spark.createDataFrame(rows, "target_id string, cwave_um double, aperture_flux_uJy double"), 0.05)
    got = {(r.target_id, r.bin): (r.median_flux, r.n) for r in df.collect()}
    bins = {}
    for t, x, f in rows:
        bins.setdefault((t, None if x is None else int(x // 0.05) if abs(x / 0.05 - round(x / 0.05)) > 1e-9 else int(x / 0.05)), []).append(f)
    want = {k: (statistics.median(v) if (v := [f for f in fs if f is not None]) else None, len(fs)) for k, fs in bins.items()}
    assert got == want
    assert "median(" not in _plan(df)


def test_backends_without_a_join(spark):
    df = tables.backends(spark.createDataFrame([(None, 1.0, 2.0), ("a", 3.0, 4.0)], "k string, x double, y double"), ["k"], {"cpu": {"flux": F.col("x")}, "gpu": {"flux": F.col("y")}})
    assert df.columns == ["k", "cpu_flux", "gpu_flux"] and sorted(map(str, map(tuple, df.collect()))) == ["('a', 3.0, 4.0)", "(None, 1.0, 2.0)"]
    assert "Join" not in _plan(df)
