"""Scans by whole targets: as by segments, without lists that are computed anew for every cell."""

import math

import pytest
from pyspark.sql import functions as F
from test_hot_target import POINTS, points

from skyweave.operators import bands
from skyweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["w7_nms_topk", "w7_nms_topk_1nm", "f8_diagnostic_window_1nm", "x25_review_grades_1nm", "w6_local_maxima_1nm"])
def test_lists_are_made_once(spark, name):
    """No filter on a list is inferred and pushed below the step that makes the list."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter")]
    assert not [line for line in filters if "aggregate(" in line or "arrays_zip(" in line]
    assert plan.count("arrays_zip(") == 0 and plan.count("RepartitionByExpression") == 1


def test_hot_targets_are_dealt_by_segments_and_give_the_same(spark, monkeypatch):
    table, grid = points(spark).where("target_id is not null").localCheckpoint(), bands.line_grid(spark, 750.0, 5000.0, 25.0)
    assert bands._hot(table) == []
    rows = lambda df: sorted(map(tuple, df.select("target_id", "line_nm", "support", "q").collect()))
    cells = lambda: rows(bands.dual_scan(table, grid))
    lists = lambda: rows(bands.dual_series(table, grid, ("support", "q")).select("target_id", F.inline("cells")))
    want = cells()
    assert len(want) > 1000 and lists() == want
    monkeypatch.setattr(bands, "HOT_POINTS", 500)
    assert bands._hot(table) == ["hot"]
    assert cells() == want and lists() == want
    monkeypatch.setattr(bands, "GRID_LINES", 50)
    assert lists() == want


def test_pieces_of_one_target_do_not_share_their_points(spark):
    """Few points among many lines beside a dense end: two pieces of a segment lie in one tile."""
    wave = [1.080 + 0.013 * k for k in range(26)] + [1.5951 + 1e-6 * k for k in range(250)]
    table = spark.createDataFrame([("t", w, w / 60, 100.0 + k % 7, 10.0, 90.0 + k % 5, 12.0, False) for k, w in enumerate(wave)], POINTS)
    got = {r.line_nm: r.support for r in bands.dual_scan(table, bands.line_grid(spark, 750.0, 5000.0, 1.0)).collect()}
    packed = bands.dual_scan(table, bands.line_grid(spark, 750.0, 5000.0, 1.0), packed=("support",)).select(F.inline(F.arrays_zip("line_nm", "support"))).collect()
    sigma = lambda w: math.hypot(w / 60, 0.001) / 2.354820045
    for k in range(4251):
        line = 0.75 + k / 1000
        count = sum(abs(w - line) <= 0.18 and math.exp(-0.5 * ((w - line) / sigma(w)) ** 2) >= 1e-3 for w in wave)
        assert got.get(750.0 + k, 0) == count
    assert {r.line_nm: r.support for r in packed} == got


def test_a_lone_point_responds_by_the_library(monkeypatch):
    """Arrays' exponentials may differ in the last digit from the library's, which SQL takes."""
    import numpy as np
    import pyarrow as pa

    seen = []

    def fold(part, of_cell, near, quiet, point, line, t, every):
        seen.append(t)
        return np.arange(near.shape[1]), (np.zeros(near.shape[1]),)

    exact = np.exp
    monkeypatch.setattr(np, "exp", lambda v: np.nextafter(exact(v), 1.0))
    schema = pa.schema([("target_id", pa.string()), ("line_nm", pa.float64()), ("q", pa.float64())])
    points_of_t = pa.RecordBatch.from_pydict({"target_id": ["t"] * 3, "cwave_um": [0.7625, 1.0, 1.001], "cband_um": [0.7625 / 60, 1 / 60, 1.001 / 60]})
    list(bands._fold(np.array([750.0, 775.0, 1000.0]), 0.18, 0.001, 0.25, 1e-3, fold, schema)(iter([points_of_t])))
    sigma = np.sqrt(np.array([0.7625 / 60]) ** 2 + 0.001**2)[0] / 2.354820045
    want = [math.exp(-0.5 * float(np.float_power((0.7625 - line) / sigma, 2.0))) for line in (0.75, 0.775)]
    assert np.concatenate(seen)[:2].tolist() == want


def test_windows_of_lists_with_missing_lines(spark):
    """The bounded part of a list holds every cell within reach, whatever lines are missing."""
    import random

    from skyweave.plans import scan_queries

    random.seed(5)
    lists = [[750.0 + k for k in range(4251) if random.random() < share and not low < k < high] for share, low, high in ((1.0, -1, 0), (0.7, -1, 0), (0.05, -1, 0), (1.0, 100, 4100), (1.0, 0, 3000), (0.9, 1200, 4251))]
    rows = [(f"t{n}", [(x, x / 7) for x in own], peak) for n, own in enumerate(lists) for peak in (own[0], own[len(own) // 2], own[-1], 850.0, 4849.0)]
    table = spark.createDataFrame(rows, "target_id string, cells array<struct<line_nm: double, q: double>>, peak_nm double")
    got = sorted((r.target_id, r.peak_nm, r.line_nm) for r in scan_queries._around(table, 1.0).collect())
    assert got == sorted((t, peak, x) for t, cells, peak in rows for x, _ in cells if abs(x - peak) <= 80)
