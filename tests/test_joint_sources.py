"""Clusters carry the points that support their lines, and joint candidates what follows from both."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import bands
from skyweave.plans import match_queries, registry, scan_queries
from skyweave.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def clusters_by_definition(spark, t, kind, step, gap):
    """Every hit's supporting points, from the whole table; lines at most ``gap`` apart are one cluster."""
    points = t.points.where("not fatal_flag_present").orderBy("cwave_um").toPandas()
    hits = bands.scan(scan_queries._points(t, kind), bands.line_grid(spark, 750.0, 5000.0, step)).where("snr >= 5").toPandas()
    out = {}
    for target, own in hits.sort_values("line_nm").groupby("target_id"):
        p = points[points.target_id == target]
        number, last, lines = -1, None, []
        for h in own.itertuples():
            if last is None or h.line_nm - last > gap:
                number, lines = number + 1, []
                out[f"{target}::{kind}::{number}"] = lines
            last = h.line_nm
            off = p.cwave_um - h.line_nm / 1000
            response = np.exp(-0.5 * (off / (np.sqrt(p.cband_um**2 + 1e-6) / 2.354820045)) ** 2)
            near = (response >= 1e-3) & (off.abs() <= 0.18)
            best = sorted(zip(-response[near], p.image_id[near], strict=True))[:5]
            lines.append((h.snr, h.line_nm, h.amp, int(near.sum()), set(map(str, p.detector[near])), [i for _, i in best]))
    return out


@pytest.mark.parametrize(("step", "gap", "name"), [(25.0, 30.0, "j7_greedy_match"), (5.0, 15.0, "j7_greedy_match_5nm")])
def test_joint_candidates_of_measured_sources(spark, step, gap, name):
    t, want = Tables(spark, SF), {}
    for kind in ("aperture", "psf"):
        found = clusters_by_definition(spark, t, kind, step, gap)
        got = {r.cluster_id: r for r in match_queries.line_clusters(t, kind, step, gap).collect()}
        assert set(got) == set(found) and len(got) > 10
        for key, lines in found.items():
            r, peak = got[key], max(lines, key=lambda s: (s[0], -s[1]))
            assert (r.peak_line_nm, r.supporting_points_max) == (peak[1], max(s[3] for s in lines)) and r.flagged_points_sum == 0
            assert r.peak_flux_uJy == pytest.approx(peak[2]) and r.peak_snr == pytest.approx(peak[0])
            assert r.detectors == ",".join(sorted(set().union(*(s[4] for s in lines))))
            assert r.best_frame_ids == ",".join(list(dict.fromkeys(i for s in lines for i in s[5]))[:12])
        want |= got
    rows = registry.queries()[name](spark, SF).collect()
    assert [(r.tier, -r.rank_score) for r in rows] == sorted((r.tier, -r.rank_score) for r in rows)
    order = lambda r: (not r.has_aperture, -(r.aperture_peak_snr if r.has_aperture else r.psf_peak_snr), r.aperture_cluster_id or r.psf_cluster_id)
    for place, r in enumerate(sorted(rows, key=order)):
        assert r.joint_candidate_id == f"{r.target_id}::joint::{place}::{r.peak_line_nm:g}"
        a, p = want.get(r.aperture_cluster_id), want.get(r.psf_cluster_id)
        sides = [c for c in (a, p) if c]
        assert r.aperture_peak_flux_uJy == (a and pytest.approx(a.peak_flux_uJy)) and r.psf_peak_flux_uJy == (p and pytest.approx(p.peak_flux_uJy))
        assert r.flux_ratio == (pytest.approx(p.peak_flux_uJy / a.peak_flux_uJy) if a and p else None)
        detectors, frames = sorted({d for c in sides for d in c.detectors.split(",")}), list(dict.fromkeys(i for c in sides for i in c.best_frame_ids.split(",")))[:12]
        assert (r.detectors, r.best_frame_ids) == (",".join(detectors), ",".join(frames))
        support = max(c.supporting_points_max for c in sides)
        score = max(c.peak_snr for c in sides) + min(support, 5) * 2.5 + (8.0 if a and p else 0.0) + min(len(detectors), 3) * 1.5 + min(len(frames), 5) * 0.75 - (12.0 if support <= 1 else 0.0)
        assert r.rank_score == pytest.approx(score - (5.0 if r.cluster_width_nm > 250 else 0.0)) and math.isfinite(score)


def test_sources_missing_or_of_equal_response(spark):
    rows = [("t", 1.0 + 0.02 * k, 0.016, 100.0, 10.0, k % 3, f"q{k}") for k in range(-8, 9) if k] + [("t", 1.0, 0.016, 500.0, 10.0, None, "b"), ("t", 1.0, 0.016, 510.0, 10.0, 7, "a"), ("t", 1.0, 0.016, 490.0, 10.0, 7, None)]
    table = spark.createDataFrame(rows, "target_id string, cwave_um double, cband_um double, flux double, unc double, detector int, image_id string")
    got = bands.scan(table, bands.line_grid(spark, 1000.0, 1000.0, 1.0), least_snr=5.0, sources=("detector", "image_id")).first()
    assert got.support == 5 and got.detectors == ["", "1", "2", "7"] and got.best_frame_ids == ["", "a", "b", "q-1", "q1"]
    assert bands.scan(table, bands.line_grid(spark, 1000.0, 1000.0, 1.0), least_snr=1e6, sources=("detector", "image_id")).count() == 0
    assert got.snr == bands.scan(table.drop("detector", "image_id"), bands.line_grid(spark, 1000.0, 1000.0, 1.0)).select(F.col("snr")).first()[0]


def test_scan_by_targets_gives_the_rows_of_segments(spark, monkeypatch):
    from test_hot_target import points

    table = points(spark).withColumnsRenamed({"aperture_flux_uJy": "flux", "aperture_flux_unc_uJy": "unc"}).withColumns({"detector": F.lit(1), "image_id": F.expr("'i' || cast(cwave_um as string)")}).localCheckpoint()
    rows = lambda **how: sorted(map(str, bands.scan(table, bands.line_grid(spark, 750.0, 5000.0, 25.0), sources=("detector", "image_id"), **how).collect()))
    want = rows()
    assert len(want) > 1000 and rows(deal="either") == want
    monkeypatch.setattr(bands, "HOT_POINTS", 500)
    assert bands._hot(table) == ["hot"] and rows(deal="either") == want
