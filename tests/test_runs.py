"""Small operators of runs and recovery on the rows that matter: nulls, zeros, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from skyweave.operators import ml, recovery, runs, spectra, windows
from skyweave.sources import tables


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_groups_and_totals(spark):
    cases = table(spark, [("a", True, 4.0), ("a", None, None), ("a", False, 2.0), ("b", False, None)], "k string, recovered boolean, score double")
    got = {r.k: r for r in recovery.recovery_groups(cases, "k").collect()}
    assert (got["a"].injected, got["a"].recovered, got["a"].median_score) == (3, 1, 2.0) and got["b"].fraction == 0.0
    parts = table(spark, [("r1", 3, 1, 2), ("r2", 0, 0, 5), ("r1", None, None, 1)], "run string, injected int, recovered int, false_positives int")
    by = {r.run: r for r in recovery.recovery_totals(parts, "run").collect()}
    assert (by["r1"].missed, round(by["r1"].fraction, 6), by["r1"].false_positives_per_injection) == (2, 0.333333, 1.0) and by["r2"].fraction is None and by["r2"].false_positives == 5
    none = recovery.recovery_totals(parts.limit(0)).collect()
    assert len(none) == 1 and (none[0].injected, none[0].fraction) == (0, None)
    again = recovery.reaggregated(table(spark, [("a", 1, 5.0), ("a", 9, 1.0), ("a", 1, 2.0)], "k string, n int, m double"), "k", sums=["n"], medians=["m"]).first()
    assert (again.n, again.median_of_m) == (11, 2.0)


def test_confusion_and_probabilities(spark):
    rows = table(spark, [(True, True), (True, False), (False, True), (False, False), (None, True), (True, None), (True, True)], "p boolean, a boolean")
    r = recovery.confusion(rows, F.col("p"), F.col("a")).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 1, 1) and r.precision_ == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3)
    none = recovery.confusion(rows.limit(0), F.col("p"), F.col("a")).first()
    assert (none.tp, none.precision_, none.recall) == (0, None, None)
    p = recovery.probability_summary(table(spark, [(0.1,), (0.5,), (None,), (0.9,)], "x double"), F.col("x"), {"half": 0.5}).first()
    assert (p.mean_p, p.median_p, p.max_p, p.half) == (0.5, 0.5, 0.9, 2)


def test_injection_tables(spark):
    truth = table(spark, [("i1", "t1", 1.0), ("i2", None, 2.0)], "injection_id string, target_id string, line_nm double")
    false = table(spark, [("t1", 3.0, 7.0)], "target_id string, line_nm double, snr double")
    got = {(r.kind, r.target_id): r for r in recovery.injection_table(truth, false, table(spark, [("t1",), ("t1",), (None,)], "target_id string")).collect()}
    assert (got["truth", "t1"].candidates, got["truth", None].candidates, got["false_positive", "t1"].candidates) == (2, 0, 2)
    assert got["truth", "t1"].snr is None and got["false_positive", "t1"].injection_id is None
    outcome = {r.injection_id: r.recovered for r in recovery.recovered_or_missed(truth, table(spark, [("i1", True), ("i9", True)], "injection_id string, recovered boolean"), "injection_id").collect()}
    assert outcome == {"i1": True, "i2": False}
    flags = table(spark, [("er", 1550.0), ("er", 1560.0), ("er", 1560.5), ("yb", 1550.0), (None, 1550.0), ("er", None)], "f string, x double").select(recovery.selected_injection(F.col("f"), F.col("x"), "er", 1550.0).alias("s"))
    assert [r.s for r in flags.collect()] == [True, True, False, False, False, False]
    pairs = recovery.run_pairs(table(spark, [("a_injected",), ("b_injected",), ("c_baseline",), (None,)], "run string"), table(spark, [("a_baseline",), ("a_baseline",), ("b_injected",)], "run string")).collect()
    assert [tuple(r) for r in pairs] == [("a_injected", "a_baseline")]


def test_positions_and_batches_over_many_ranges(spark):
    names = [f"n{k:04d}" for k in range(500)] + [None, "n0003"]
    df = table(spark, [(n,) for n in names], "name string").repartition(9)
    order = [F.col("name").asc_nulls_last()]
    want = sorted(names, key=lambda n: (n is None, n or ""))
    got = recovery.positional_join(df.withColumnRenamed("name", "a"), df, [F.col("a").asc_nulls_last()], order).orderBy("i").collect()
    assert [(r.i, r.a, r.name) for r in got] == [(k, n, n) for k, n in enumerate(want)]
    batches = runs.batches(df, order, 7).collect()
    sizes = {}
    for r in batches:
        sizes[r.batch] = sizes.get(r.batch, 0) + 1
    assert sizes == {k: min(7, 502 - 7 * k) for k in range(72)}
    assert {(r.name, r.batch) for r in batches if r.name} == {(n, k // 7) for k, n in enumerate(want) if n}
    assert runs.batches(df.limit(0), order, 7).count() == 0


def test_states(spark):
    events = table(spark, [("a", "field_start"), ("a", "field_error"), ("b", "field_start"), ("c", "field_done"), ("c", "field_start"), ("d", "field_done"), ("e", None)], "id string, event string")
    assert {r.id: (r.status, r.n) for r in runs.stage_status(events, "id", "event").collect()} == {"a": ("error", 2), "b": ("active", 1), "c": ("waiting", 2), "d": ("done", 1), "e": ("waiting", 1)}
    p = {r.id: (r.phase, r.percent) for r in runs.progress(events, "id", F.col("event") == "field_done").collect()}
    assert p == {"a": ("queued", 0.0), "b": ("queued", 0.0), "c": ("running", 50.0), "d": ("finished", 100.0), "e": ("queued", 0.0)}
    jobs = table(spark, [("x", "P"), ("x", "F"), ("y", "F"), ("y", "O"), ("z", "O"), ("w", "O"), ("w", None)], "c string, s string")
    s = F.col("s")
    assert {r.command: r.state for r in runs.dispatch_state(jobs, "c", s == "P", s == "F", s == "O").collect()} == {"x": "active", "y": "failed", "z": "done", "w": "pending"}
    tiles = runs.tile_map(table(spark, [(1,), (2,), (None,)], "tile int"), table(spark, [(2, "busy"), (9, "busy")], "tile int, state string"), "tile").collect()
    assert sorted(((r.tile, r.state) for r in tiles), key=str) == [(1, "idle"), (2, "busy"), (None, "idle")]


def test_plans(spark):
    grid = runs.plan_grid(table(spark, [("a b",), ("c",)], "target_id string"), {"er": 1550.0, "yb": 1064.0}, [3, 8], [-5.0, 0.0, 5.0]).collect()
    assert len(grid) == 24 and len({(r.target_id, r.fam, r.strength, r.offset_nm) for r in grid}) == 24
    assert {r.line_nm for r in grid if r.fam == "er"} == {1545.0, 1550.0, 1555.0} and next(r for r in grid if r.target_id == "a b").injection_id.startswith("a_b_")
    with pytest.raises(ValueError, match="repeated a"):
        runs.require_unique(table(spark, [(1, 2), (1, 3)], "a int, b int"), "a")
    assert runs.require_unique(table(spark, [(1, 2), (1, 3)], "a int, b int"), "a", "b").count() == 2
    plan = runs.dispatch_plan(table(spark, [(4,), (7,)], "t int"), "t", table(spark, [("g2",), ("g1",)], "bin string"), 3).collect()
    assert sorted(r.command for r in plan) == sorted(f"tile{t}_{b}_b{k}" for t in (4, 7) for b in ("g1", "g2") for k in range(3))
    bins = table(spark, [("a:8:11:20, b:11:13:5,bad,c:x:1:2,:1:2:3,d:1:2",), (None,)], "s string").select(runs.magnitude_bins(F.col("s")).alias("b")).collect()
    assert [tuple(x) for x in bins[0].b] == [("a", 8.0, 11.0, 20), ("b", 11.0, 13.0, 5)] and bins[1].b is None
    stars = table(spark, [(8.0,), (11.0,), (12.9,), (13.0,), (None,)], "mag double").withColumn("bins", runs.magnitude_bins(F.lit("a:8:11:20,b:11:13:5")))
    assert [(r.mag, r.bin.name) for r in runs.in_bins(stars, "mag", F.col("bins")).collect()] == [(8.0, "a"), (11.0, "b"), (12.9, "b")]


def test_shares_and_timings(spark):
    s = runs.shares(table(spark, [("a", 1.0), ("b", 3.0), ("c", None)], "k string, v double"), "v").collect()
    assert {r.k: r.percent for r in s} == {"a": 25.0, "b": 75.0, "c": None}
    assert {r.percent for r in runs.shares(table(spark, [("a", 0.0)], "k string, v double"), "v").collect()} == {None}
    split = runs.proportional_split(table(spark, [("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 0.0)], "k string, r double"), "k", "r", 10).collect()
    assert {r.k: r.share for r in split} == {"a": 4, "b": 3, "c": 3, "d": 0}
    trials = table(spark, [("cpu", "x", 2.0, 10), ("cpu", "x", 4.0, 10), ("cpu", "y", 1.0, 10), ("gpu", "z", 0.0, 10)], "d string, c string, s double, w int")
    got = {(r.d, r.c): r for r in runs.timing_summary(trials, "d", "c", "s", "w").collect()}
    assert (got["cpu", "x"].median_sec, got["cpu", "x"].best_rate, got["cpu", "x"].is_best, got["cpu", "y"].is_best) == (3.0, 5.0, False, True)
    assert got["gpu", "z"].best_rate is None and got["gpu", "z"].is_best
    timing = {r.stage: r for r in runs.stage_timing(table(spark, [("a", 1.0), ("a", None), ("b", None)], "st string, v double"), "st", "v").collect()}
    assert (timing["a"].n, timing["a"].total, timing["a"].mean, timing["b"].total) == (2, 1.0, 1.0, None)


POINTS = "target_id string, cwave_um double, cband_um double, aperture_flux_uJy double, aperture_flux_unc_uJy double, fatal_flag_present boolean, detector int, flags_summary int"


def test_support_and_summaries_of_points(spark):
    rows = [("a", 1.55, 0.02, 10.0, 2.0, False, 1, 1), ("a", 1.551, 0.02, 12.0, 4.0, None, 2, 4), ("a", 1.55, 0.02, 99.0, 9.0, True, 2, -2147483648), ("a", 3.0, 0.02, 1.0, 1.0, False, 3, None), ("b", 3.0, 0.02, 5.0, 1.0, True, 1, 0)]
    p = table(spark, rows, POINTS)
    s = {r.target_id: r for r in recovery.target_support(p, 1.55).collect()}
    assert (s["a"].usable, s["a"].max_response, s["a"].median_unc, s["b"].usable, s["b"].median_unc) == (2, 1.0, 3.0, 0, None)
    flux = {r.target_id: r.line_flux for r in recovery.find_me_flux(p, 1.55, 5.0).collect()}
    assert set(flux) == {"a"} and 15.0 < flux["a"] < 15.3
    assert spectra.unflagged(p).count() == 3 and {r.target_id: r.flags for r in spectra.flags_of(p).collect()} == {"a": -2147483643, "b": 0}
    e = {r.target_id: r for r in spectra.evidence(p).collect()}
    assert (e["a"].n, e["a"].flagged, e["a"].detectors, e["a"].med) == (4, 1, 3, 11.0)
    assert [r.target_id for r in spectra.background_selection(p, 1, 5).collect()] == ["a"]
    d = spectra.distinct_counts(p, targets="target_id", detectors="detector").first()
    assert (d.targets, d.detectors) == (2, 3)
    bins = spectra.magnitude_report(table(spark, [(9, 40, 0.6, 2.0), (9, 39, 0.0, 9.0), (9, 50, None, 9.0)], "g int, usable int, fatal double, snr double"), "g").first()
    assert (bins.targets, bins.allowed, bins.median_snr) == (3, 1, 9.0)


def test_sets_and_sizes(spark):
    a, b = table(spark, [("x", 1), ("x", 2), ("y", 3), (None, 4)], "id string, v int"), table(spark, [("x",), (None,), (None,)], "id string")
    assert {r.id for r in tables.ids_in_both(a, b, "id").collect()} == {"x", None} and [r.id for r in tables.ids_only_in(a, b, "id").collect()] == ["y"]
    assert tables.rows_of(a, b, ["id"]).count() == 2
    e = {(r.id, r.v): (r.n, r.s) for r in tables.enriched(a, ["id"], table(spark, [("x", 5, "s")], "id string, n int, s string"), zero=["n"]).collect()}
    assert e["x", 1] == (5, "s") and e["y", 3] == (0, None)
    u = tables.union_all({"a": a, "b": b.withColumn("w", F.lit(1.5))}, "origin").collect()
    assert len(u) == 7 and {(r.origin, r.v is None, r.w is None) for r in u} == {("a", False, True), ("b", True, False)}
    assert sorted((r.v, r.n) for r in windows.with_group_size(a, ["id"], "n").collect()) == [(1, 2), (2, 2), (3, 1), (4, 1)]
    assert [tuple(r) for r in windows.groups_of_at_least(a, ["id"], 2).collect()] == [("x", 2)]
    band = tables.magnitude_band(table(spark, [("9",), ("12.0",), ("12.1",), ("dim",), (None,)], "g string"), "g", 9.0, 12.0)
    assert [r.g for r in band.collect()] == ["9", "12.0"]
    assert ml.metadata_stats(table(spark, [(1.0,), (2.0,), (6.0,)], "x double"), "x").first().median == 2.0
    assert {(r.s, r.n) for r in ml.dataset_counts(table(spark, [("t",), ("t",), (None,)], "s string"), "s").collect()} == {("t", 2), (None, 1)}
    c = ml.cluster_statistics(table(spark, [(1, 5.0), (1, 7.0), (None, 1.0)], "c int, x double"), "c", {"mx": "x"}).collect()
    assert {(r.c, r.n, r.mx) for r in c} == {(1, 2, 6.0), (None, 1, 1.0)}
