"""Challenges: how they are composed, that reruns agree, and how answers are scored."""

from pyspark.sql import functions as F

from skyweave.operators import challenge


def tables(spark, runs=3, n=30):
    injected = spark.createDataFrame([(f"r{k % runs}_injected", f"t{k}", 900.0 + k) for k in range(n)], "run_name string, target_id string, line_nm double")
    targets = spark.createDataFrame([(f"r{k % runs}_baseline", f"t{k}", None if k == 50 else (k % 7) / 10, 100 + k) for k in range(20, 90)], "run_name string, target_id string, flag_fraction double, n_points long")
    return injected, targets


def test_composition(spark):
    injected, targets = tables(spark)
    clean = challenge.clean_targets(targets, injected, 12)
    by_run = {}
    for r in clean.collect():
        by_run.setdefault(r.run_name, []).append(r)
    for run, rows in by_run.items():
        want = sorted(((k % 7) / 10 if k != 50 else 9.0, -(100 + k), f"t{k}") for k in range(30, 90) if f"r{k % 3}_baseline" == run)[:12]
        assert {r.target_id for r in rows} == {w[2] for w in want}
    rows = challenge.compose(injected, clean, 20).collect()
    asked = [r for r in rows if r.role == "challenge"]
    assert len(asked) == 20 and sum(r.is_injected for r in asked) == 10 and sum(r.decoy_of is not None for r in asked) == 2
    assert sorted(r.anon_id for r in asked) == [f"c{k:04d}" for k in range(20)] and [r.is_injected for r in sorted(asked, key=lambda r: r.anon_id)] != sorted((r.is_injected for r in asked), reverse=True)
    signals = {r.signal_id: r for r in rows if r.role == "known_signal"}
    assert len(signals) == 4 and sum(r.role == "known_clean" for r in rows) == 4 and len({r.signal_id for r in rows}) == 28
    for r in asked:
        if r.decoy_of:
            shown = signals[r.decoy_of]
            assert r.target_id == shown.target_id and r.run_name == shown.run_name.replace("_injected", "_baseline") and not r.is_injected
    again = challenge.compose(injected.repartition(5), clean.repartition(3), 20).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert {r.target_id for r in challenge.compose(injected, clean, 20, seed=7).collect()} != {r.target_id for r in rows}


def test_small_and_empty_pools(spark):
    injected, targets = tables(spark, n=5)
    rows = challenge.compose(injected, challenge.clean_targets(targets.limit(3), injected), 20).collect()
    assert sum(r.role == "known_signal" for r in rows) == 4 and sum(r.role == "challenge" and r.is_injected for r in rows) == 1
    assert challenge.compose(injected.limit(0), targets.limit(0), 20).count() == 0


def test_outcomes(spark):
    injected, targets = tables(spark)
    ledger = challenge.compose(injected, challenge.clean_targets(targets, injected), 10)
    truth = {r.anon_id: r.is_injected for r in ledger.where("role = 'challenge'").collect()}
    answers = spark.createDataFrame([(a, [True, False, None][k % 3]) for k, a in enumerate(sorted(truth))] + [("c9999", True), ("p000", True), (None, True)], "anon_id string, signal_like boolean")
    got = {r.anon_id: r.outcome for r in challenge.outcomes(answers, ledger).collect()}
    name = {(True, True): "injected_correctly_found", (True, False): "clean_incorrectly_flagged", (False, True): "injected_missed", (False, False): "clean_correctly_ignored"}
    assert got == {a: name[k % 3 == 0, truth[a]] for k, a in enumerate(sorted(truth))}
    counts = challenge.outcomes(answers, ledger).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in counts) == 10
