"""Distributed logistic fit against NumPy, pooled features, recovery and injected spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import bands, inference
from skyweave.plans import registry

NAMES = ("a", "b", "c")


def numpy_fit(x, y, ridge):
    """The same penalised problem by plain gradient steps with the exact curvature bound."""
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)])
    penalty = ridge * np.array([0.0] + [1.0] * x.shape[1])
    w, step = np.zeros(z.shape[1]), 1.0 / (0.25 * np.linalg.norm(z.T @ z / len(z), 2) + ridge)
    momentum = w.copy()
    for k in range(60_000):
        gradient = z.T @ (1 / (1 + np.exp(-z @ momentum)) - y) / len(y) + penalty * momentum
        new = momentum - step * gradient
        momentum, w = new + (k % 200) / (k % 200 + 3) * (new - w), new
    return w


def table(spark, x, y, slices):
    return spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y int").repartition(slices)


@pytest.mark.parametrize("case", ["mixed", "separable", "constant"])
def test_weights_equal_a_numpy_fit(spark, case):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [1.0, 100.0, 0.01] + [0.0, 5.0, -3.0]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] + 0.01 * x[:, 1])))).astype(int)
    if case == "separable":
        y = (x[:, 0] > 0).astype(int)
    if case == "constant":
        x[:, 2] = 7.0
    model = inference.fit_logistic(table(spark, x, y, 3), "y", NAMES)
    want = numpy_fit(x, y, 1e-3)
    assert model.weights == pytest.approx(want, rel=1e-5, abs=1e-6) and model.steps < 20
    other = inference.fit_logistic(table(spark, x, y, 7), "y", NAMES)
    assert other.weights == pytest.approx(model.weights, rel=1e-9, abs=1e-9)
    z = np.column_stack([np.ones(300), (x - model.mean) / model.scale]) @ model.weights
    got = [r.p for r in table(spark, x, y, 1).select(model.score().alias("p")).collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-z))).tolist())


def test_one_class_and_no_rows(spark):
    x = np.random.default_rng(5).normal(size=(40, 3))
    with pytest.raises(ValueError):
        inference.fit_logistic(table(spark, x, np.zeros(40), 1).where("a > 1e9"), "y", NAMES)
    for label in (0, 1):  # one class: every score is that class
        rows = table(spark, x, np.full(40, label), 1)
        model = inference.fit_logistic(rows, "y", NAMES)
        assert rows.select(F.max(F.abs(model.score() - label))).first()[0] < 1e-6


def test_recovery_by_place_and_score(spark):
    truth = spark.createDataFrame([("i1", "t1", 900.0), ("i2", "t2", 900.0), ("i3", "t3", 900.0), ("i4", "t4", 900.0), ("i5", "t1", 2000.0)], "injection_id string, target_id string, injected_line_nm double")
    scores = spark.createDataFrame([("t1", 0.9, 905.0), ("t2", 0.4, 900.0), ("t3", 0.9, 950.0)], "target_id string, probability double, line_nm double")
    got = {r.injection_id: r for r in inference.recovery(truth, scores, 10.0).collect()}
    assert {k: r.recovered for k, r in got.items()} == {"i1": True, "i2": False, "i3": False, "i4": False, "i5": False}
    assert got["i1"].delta_nm == 5.0 and got["i4"].probability is None
    best = inference.best_first(inference.infer(spark.createDataFrame([("a", 9, 1.0, 0.0), ("b", 9, 1.0, 2.0), ("c", 9, 1.0, 2.0)], "target_id string, n_points long, line_nm double, peak double"), inference.Logistic(("peak",), np.array([0.0, 1.0]), np.zeros(1), np.ones(1), 1)))
    assert [(r.target_id, r.is_candidate) for r in best.collect()] == [("b", True), ("c", True), ("a", True)]


def test_injected_points_add_the_response(spark):
    points = spark.createDataFrame([("t", w, 0.02, 10.0, 20.0) for w in (0.88, 0.9, 1.3)] + [("u", 0.9, 0.02, 10.0, None)], "target_id string, cwave_um double, cband_um double, aperture_flux_uJy double, psf_flux_uJy double")
    truth = spark.createDataFrame([("t", 900.0, 5.0), ("t", 1300.0, 7.0)], "target_id string, injected_line_nm double, strength double")
    got = {(r.target_id, r.cwave_um): r for r in inference.injected_points(points, truth, F.col("strength") * 2).collect()}
    sigma = math.hypot(0.02, 0.001) / 2.354820045
    assert got["t", 0.9].aperture_flux_uJy == pytest.approx(20.0) and got["t", 1.3].psf_flux_uJy == pytest.approx(34.0)
    assert got["t", 0.88].aperture_flux_uJy == pytest.approx(10.0 + 10.0 * math.exp(-0.5 * (0.02 / sigma) ** 2))
    assert got["u", 0.9].aperture_flux_uJy == 10.0 and got["u", 0.9].psf_flux_uJy is None
    assert bands.response(F.lit(0.9), F.lit(0.02), F.lit(0.9)) is not None


def test_recovery_query_finds_strong_lines(spark):
    rows = registry.queries()["m11_line_recovery"](spark, "/root/testdata/sf0.01").collect()
    strong = [r for r in rows if r.strength >= 8]
    assert len(rows) == 50 and sum(r.recovered for r in strong) >= 0.8 * len(strong)
    assert all(r.recovered == (r.probability >= 0.5 and abs(r.found_nm - r.injected_line_nm) <= 60.0) for r in rows)


def test_pooled_features_of_near_ties_and_of_targets_injected_twice(spark, tmp_path):
    """Against the query's SQL: two heights within a millionth, and a supplier that comes twice."""
    import duckdb

    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").union(spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").where("s_suppkey in (2, 3)")).write.parquet(str(tmp_path / "supplier.parquet"))
    old = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    # the point of x = 4.9 um is higher than that of 0.8 um by less than their distance in millionths
    at = {4.9: 100000.05, 0.8: 100000.0, 2.0: 1000.0, 2.2: 40000.0, 2.4: 75000.0, 2.6: 10000.0}
    place = F.lit(0).cast("long")
    more = None
    for k, (um, price) in enumerate(at.items()):
        want = round((um - 0.75) / 4.25 * 100003)
        order = next(o for o in range(100003) if (7919 + o * 104729 + 31) % 100003 == want)
        row = old.limit(1).withColumns({"l_orderkey": place + order, "l_partkey": place + 1, "l_linenumber": F.lit(1).cast(old.schema["l_linenumber"].dataType), "l_suppkey": place + 77777, "l_extendedprice": F.lit(price).cast(old.schema["l_extendedprice"].dataType), "l_returnflag": F.lit("N")})
        more = row if more is None else more.unionByName(row)
    old.unionByName(more.select(*(F.col(c).cast(old.schema[c].dataType) for c in old.columns))).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, registry.queries()["m11_pooled_features"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    for name in ("supplier", "lineitem"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(c.execute(registry.oracle_sql()["m11_pooled_features"]).fetchall())
    assert next(r for r in got if r[0] == "src_77777")[2] < 900
