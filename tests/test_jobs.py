"""Both jobs on copies of small tables: growing input, replays, reruns, empty tables."""

import datetime
import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import log_status, training_shards
from skyweave.operators import dataset
from skyweave.plans.job_queries import job_config
from skyweave.streaming import status

UTC = datetime.timezone.utc
LOGS = "log_id string, run string, stage string, text string"
CONFIG = {"log_id": "log_id", "run": "run", "stage": "stage", "text": "text", "output_id": "id", "output_ready": "ready", "beat_id": "id", "beat_time": "ts"}
LINE = "x" * 6100


def put(spark, folder, rows, schema, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(str(folder))


@pytest.fixture
def inputs(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 5, 1, 12, m, 0)
    logs = [
        ("a", "r1", "spectra", "=== 2024-05-01T11:00:00 start\nwork\n last words \n\n"), ("b", "r1", "scan", "=== 2024-05-01T11:30:00+00:00\nTraceback (most recent call last)\nboom"),
        ("c", "r1", "plan", "no mark at all\nERROR"), ("d", "r2", "scan", "=== 2024-05-01T11:58:00 go\nstill"), ("e", "r2", "plan", None), (None, "r2", "lost", "=== 2024 odd\n=== 2024-05-01 day"), ("f", None, "scan", "ERROR\n" + LINE + "\n=== 2024-05-01T01:00:00 x"),
    ]
    put(spark, tmp_path / "logs", logs, LOGS)
    put(spark, tmp_path / "outputs", [("a", 1), ("a", 1), ("c", None), (None, 1)], "id string, ready int")
    put(spark, tmp_path / "beats", [("a", at(10)), ("a", at(40)), ("b", at(59)), ("c", at(59)), ("d", at(50)), ("f", at(20)), (None, at(59))], "id string, ts timestamp")
    return tmp_path


def board(spark, at):
    rows = log_status.run(spark, CONFIG, f"{at}/logs", f"{at}/outputs", f"{at}/beats", f"{at}/out").collect()
    return {r.log_id: r for r in rows}, rows


def test_log_status_over_growing_input(spark, inputs, caplog):
    with caplog.at_level(logging.INFO):
        first, rows = board(spark, inputs)
    assert len(rows) == 7 and "read 7 logs" in caplog.text and "wrote 7 stages of 3 runs" in caplog.text
    assert {k: r.status for k, r in first.items() if k and not k.startswith("sha1:")} == {"a": "done", "b": "error", "c": "waiting", "d": "active", "e": "waiting", "f": "waiting"}
    lost = next(r for k, r in first.items() if k.startswith("sha1:"))
    assert (lost.status, lost.start_time) == ("waiting", datetime.datetime(2024, 5, 1))
    assert first["a"].message == "last words" and first["a"].elapsed_sec == 100 * 60.0  # 11:00 to 12:40
    assert first["b"].message == "boom" and first["b"].elapsed_sec == 89 * 60.0 and first["c"].message is None
    assert (first["e"].n_chars, first["e"].tokens_4) == (0, 0) and first["f"].tokens_2p5 == round(len("ERROR\n" + LINE + "\n=== 2024-05-01T01:00:00 x") / 2.5)
    # nothing new: nothing read, the same board
    caplog.clear()
    with caplog.at_level(logging.INFO):
        again, _ = board(spark, inputs)
    assert again == first and "batch" not in caplog.text
    # new files: a log that came before, a new one
    put(spark, inputs / "logs", [("d", "r2", "scan", "=== 2024-05-01T11:58:00 go\nCalledProcessError"), ("g", "r2", "scan", "")], LOGS)
    with caplog.at_level(logging.INFO):
        later, rows = board(spark, inputs)
    assert "read 2 logs" in caplog.text and len(rows) == 8
    assert later["d"].status == "error" and later["g"].status == "waiting" and {k: v for k, v in later.items() if k not in ("d", "g")} == {k: v for k, v in first.items() if k != "d"}
    facts = spark.read.parquet(f"{inputs}/out/facts")
    assert facts.count() == 9  # the texts of the first run were not read again
    runs = {r.run: r for r in spark.read.parquet(f"{inputs}/out/runs").collect()}
    assert runs["r2"].state == "error" and runs["r1"].stages == 3 and runs[None].state == "waiting"


def test_a_replayed_batch_replaces_itself(spark, inputs):
    first, _ = board(spark, inputs)
    schema = spark.read.parquet(f"{inputs}/out/facts").schema
    batch = spark.read.schema(schema).parquet(f"{inputs}/out/facts").where("batch = 0")
    rows = batch.drop("batch").collect()
    status.append_batch(spark.createDataFrame(rows, batch.drop("batch").schema), f"{inputs}/out/facts", 0)
    again, _ = board(spark, inputs)
    assert again == first and spark.read.parquet(f"{inputs}/out/facts").count() == 7


def test_log_status_of_empty_tables(spark, tmp_path):
    put(spark, tmp_path / "logs", [], LOGS)
    put(spark, tmp_path / "outputs", [], "id string, ready int")
    put(spark, tmp_path / "beats", [], "id string, ts timestamp")
    assert board(spark, tmp_path)[1] == []
    put(spark, tmp_path / "logs", [("a", "r", "s", "=== 2024-05-01T11:00:00 start")], LOGS)
    assert [r.status for r in board(spark, tmp_path)[1]] == ["waiting"]


def test_shards_by_run_survive_replays_and_split_runs(spark, tmp_path):
    schema = "run_name string, candidate string, score double, extra string"
    source, out = tmp_path / "in", str(tmp_path / "index")
    shard = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{out}/index").select("run_name", "candidate", "score").collect())

    def take(checkpoint="c"):
        stream = spark.readStream.schema(schema).parquet(str(source))
        status.upsert_shards(stream, out, str(tmp_path / checkpoint), "candidate", ["score"], ["run_name"]).awaitTermination()

    put(spark, source, [("r1", "a", 1.0, None), ("r1", "b", 2.0, None), ("r2", "c", 3.0, None), ("r2", "c", 2.5, None)], schema)
    take()
    assert shard() == [("r1", "a", 1.0), ("r1", "b", 2.0), ("r2", "c", 3.0)]
    put(spark, source, [("r1", "d", 4.0, None), ("r1", "a", 0.5, None)], schema)  # the run's second part
    take()
    want = [("r1", "a", 0.5), ("r1", "b", 2.0), ("r1", "d", 4.0), ("r2", "c", 3.0)]
    assert shard() == want
    take()
    assert shard() == want
    # the last batch again, as after a crash before its commit
    commit = tmp_path / "c" / "commits" / "1"
    commit.unlink()
    (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
    take()
    assert shard() == want and spark.read.parquet(f"{out}/log").count() == 6


POINTS = "target_id string, source_id string, image_id string, detector int, cwave_um double, cband_um double, aperture_flux_uJy double, aperture_flux_unc_uJy double, psf_flux_uJy double, psf_flux_unc_uJy double, fatal_flag_present boolean, note string"


def survey(spark, n=30):
    rows = [(f"t{t}", f"s{t // 2}", f"i{k}", 1, 0.8 + 0.05 * k + 0.001 * t, 0.02, 100.0 + t + k % 3, 5.0, 99.0 + t + k % 3, 5.0, k % 11 == 0, "x") for t in range(n) for k in range(5 + t)]
    full = spark.createDataFrame(rows, POINTS)
    less = full.drop("psf_flux_uJy", "psf_flux_unc_uJy", "detector", "note").withColumn("path_override_applied", full["target_id"] == "t7").withColumn("aperture_flux_uJy", full["aperture_flux_uJy"].cast("string"))
    truth = spark.createDataFrame([("new_injected", "t7", "i1", 900.0, 5.0), ("new_injected", "t7", "i2", 1100.0, 6.0), ("new_injected", "t8", "i3", 9000.0, 4.0), ("new_injected", None, "i4", 900.0, 1.0)], "run_name string, target_id string, injection_id string, injected_line_nm double, find_me_snr double")
    return {"old_baseline": full, "new_injected": less}, truth


def test_dataset_keeps_runs_with_missing_columns_and_splits_by_source(spark):
    runs, truth = survey(spark)
    points = dataset.all_runs(runs)
    targets = dataset.select_targets(points, truth)
    rows = targets.collect()
    assert len(rows) == 60 and {r.run_kind for r in rows} == {"baseline", "injected"}
    split = {}
    for r in rows:
        assert split.setdefault(r.source_id, r.split_id) == r.split_id
    seven = next(r for r in rows if r.run_name == "new_injected" and r.target_id == "t7")
    assert (seven.injection_count, seven.injected_points, seven.n_points, seven.is_injected_target) == (2, 12, 12, True)
    few = dataset.select_targets(points, truth, most=5).collect()
    kept = lambda run: {r.target_id for r in few if r.run_name == run}
    assert len(kept("old_baseline")) == 5 and {"t7", "t8"} <= kept("new_injected") and len(kept("new_injected")) == 5
    assert not dataset.select_targets(points, truth, exclude_injected=True).where("is_injected_target").count()
    chosen = dataset.select_points(points, targets.where("target_id = 't9'")).orderBy("run_name", "point_index").collect()
    assert [r.point_index for r in chosen] == [*range(14), *range(14)] and [r.cwave_um for r in chosen[:14]] == sorted(r.cwave_um for r in chosen[:14])


def test_tensor_shards_do_not_depend_on_partitions(spark, tmp_path):
    runs, truth = survey(spark)
    found = {}
    for k, slices in enumerate((1, 7)):
        points = dataset.all_runs({name: df.repartition(slices) for name, df in runs.items()})
        chosen = dataset.select_points(points, dataset.select_targets(points, truth))
        dataset.write_shards(dataset.tensor_shards(chosen, truth, max_points=20, rows=4), str(tmp_path / str(k)))
        back = spark.read.parquet(str(tmp_path / str(k)))
        found[k] = {(r.split_id, r.shard, r.shard_row): r for r in back.collect()}
    assert found[0] == found[1]
    rows = list(found[0].values())
    assert len(rows) == 54 and {r.target_id for r in rows} == {f"t{k}" for k in range(3, 30)}
    sizes = {}
    for split, shard, _ in found[0]:
        sizes.setdefault(split, {}).setdefault(shard, 0)
        sizes[split][shard] += 1
    for shards in sizes.values():
        assert sorted(shards) == list(range(len(shards))) and all(n == 4 for s, n in shards.items() if s < len(shards) - 1)
    for r in rows:
        n = min(20, int(r.target_id[1:]) + 5)
        assert r.mask == [True] * n + [False] * (20 - n) and len(r.x) == 20 and all(len(v) == 13 for v in r.x)
        assert [v[0] for v in r.x[:n]] == sorted(v[0] for v in r.x[:n]) and not any(any(v) for v in r.x[n:])
        positive = r.run_name == "new_injected" and r.target_id == "t7"
        assert (r.y, round(r.line_norm, 6)) == ((1.0, round(300 / 4300, 6)) if positive else (0.0, 0.0))


def test_training_job_reruns_and_takes_empty_tables(spark, tmp_path, caplog):
    source, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    config = {**job_config("training_shards"), "most": 30, "shard_rows": 8}
    with caplog.at_level(logging.INFO):
        first = training_shards.run(spark, config, source, out).collect()
    again = training_shards.run(spark, config, source, out).collect()
    assert sorted(first) == sorted(again) and first and f"wrote {len(first)} rows to {out}/manifest" in caplog.text
    for table in ("lineitem", "orders", "supplier"):
        spark.read.parquet(f"{source}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert training_shards.run(spark, config, f"{tmp_path}/none", f"{tmp_path}/empty").count() == 0


def test_configs_are_plain_json():
    for name in ("log_status", "training_shards"):
        assert json.dumps(job_config(name))


def test_command_lines_start_and_stop_their_own_session(tmp_path):
    """Both jobs as programs, the incremental one twice."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    data = "/root/testdata/sf0.001"
    start = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    logs = [f"{root}/jobs/log_status.py", "--config", f"{root}/jobs/log_status.json", "--logs", f"{data}/documents.parquet", "--outputs", f"{data}/labels.parquet", "--heartbeats", f"{data}/events.parquet", "--out", f"{tmp_path}/board"]
    first, second = start(*logs), start(*logs)
    assert first.returncode == 0 and "read 200 logs" in first.stderr and "wrote 200 stages" in first.stderr, first.stderr[-2000:]
    assert second.returncode == 0 and "read" not in "".join(x for x in second.stderr.splitlines() if "jobs.log_status" in x) and "wrote 200 stages" in second.stderr
    shards = start(f"{root}/jobs/training_shards.py", "--config", f"{root}/jobs/training_shards.json", "--input", data, "--out", f"{tmp_path}/shards")
    assert shards.returncode == 0 and "examples to" in shards.stderr, shards.stderr[-2000:]


def test_points_of_other_targets_are_left_out_before_they_are_shuffled(spark):
    name = F.when(F.col("id") % 1000 != 999, F.concat(F.lit("t"), (F.col("id") % 1000).cast("string")))
    points = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "r").alias("run_name"), name.alias("target_id"), "id")
    wanted = points.where("id in (0, 7, 500, 999)").select("run_name", "target_id")
    near = dataset.near_targets(points, wanted)
    ids = {r.id for r in near.select("id").collect()}
    assert ids >= {i for i in range(20_000) if i % 1000 in (0, 7, 500, 999)} and len(ids) < 400 and near.columns == points.columns
    assert dataset.near_targets(points, wanted.limit(0)).count() == 0
