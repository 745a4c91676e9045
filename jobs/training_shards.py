"""Builds the line-training dataset of many survey runs and its tensor shards.

    spark-submit jobs/training_shards.py --config jobs/training_shards.json --input FOLDER --out PATH

Reads every run of the config from FOLDER with the columns that the run has, unites them in one
plan, scores every series, keeps the wanted quality categories and at most ``most`` targets a run
beside the injected ones, splits by source, and writes under OUT: ``quality`` (by run), ``targets`` and ``points``
(partitioned by split and run), ``shards`` (padded feature tensors, partitioned by split and
shard) and ``manifest`` (one row a target: its split, label, shard and row, and sums over the
tensor as read back). Every table is replaced as a whole, and shard and row of an example depend
on its key alone, so a rerun gives the same result.

Config keys: ``runs`` (name, table, columns: name to SQL expression), ``truth`` (run, table,
columns), ``categories``, ``most``, ``exclude_injected``, ``max_points``, ``low_nm``, ``high_nm``,
``shard_rows``. Defined for empty tables: the dataset is then empty.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.operators import dataset, ml

LOG = logging.getLogger("jobs.training_shards")


def read_part(spark: SparkSession, folder: str, part: dict) -> DataFrame:
    """A table of the config with its columns by name."""
    return spark.read.parquet(f"{folder}/{part['table']}").select(*(F.expr(sql).alias(name) for name, sql in part["columns"].items()))


def _store(df: DataFrame, path: str, *parts: str) -> DataFrame:
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)
    back = spark.read.schema(T.StructType([*(f for f in df.schema if f.name not in parts), *(df.schema[p] for p in parts)])).parquet(path)
    LOG.info("wrote %d rows to %s", back.count(), path)
    return back


def manifest(targets: DataFrame, shards: DataFrame) -> DataFrame:
    """One row a target of the dataset with what its tensor holds; without one shard is null."""
    at = {name: k for k, name in enumerate(ml.FEATURES)}
    total = lambda name: F.aggregate("x", F.lit(0.0), lambda s, v: s + v[at[name]].cast("double"))
    held = shards.select("run_name", "target_id", "shard", "shard_row", F.col("y").cast("double").alias("y"), F.round(F.col("line_norm").cast("double"), 6).alias("line_norm"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("used"),
                         *(F.round(total(name), 2).alias(f"sum_{name}") for name in ("wave", "ap_snr", "ap_norm")))
    chosen = targets.select("run_name", "target_id", "split_id", "run_kind", "n_points", "injected_points", "injection_count", "is_injected_target", "category", F.round("quality_score", 6).alias("quality_score"))
    return chosen.join(held, ["run_name", "target_id"], "left")


def run(spark: SparkSession, config: dict, folder: str, out: str) -> DataFrame:
    """One full build; returns the manifest read back."""
    runs = {part["name"]: read_part(spark, folder, part) for part in config["runs"]}
    for name, df in runs.items():
        LOG.info("run %s: columns %s", name, ",".join(df.columns))
    truth = read_part(spark, folder, config["truth"]).withColumn("run_name", F.lit(config["truth"]["run"]))
    points = dataset.all_runs(runs)
    quality = _store(dataset.quality_of(points), f"{out}/quality", "run_name")
    targets = dataset.select_targets(points, truth, config.get("categories", ()), config.get("most"), config.get("exclude_injected", False), quality)
    kept = _store(targets, f"{out}/targets", "split_id", "run_name")
    series = _store(dataset.select_points(points, kept), f"{out}/points", "split_id", "run_name")
    shards = dataset.tensor_shards(series, truth, config.get("max_points", 384), config.get("low_nm", 700.0), config.get("high_nm", 5000.0), config.get("shard_rows", dataset.SHARD_ROWS))
    dataset.write_shards(shards, f"{out}/shards")
    held = spark.read.schema(shards.schema).parquet(f"{out}/shards")
    LOG.info("wrote %d examples to %s/shards", held.count(), out)
    return _store(manifest(kept, held), f"{out}/manifest", "split_id")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("config", "input", "out"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("training-shards").getOrCreate()
    try:
        config = json.loads("\n".join(r.value for r in spark.read.text(args.config).collect()))
        run(spark, config, args.input, args.out)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
