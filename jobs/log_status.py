"""Keeps the status board of survey stages current from their logs.

    spark-submit jobs/log_status.py --config jobs/log_status.json --logs PATH --outputs PATH --heartbeats PATH --out PATH

Incremental: log texts are read as a file stream. Each run takes the log files that came since the
last one (the stream's checkpoint knows), reduces every text to a row of facts, and appends the
facts under the batch's number; a batch that is replayed after a failure replaces its own rows. A
log that comes again in a later batch supersedes its earlier facts. Then the states are derived
anew from the facts (a few hundred bytes a log), the outputs present and the heartbeats, and
written by run. A second run over the same input changes nothing.

Under OUT: ``facts`` (batch=), ``status`` (partitioned by run), ``runs`` (one row a run),
``_checkpoint``. Logs without an id are told apart by their text. Defined for empty tables: the
boards are then empty.

Config keys: columns of the three tables (``log_id``, ``run``, ``stage``, ``text``; ``output_id``,
``output_ready``; ``beat_id``, ``beat_time``), ``error_tokens``, ``real_mark``, ``active_seconds``.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.streaming import status

LOG = logging.getLogger("jobs.log_status")


def facts_of(logs: DataFrame, config: dict) -> DataFrame:
    """A row of facts for each log of a table or stream."""
    rows = logs.select(F.coalesce(F.col(config["log_id"]).cast("string"), F.concat(F.lit("sha1:"), F.sha1(F.coalesce(F.col(config["text"]), F.lit("")).cast("binary")))).alias("log_id"), F.col(config["run"]).cast("string").alias("run"), F.col(config["stage"]).cast("string").alias("stage"), F.col(config["text"]).alias("text"))
    return status.log_facts(rows, "text", config.get("error_tokens", status.ERROR_TOKENS), config.get("real_mark", status.REAL_MARK))


def take_new_logs(spark: SparkSession, config: dict, logs: str, out: str) -> T.StructType:
    """Append the facts of log files that the checkpoint doesn't know yet; returns their schema."""
    # a stream reads a folder or a pattern; as a pattern the path may also name one file
    path = logs.rstrip("/")
    pattern = path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(logs).schema).parquet(pattern)
    facts = facts_of(stream, config)
    # so that the table of facts is there even before the first log
    status.append_batch(spark.createDataFrame([], facts.schema), f"{out}/facts", -1)

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        status.append_batch(batch.observe(seen, F.count(F.lit(1)).alias("logs"), F.sum("n_chars").alias("chars")), f"{out}/facts", number)
        LOG.info("batch %d: read %s logs of %s characters from %s", number, seen.get["logs"], seen.get["chars"], logs)

    running = facts.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return T.StructType([*facts.schema, T.StructField("batch", T.LongType())])


def board(facts: DataFrame, outputs: DataFrame, heartbeats: DataFrame, config: dict) -> DataFrame:
    """One row a log with its state."""
    logs = status.latest_rows(facts, ["log_id"], ["run", "stage", "n_chars", "message"])
    beats = heartbeats.groupBy(F.col(config["beat_id"]).cast("string").alias("log_id")).agg(F.max(config["beat_time"]).cast("timestamp").alias("log_time"))
    now = heartbeats.agg(F.max(config["beat_time"]).cast("timestamp").alias("now"))
    ready = outputs.where(F.col(config["output_ready"]).isNotNull()).select(F.col(config["output_id"]).cast("string").alias("log_id")).where("log_id is not null").distinct().withColumn("output", F.lit(True))
    seen = logs.join(beats, "log_id", "left").join(ready, "log_id", "left").crossJoin(F.broadcast(now))
    # an output is as old as the last sign of its stage
    with_times = seen.withColumn("output_time", F.when(F.col("output"), F.coalesce("log_time", "now")))
    return status.stage_states(with_times, F.col("now"), config.get("active_seconds", status.ACTIVE_SECONDS)).drop("output", "now", "batch")


def run(spark: SparkSession, config: dict, logs: str, outputs: str, heartbeats: str, out: str) -> DataFrame:
    """One incremental run; returns the board as it then stands."""
    schema = take_new_logs(spark, config, logs, out)
    facts = spark.read.schema(schema).parquet(f"{out}/facts")
    states = board(facts, spark.read.parquet(outputs), spark.read.parquet(heartbeats), config)
    states.write.mode("overwrite").partitionBy("run").parquet(f"{out}/status")
    order = T.StructType([*(f for f in states.schema if f.name != "run"), states.schema["run"]])
    written = spark.read.schema(order).parquet(f"{out}/status")
    status.run_states(written, "run").write.mode("overwrite").parquet(f"{out}/runs")
    rolled = spark.read.parquet(f"{out}/runs")
    LOG.info("wrote %d stages of %d runs to %s", written.count(), rolled.count(), out)
    return written


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("config", "logs", "outputs", "heartbeats", "out"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("log-status").getOrCreate()
    try:
        config = json.loads("\n".join(r.value for r in spark.read.text(args.config).collect()))
        run(spark, config, args.logs, args.outputs, args.heartbeats, args.out)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
