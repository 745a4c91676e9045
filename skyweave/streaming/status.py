"""Run status: a stateful fold of events, incremental index shards, stage states from logs."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skyweave.functions.strings import payload_weight
from skyweave.schemas import STATUS_EVENT

#: How an event moves a field, and the order in which a snapshot lists fields.
STATUS_OF = {"field_start": "active", "field_retry": "retrying", "field_done": "done", "field_error": "error"}
ORDER = ("active", "retrying", "error", "done")


def read_events(spark: SparkSession, path: str, watermark: str = "1 hour") -> DataFrame:
    """Stream of JSON-lines event files, with an event time and late data bounded."""
    raw = spark.readStream.schema(STATUS_EVENT).json(path)
    return raw.withColumn("ts", F.timestamp_micros((F.col("time") * 1e6).cast("long"))).withWatermark("ts", watermark)


def status_name(event):
    return F.element_at(F.create_map(*(F.lit(v) for kv in STATUS_OF.items() for v in kv)), event)


def fold(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Latest status, attempts and error of every field; the same plan for batch and stream."""
    known = events.where(F.col("event").isin(*STATUS_OF))
    at = F.struct("ts", tie) if tie else F.struct("ts", "event")
    return known.groupBy("image_id").agg(F.max_by(status_name(F.col("event")), at).alias("status"), F.count_if(F.col("event") == "field_retry").alias("retries"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))


def counters(folded: DataFrame, total: int) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ORDER]
    c = folded.agg(*counts)
    return c.withColumn("queued", F.greatest(F.lit(0), F.lit(total) - sum((F.col(s) for s in ORDER), F.lit(0))))


def snapshot(folded: DataFrame, limit: int = 250) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    return folded.orderBy(rank, F.col("last_ts").desc(), "image_id").limit(limit)


def start_fold(events: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Keep the folded table current in memory under ``name``."""
    return fold(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def deduplicated(events: DataFrame) -> DataFrame:
    """Events once each within the watermark."""
    return events.dropDuplicatesWithinWatermark(["image_id", "event", "attempt"])


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None) -> DataFrame:
    return events.groupBy(F.window("ts", width, slide), "event").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "image_id").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- index shards by run


def append_batch(rows: DataFrame, path: str, batch: int, *parts: str) -> None:
    """Write a micro-batch as its own partition ``batch=<id>``. A batch that is run again writes
    that partition again, so nothing is doubled, and no other batch is touched."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *parts).parquet(path)


def latest_rows(log: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Of every key the row of its last batch; of several in one batch the largest by ``tie``."""
    rest = [c for c in log.columns if c not in keys]
    order = F.struct("batch", *tie)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def upsert_shards(candidates: DataFrame, path: str, checkpoint: str, key: str, tie: list[str], parts: list[str], once: bool = True) -> StreamingQuery:
    """Index shards of candidates, one partition of ``path``/index for each value of ``parts``
    (run or campaign, source), kept current from a stream.

    A batch is first appended to ``path``/log; then the partitions that it names are made anew from
    the whole log and replace the old ones. Since shards come from the log alone, a batch that is
    replayed, or a run whose rows come in several batches, neither doubles nor loses rows, and a
    crash while shards are replaced is mended by the replay. Of rows with one ``key`` the latest
    batch's stays. The partitions of a batch meet the log in a semi-join on its partition columns."""
    spark = candidates.sparkSession
    schema = T.StructType([*(f for f in candidates.schema if f.name not in parts), T.StructField("batch", T.LongType()), *(candidates.schema[p] for p in parts)])

    def write(rows: DataFrame, number: int) -> None:
        append_batch(rows, f"{path}/log", number, *parts)
        log = spark.read.schema(schema).parquet(f"{path}/log")
        named = log.where(F.col("batch") == number).select(*(F.col(p).alias(f"_named_{p}") for p in parts)).distinct()
        same = functools.reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"_named_{p}")) for p in parts))
        shards = latest_rows(log.join(named, same, "left_semi"), [*parts, key], tie)
        shards.drop("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/index")

    start = candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (start.trigger(availableNow=True) if once else start).start()


# ------------------------------------------------------------- stage states from logs and outputs

# What in a log's tail means failure, the mark before a start time, how much of a
# log is read, and how many seconds a silent log counts as active.
ERROR_TOKENS = ("Traceback", "command failed", "CalledProcessError", "Error:", "ERROR")
START_MARK = "=== "
REAL_MARK = "=== 20"
TAIL_CHARS, HEAD_CHARS, ACTIVE_SECONDS = 6000, 8192, 900


def log_facts(logs: DataFrame, text: str, error_tokens: Sequence[str] = ERROR_TOKENS, real_mark: str = REAL_MARK) -> DataFrame:
    """Replaces the column ``text`` of each log by what its state depends on: characters, whether
    a run wrote it (``real_mark`` in its head or tail), whether its tail names an error, the first
    start time after a mark, the last line that isn't blank, and the weight as a prompt (bytes,
    and tokens at 4, 3 and 2.5 characters each). Null is an empty log."""
    t = F.coalesce(F.col(text), F.lit(""))
    head, tail = F.left(t, F.lit(HEAD_CHARS)), F.right(t, F.lit(TAIL_CHARS))
    found = [F.contains(tail, F.lit(token)) for token in error_tokens]
    lines = F.split(F.concat(head, F.lit("\n"), tail), "\r\n|\n|\r")
    marked = F.filter(lines, lambda x: F.contains(x, F.lit(START_MARK)))
    # of the line what stands between the first mark and the next space
    stamps = F.transform(marked, lambda x: F.regexp_extract(x, f"^.*?{START_MARK}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[^ ]*)", 1))
    times = F.filter(F.transform(stamps, lambda x: x.try_cast("timestamp")), lambda x: x.isNotNull())
    spoken = F.filter(F.transform(F.split(tail, "\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")
    return logs.withColumns(
        {
            "n_chars": F.length(t).cast("long"), **payload_weight(t),
            "real_log": F.contains(head, F.lit(real_mark)) | F.contains(tail, F.lit(real_mark)),
            "has_error": functools.reduce(lambda a, b: a | b, found, F.lit(False)),
            "start_time": F.get(times, F.lit(0)), "message": F.element_at(F.when(F.size(spoken) > 0, spoken), -1),
        }
    ).drop(text)


def stage_states(facts: DataFrame, now: Column, active_seconds: float = ACTIVE_SECONDS) -> DataFrame:
    """``facts`` with output_time (null: no output) and log_time. Adds status (done if there is
    output; else error, active or waiting by the log), elapsed_sec, and hides the message of a log
    that no run wrote."""
    real = F.coalesce("real_log", F.lit(False))
    seconds = lambda c: c.cast("double")
    age = seconds(now) - seconds(F.col("log_time"))
    state = F.when(F.col("output_time").isNotNull(), "done").when(real & F.coalesce("has_error", F.lit(False)), "error").when(real & F.coalesce(age < active_seconds, F.lit(False)), "active").otherwise("waiting")
    end = F.coalesce("output_time", F.when(real, F.col("log_time")))
    elapsed = seconds(end) - seconds(F.when(real, F.col("start_time")))
    return facts.withColumns({"status": state, "elapsed_sec": F.when(elapsed >= 0, elapsed), "message": F.when(real, F.col("message"))})


def run_states(stages: DataFrame, *keys: str) -> DataFrame:
    """Roll-up of stages: error before active before waiting; done only if all are."""
    count = lambda s: F.count_if(F.col("status") == s)
    n = F.count(F.lit(1))
    state = F.when(count("error") > 0, "error").when(count("active") > 0, "active").when(count("done") == n, "done").otherwise("waiting")
    return stages.groupBy(*keys).agg(state.alias("state"), n.alias("stages"), *(count(s).alias(s) for s in ("done", "error", "active", "waiting")))
