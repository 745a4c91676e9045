"""State of runs, stages and tiles, and the plans that start them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.numeric import ratio
from skyweave.functions.strings import sanitise
from skyweave.operators import windows


def stage_timing(rows: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Runs of each stage, their total, mean and longest time."""
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.max(seconds).alias("most"))


def shares(rows: DataFrame, value: str, name: str = "percent") -> DataFrame:
    """Each row's share of the whole in percent, null over 0. The whole is one row, broadcast."""
    whole = rows.agg(F.sum(value).alias("_whole"))
    return rows.crossJoin(F.broadcast(whole)).withColumn(name, 100.0 * ratio(F.col(value), F.col("_whole"))).drop("_whole")


def status_matrix(events: DataFrame, key: str, event: str, kinds: Sequence[str]) -> DataFrame:
    """Counts of each kind of event by key, one column a kind, and of all."""
    return events.groupBy(key).agg(*(F.count_if(F.col(event) == k).alias(k) for k in kinds), F.count(F.lit(1)).alias("n"))


def stage_status(events: DataFrame, key: str, event: str) -> DataFrame:
    """Roll-up of a key's events: an error before work begun and not done, before all done."""
    m = status_matrix(events, key, event, ("field_start", "field_done", "field_error"))
    state = F.when(F.col("field_error") > 0, "error").when(F.col("field_start") > F.col("field_done"), "active").when(F.col("field_done") == F.col("n"), "done").otherwise("waiting")
    return m.select(key, state.alias("status"), "n")


def progress(rows: DataFrame, key: str, done: Column) -> DataFrame:
    """Phase and percent of every key from how many of its rows are done."""
    c = rows.groupBy(key).agg(F.count_if(F.coalesce(done, F.lit(False))).alias("done"), F.count(F.lit(1)).alias("total"))
    phase = F.when(F.col("done") == F.col("total"), "finished").when(F.col("done") > 0, "running").otherwise("queued")
    return c.select(key, phase.alias("phase"), (100.0 * ratio(F.col("done"), F.col("total"))).alias("percent"))


def dispatch_state(jobs: DataFrame, command: str, active: Column, failed: Column, done: Column) -> DataFrame:
    """State of each command from its jobs: active before failed before done (all of them) before
    pending."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    state = F.when(flag(active) > 0, "active").when(flag(failed) > 0, "failed").when(flag(done) == F.count(F.lit(1)), "done").otherwise("pending")
    return jobs.groupBy(F.col(command).alias("command")).agg(state.alias("state"), F.count(F.lit(1)).alias("n"))


def tile_map(tiles: DataFrame, states: DataFrame, key: str, default: str = "idle") -> DataFrame:
    """Every tile with its state, ``default`` where none is known."""
    found = states.select(F.col(key).alias("_key"), "state")
    return tiles.join(found, tiles[key] == F.col("_key"), "left").drop("_key").withColumn("state", F.coalesce("state", F.lit(default)))


def dispatch_plan(tiles: DataFrame, tile: str, bins: DataFrame, batches: int) -> DataFrame:
    """A command for every tile, magnitude bin and batch; bins and batches are short lists that are
    laid out beside each tile, so tiles are never shuffled."""
    names = bins.agg(F.sort_array(F.collect_list("bin")).alias("_bins"))
    rows = tiles.crossJoin(F.broadcast(names)).select(F.col(tile).alias("tile"), F.explode("_bins").alias("bin")).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    return rows.withColumn("command", F.concat(F.lit("tile"), F.col("tile").cast("string"), F.lit("_"), "bin", F.lit("_b"), F.col("batch").cast("string")))


def plan_grid(targets: DataFrame, families: dict[str, float], strengths: Sequence[float], offsets: Sequence[float]) -> DataFrame:
    """Every target with every family, strength and offset: the short lists become arrays that are
    exploded beside each target, so the product is made without a join."""
    kinds = F.array(*(F.struct(F.lit(k).alias("fam"), F.lit(v).alias("nominal")) for k, v in families.items()))
    rows = targets.select("target_id", F.explode(kinds).alias("k")).select("target_id", "k.*").withColumn("strength", F.explode(F.array(*map(F.lit, strengths)))).withColumn("offset_nm", F.explode(F.array(*map(F.lit, offsets))))
    named = F.concat_ws("_", sanitise(F.col("target_id")), "fam", F.col("strength").cast("string"))
    return rows.select(named.alias("injection_id"), "target_id", "fam", "strength", (F.col("nominal") + F.col("offset_nm")).alias("line_nm"), "offset_nm")


def duplicate_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, or an error that names the first keys that repeat."""
    found = duplicate_groups(rows, *keys).orderBy(*keys).limit(5).collect()
    if found:
        raise ValueError(f"repeated {', '.join(keys)}: {[tuple(r)[:-1] for r in found]}")
    return rows


def batches(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows in batches of ``size`` in a total order, numbered from 0; ranges are numbered apart."""
    return windows.ranked(rows, order, "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def proportional_split(devices: DataFrame, key: str, rate: str, total: int) -> DataFrame:
    """``total`` shared by rate in whole numbers: everyone's floor, then one more for the largest
    remainders (ties by key). As many rows as devices, a short list, so they meet in one place."""
    every = Window.partitionBy()
    want = F.lit(float(total)) * F.col(rate) / F.sum(rate).over(every)
    w = devices.withColumn("_want", want).withColumn("_base", F.floor("_want"))
    place = F.row_number().over(Window.partitionBy().orderBy((F.col("_want") - F.col("_base")).desc(), key))
    w = w.withColumns({"_place": place, "_rest": F.lit(total) - F.sum("_base").over(every)})
    return w.select(key, (F.col("_base") + (F.col("_place") <= F.col("_rest")).cast("long")).cast("long").alias("share"))


def timing_summary(trials: DataFrame, device: str, config: str, seconds: str, work: str) -> DataFrame:
    """Median and shortest time and the best rate of each configuration, with its device's best one."""
    c = trials.groupBy(device, config).agg(F.median(seconds).alias("median_sec"), F.min(seconds).alias("min_sec"), F.max(ratio(F.col(work), F.col(seconds))).alias("best_rate"))
    best = c.groupBy(device).agg(F.max_by(F.col(config), F.struct(F.coalesce("best_rate", F.lit(-1.0)), config)).alias("_best"))
    return c.join(best, device).withColumn("is_best", F.col(config) == F.col("_best")).drop("_best")


def magnitude_bins(text: Column) -> Column:
    """``name:low:high:n`` items of a comma list as structs; an item that isn't one is left out."""
    parts = F.transform(F.split(text, ","), lambda x: F.split(F.trim(x), ":"))
    whole = F.filter(parts, lambda p: (F.size(p) == 4) & (F.trim(p[0]) != "") & p[1].try_cast("double").isNotNull() & p[2].try_cast("double").isNotNull() & p[3].try_cast("int").isNotNull())
    return F.transform(whole, lambda p: F.struct(F.trim(p[0]).alias("name"), p[1].try_cast("double").alias("g_min"), p[2].try_cast("double").alias("g_max"), p[3].try_cast("int").alias("n")))


def in_bins(rows: DataFrame, magnitude: str, bins: Column) -> DataFrame:
    """Rows of the bins that hold their magnitude, lower end included; one row for each such bin."""
    at = F.filter(bins, lambda b: (F.col(magnitude) >= b["g_min"]) & (F.col(magnitude) < b["g_max"]))
    return rows.withColumn("bin", F.explode(at))


def model_runs(status: DataFrame, cards: DataFrame, text: str = "", limit: int = 80) -> DataFrame:
    """Training runs, newest first: what their status says, else their model card; empty texts and
    zero counts count as unsaid. Runs that contain a text in name, type, dataset, version or status;
    10 to 200 of them."""
    s, c = status.alias("s"), cards.alias("c")
    said = lambda v: F.nullif(F.col(v), F.lit(""))
    number = lambda v: F.nullif(F.col(v), F.lit(0))
    folder = F.regexp_extract(F.coalesce(F.col("c.dataset_dir"), F.lit("")), "([^/]*)/?$", 1)
    rows = s.join(c, F.col("s.run_name") == F.col("c.run_name"), "full").select(
        F.coalesce("s.run_name", "c.run_name").alias("run_name"), F.coalesce("s.mtime", "c.mtime").alias("mtime"), F.coalesce(said("s.status"), F.lit("unknown")).alias("status"), F.coalesce(said("s.model_type"), said("c.model_type")).alias("model_type"),
        F.coalesce(said("s.dataset_name"), F.nullif(folder, F.lit(""))).alias("dataset_name"), F.coalesce(said("s.model_version"), said("c.model_version")).alias("model_version"), F.coalesce(number("s.examples"), number("c.example_count")).alias("examples"),
    )
    hay = F.lower(F.concat_ws(" ", "run_name", "model_type", "dataset_name", "model_version", "status"))
    found = rows.where(F.contains(hay, F.lit(text.lower()))) if text else rows
    return found.orderBy(F.col("mtime").desc_nulls_last(), "run_name").limit(min(200, max(10, limit)))


def run_catalog(listing: DataFrame, summaries: dict[str, DataFrame], now: Column, active_seconds: float = 900.0) -> DataFrame:
    """Runs of a listing (run_name, mtime), newest first, with the fields of each summary under its
    name, and whether the run was written to lately. Names that could leave the run's folder are
    left out."""
    safe = F.col("run_name").rlike("^[A-Za-z0-9_.+-]+$") & ~F.col("run_name").isin(".", "..")
    rows = listing.where(safe)
    for name, summary in summaries.items():
        fields = [c for c in summary.columns if c != "run_name"]
        rows = rows.join(summary.select("run_name", *(F.col(c).alias(f"{name}_{c}") for c in fields)), "run_name", "left")
    age = now.cast("double") - F.col("mtime").cast("double")
    return rows.withColumn("is_active", F.coalesce(age < active_seconds, F.lit(False))).orderBy(F.col("mtime").desc(), "run_name")


def tile_targets(sources: DataFrame, tile: Column, nside: int, most: int, batch: int, magnitude: str = "phot_g_mean_mag") -> DataFrame:
    """Canonical targets of each tile: its ``most`` brightest sources in batches of ``batch``, with
    the tile's id. Places within a tile are numbered in slices of magnitude, so a crowded tile
    isn't one task."""
    placed = windows.numbered(sources.where(F.col(magnitude).isNotNull()).withColumn("hpx", tile), ["hpx"], magnitude, 0.25, [F.col(magnitude), F.col("source_id")], "place").where(F.col("place") < most)
    name = F.format_string(f"hpx_nside{nside:04d}_nested_%08d", "hpx")
    return placed.select(name.alias("tile_id"), "hpx", "place", F.floor(F.col("place") / batch).alias("batch_index"), F.concat(F.lit("star_"), F.col("source_id").cast("string")).alias("target_id"), "source_id", "ra", "dec", magnitude)


def tile_summaries(targets: DataFrame, magnitude: str = "phot_g_mean_mag") -> DataFrame:
    """Targets, batches and brightest magnitude of each tile."""
    return targets.groupBy("tile_id", "hpx").agg(F.count(F.lit(1)).alias("target_count"), (F.max("batch_index") + 1).alias("batch_count"), F.min(magnitude).alias("brightest"))
