"""Training tables from many survey runs: one plan over runs of different schemas, and tensor shards."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.strings import data_split
from skyweave.operators import ml, windows
from skyweave.operators.spectra import spectrum_quality
from skyweave.schemas import require_columns

#: Columns of the points that enter a dataset; what a run lacks is null, what it has besides goes.
POINT_COLUMNS = {
    "target_id": "string", "source_id": "string", "image_id": "string", "observation_id": "long", "detector": "int", "cwave_um": "double", "cband_um": "double", "aperture_flux_uJy": "double", "aperture_flux_unc_uJy": "double",
    "psf_flux_uJy": "double", "psf_flux_unc_uJy": "double", "fatal_flag_present": "boolean", "flags_summary": "long", "phot_g_mean_mag": "double", "path_override_applied": "boolean", "input_file_path": "string",
    "original_input_file_path": "string", "point_injection_applied": "boolean",
}
#: Points below which a series is no example; rows of a shard.
LEAST_POINTS, SHARD_ROWS = 8, 512
#: Bits that mark the targets of a dataset by their hash.
MARK_BITS = 1 << 23
#: Hexadecimal digits of the hash that deal examples into numbered groups.
_GROUP_DIGITS = 3


def run_kind(name: Column) -> Column:
    return F.when(name.contains("injected"), "injected").when(name.contains("baseline"), "baseline").otherwise("unknown")


def conform(df: DataFrame, run: str | None = None) -> DataFrame:
    """A run's points in the declared columns and types, with run_name, run_kind and whether a
    point was injected: as its column says, else by a path override or a changed input path."""
    require_columns(df, "target_id", "cwave_um", *(() if run else ("run_name",)))
    have = set(df.columns)
    cols = [(F.col(c).try_cast(kind) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in POINT_COLUMNS.items()]
    name = F.coalesce(F.col("run_name"), F.lit(run)) if "run_name" in have else F.lit(run)
    out = df.select(*cols, name.alias("run_name"))
    original = F.coalesce("original_input_file_path", F.lit(""))
    changed = (original != "") & (F.coalesce("input_file_path", F.lit("")) != original)
    applied = F.coalesce("point_injection_applied", F.coalesce("path_override_applied", F.lit(False)) | changed)
    return out.withColumns({"point_injection_applied": applied, "run_kind": run_kind(F.col("run_name"))}).drop("path_override_applied", "input_file_path", "original_input_file_path")


def all_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """The points of all runs in one table."""
    return functools.reduce(DataFrame.unionByName, [conform(df, name) for name, df in runs.items()])


def example_key(run: str = "run_name", target: str = "target_id") -> Column:
    return F.concat(F.coalesce(F.col(run), F.lit("")), F.lit("::"), F.coalesce(F.col(target), F.lit("")))


def quality_of(points: DataFrame) -> DataFrame:
    """Quality of every (run, target) series, to nine decimals, so that equal series rank alike."""
    q = spectrum_quality(points, "run_name")
    return q.select("run_name", "target_id", "category", F.round("score", 9).alias("quality_score"), "n_usable")


def target_table(points: DataFrame, truth: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row a (run, target): counts, range, the first source id and magnitude along the series,
    its injections, and its quality."""
    keys = ["run_name", "target_id"]
    along = F.struct(F.col("cwave_um").isNull(), "cwave_um", "image_id", "detector")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), along)).alias(c)
    # a number is the first key: the rows of an aggregate over names are sorted, and runs share their first letters
    targets = points.groupBy(F.xxhash64("target_id", "run_name").alias("_hash"), *keys).agg(
        F.first("run_kind").alias("run_kind"), F.count(F.lit(1)).alias("n_points"), F.count_if("point_injection_applied").alias("injected_points"), F.min("cwave_um").alias("wavelength_min_um"),
        F.max("cwave_um").alias("wavelength_max_um"), first("source_id"), first("phot_g_mean_mag"),
    ).drop("_hash")
    lines = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("injection_count"), F.min("injected_line_nm").alias("line_min_nm"), F.max("injected_line_nm").alias("line_max_nm"), F.max("find_me_snr").alias("max_find_me_snr"))
    joined = targets.join(quality_of(points) if quality is None else quality, keys, "left").join(lines, keys, "left").fillna(0, ["injection_count"])
    return joined.withColumn("is_injected_target", F.col("injection_count") > 0)


def capped_targets(targets: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """All injected targets of a run, and the best others up to ``most``. A run is first cut to its
    candidates in ``salts`` pieces, so that no task meets all targets of a large one."""
    best = [F.col("quality_score").desc_nulls_last(), F.col("n_usable").desc_nulls_last(), F.col("target_id")]
    piece = F.pmod(F.xxhash64("target_id"), F.lit(salts))
    trimmed = windows.capped(targets.withColumn("_piece", piece), ["run_name", "_piece"], F.col("is_injected_target"), best, most).drop("_piece")
    return windows.capped(trimmed, ["run_name"], F.col("is_injected_target"), best, most)


def select_targets(points: DataFrame, truth: DataFrame, categories: Sequence[str] = (), most: int | None = None, exclude_injected: bool = False, quality: DataFrame | None = None) -> DataFrame:
    """Targets of a dataset over all runs: of the wanted quality categories (all if none is named)
    and, on request, without injections; at most ``most`` a run beside the injected ones. A
    target's split is that of its source, or of its id where no source is named, so one source is
    on one side in every run. ``quality`` is that of ``quality_of``, if it has been stored."""
    targets = target_table(points, truth, quality)
    if categories:
        targets = targets.where(F.col("category").isin(*categories))
    if exclude_injected:
        targets = targets.where(~F.col("is_injected_target"))
    if most is not None:
        targets = capped_targets(targets, most)
    return targets.withColumn("split_id", data_split(F.coalesce("source_id", "target_id")))


def near_targets(points: DataFrame, targets: DataFrame) -> DataFrame:
    """All points of the targets, and few others: a target sets one of MARK_BITS bits by its hash, and
    a point stays if its bit is set. The marks go out in words of 64 bits, as many rows at most
    as there are words, so that the points of other targets aren't shuffled."""
    at = F.pmod(F.xxhash64("run_name", "target_id"), F.lit(MARK_BITS))
    placed = {"_word": F.shiftright(at, 6), "_bit": F.expr("shiftleft(1L, cast(_at % 64 as int))")}
    marks = targets.withColumn("_at", at).withColumns(placed).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = points.withColumn("_at", at).withColumns(placed).join(F.broadcast(marks), "_word")
    return held.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*points.columns)


def select_points(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points of the targets with split, injection mark and place along their series. ``targets``
    is read twice and should be a stored table."""
    marks = targets.select(F.col("run_name").alias("_run"), F.col("target_id").alias("_target"), "split_id", "is_injected_target")
    chosen = near_targets(points, targets).join(marks, F.col("run_name").eqNullSafe(F.col("_run")) & F.col("target_id").eqNullSafe(F.col("_target"))).drop("_run", "_target")
    order = [F.col(c) for c in ("cwave_um", "image_id", "detector", "aperture_flux_uJy", "psf_flux_uJy")]
    return windows.numbered(chosen, ["run_name", "target_id"], "cwave_um", 0.05, order, "point_index")


def line_truth(truth: DataFrame, low_nm: float, high_nm: float) -> DataFrame:
    """Median injected line of every (run, target) within the range."""
    return truth.where(F.col("injected_line_nm").between(low_nm, high_nm)).groupBy("run_name", "target_id").agg(F.median("injected_line_nm").alias("line_nm"))


def placed(examples: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """Adds shard and shard_row within a split: every shard but the last has ``rows`` examples. The
    order is that of a hash of the example's key, so shards are shuffled and do not depend on how
    the table is partitioned. Examples are numbered in groups of equal first hash digits; only the
    groups' counts, as many as there are digits, meet in one place."""
    hashed = examples.withColumn("_hash", F.sha1(example_key().cast("binary")))
    ranked = windows.numbered_groups(hashed, ["split_id"], F.substring("_hash", 1, _GROUP_DIGITS), [F.col("_hash"), F.col("run_name"), F.col("target_id")], "_rank")
    return ranked.withColumns({"shard": F.floor(F.col("_rank") / rows), "shard_row": F.col("_rank") % rows}).drop("_hash", "_rank")


def tensor_shards(points: DataFrame, truth: DataFrame, max_points: int = 384, low_nm: float = 700.0, high_nm: float = 5000.0, rows: int = SHARD_ROWS) -> DataFrame:
    """One row an example: run, target, split, shard, shard_row, x (max_points x features, zeros
    after the series), mask, y (has a line) and line_norm (its place in the range, 0 without).
    ``points`` come from ``select_points``. Series of fewer than LEAST_POINTS points are no examples."""
    keys = ["run_name", "target_id"]
    keyed = points.withColumns({"_run": F.col("run_name"), "_target": F.col("target_id"), "target_id": example_key()})
    features = ml.point_features(keyed, "_run", "_target", "split_id", "point_index")
    used = features.where(F.col("point_index") < max_points)  # no series is collected beyond its tensor
    series = used.groupBy(F.col("_run").alias("run_name"), F.col("_target").alias("target_id"), "split_id").agg(F.sort_array(F.collect_list(F.struct("point_index", "features"))).alias("s"))
    examples = placed(series.where(F.size("s") >= LEAST_POINTS), rows).join(line_truth(truth, low_nm, high_nm), keys, "left")
    missing = F.lit(max_points) - F.size("s")
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), len(ml.FEATURES)), missing)
    span = max(high_nm - low_nm, 1.0)
    return examples.select(
        *keys, "split_id", "shard", "shard_row", F.concat(F.col("s.features"), zeros).alias("x"), F.concat(F.array_repeat(F.lit(True), F.size("s")), F.array_repeat(F.lit(False), missing)).alias("mask"),
        F.col("line_nm").isNotNull().cast("float").alias("y"), F.coalesce((F.col("line_nm") - low_nm) / span, F.lit(0.0)).cast("float").alias("line_norm"),
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """A folder for each split and shard, rows in order; a rewrite replaces the whole table."""
    shards.repartition("split_id", "shard").sortWithinPartitions("split_id", "shard", "shard_row").write.mode("overwrite").partitionBy("split_id", "shard").parquet(path)
