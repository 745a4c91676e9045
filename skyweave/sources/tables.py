"""Sources and sinks of survey tables: catalogs, manifests, lists, shards, partitioned writes."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.sky import cells_of_boxes, in_ra_range, sky_prefilter
from skyweave.schemas import INJECTION_PLAN, STAR_CATALOG, nan_to_null, require_columns
from skyweave.session import stored


def read_star_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV, gzipped or not, with ``#`` lines before the header: the columns wanted (all of the star
    catalog, unless named) by their names in the header, in the declared types; a header that lacks
    one is an error, a value of another type null."""
    kinds = dict(c.rsplit(" ", 1) for c in STAR_CATALOG.split(", "))
    wanted = list(columns or kinds)
    raw = spark.read.option("comment", "#").option("header", True).csv(path)
    return require_columns(raw, *wanted).select(*(F.col(c).try_cast(kinds[c]).alias(c) for c in wanted))


def read_point_source_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""Pipe-delimited text with ``\N`` for null; rows outside the sphere go."""
    df = spark.read.option("sep", "|").option("nullValue", "\\N").schema(schema).csv(path)
    return df.where((F.col("ra") >= 0) & (F.col("ra") < 360) & F.col("dec").between(-90, 90))


def write_catalog(df: DataFrame, path: str, level: int, rows_a_file: int = 2_500_000) -> None:
    """Cells as partitions, files of bounded size; rebalancing splits crowded cells."""
    df.withColumn("hpx_level", F.lit(level)).hint("rebalance", "hpx").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").partitionBy("hpx_level", "hpx").parquet(path)


def catalog_cone(catalog: DataFrame, polygon: list[tuple[float, float]], mag: str, low: float, high: float, limit: int, cell: str | None = None, level: int | None = None) -> DataFrame:
    """Brightest sources inside a polygon; the limit comes after the exact test."""
    inside = sky_prefilter(catalog.where(F.col(mag).between(low, high)), "ra", "dec", polygon, cell, level)
    return inside.orderBy(mag, "source_id").limit(limit)


def sources_of_footprints(catalog: DataFrame, frames: DataFrame, level: int, cell: str = "hpx") -> DataFrame:
    """Sources inside the boxes of many frames (frame_id, ra_low, ra_high, dec_low, dec_high).

    The frames' cells are stored, so that Spark knows their size: where they may be broadcast, they
    also prune the catalog's partitions at run time, else both sides are shuffled by cell. The
    exact box comes after. (Spark prunes only by a side with a filter, here one that all pass.)"""
    cells = stored(cells_of_boxes(frames, level, "frame_id").withColumnRenamed("hpx", "_cell").join(frames, "frame_id"), "cells").where("_cell >= 0")
    wide = F.col("ra_high") - F.col("ra_low") >= 360.0
    inside = F.col("dec").between(F.col("dec_low"), F.col("dec_high")) & (wide | in_ra_range(F.col("ra"), F.col("ra_low"), F.col("ra_high")))
    return catalog.join(cells, F.col(cell) == F.col("_cell")).where(inside).drop("_cell", "ra_low", "ra_high", "dec_low", "dec_high")


def shards_named(shards: DataFrame, campaign_prefix: str, source: str, source_prefix: str) -> DataFrame:
    """Shards of campaigns that begin so, of one source or of sources that begin so; both tests are
    on partition columns, so other shards are not even listed for reading."""
    return shards.where(F.col("campaign").startswith(campaign_prefix) & ((F.col("source") == source) | F.col("source").startswith(source_prefix)))


def cached_query(df: DataFrame, root: str, *arguments: object) -> DataFrame:
    """Read-through cache: every argument is part of the key."""
    spark = df.sparkSession
    path = f"{root}/{hashlib.sha256(json.dumps(arguments, sort_keys=True, default=str).encode()).hexdigest()}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_shards(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.parquet(glob).withColumn("shard_path", F.col("_metadata.file_path"))


def read_targets(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """Fixed targets from CSV or Parquet, required columns checked, NaN as null; no targets at all
    is an error."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    checked = nan_to_null(require_columns(df, *required))
    if checked.isEmpty():
        raise ValueError(f"no targets in {path}")
    return checked


def read_manual_targets(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written targets from a YAML file; required numbers are strict, optional ones may be
    empty. The file is a list that someone typed: it is read whole, through Spark."""
    import yaml

    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    optional = ("pmra_masyr", "pmdec_masyr", "parallax_mas")
    known = lambda v: float(v) if v not in (None, "") else None
    rows = [(str(r["target_id"]), float(r["ra_deg"]), float(r["dec_deg"]), *(known(r.get(k)) for k in optional), float(r.get("priority_score", 0.0)), str(r.get("notes", ""))) for r in (yaml.safe_load(text) or {}).get("targets", [])]
    return spark.createDataFrame(rows, "target_id string, ra_deg double, dec_deg double, pmra_masyr double, pmdec_masyr double, parallax_mas double, priority_score double, notes string")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("target_id"))
    return lines.where((F.col("target_id") != "") & ~F.startswith("target_id", F.lit("#"))).distinct()


def read_jsonl_tail(spark: SparkSession, path: str, n: int, order: str = "time") -> DataFrame:
    return spark.read.json(path).orderBy(F.col(order).desc()).limit(n)


def read_injections(spark: SparkSession, path: str) -> DataFrame:
    """One row an injection from nested plan or manifest JSON, with frame aggregates."""
    plan = spark.read.schema(INJECTION_PLAN).option("multiLine", True).json(path)
    i = plan.select("plan_id", F.explode("injections").alias("i")).select("plan_id", "i.*")
    written = F.filter("frames", lambda f: f["status"] == "written")
    return i.withColumn("max_response", F.array_max(F.transform("frames", lambda f: f["line_response"]))).withColumn("frames_written", F.coalesce(F.size(written), F.lit(0))).drop("frames")


def path_parts(path) -> dict:
    """Columns that a frame's file name holds."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return {
        "planning_period": F.regexp_extract(name, r"_(\d{4}W\d{2}_\d[AB])_", 1), "exposure_id": F.regexp_extract(name, r"_(\d{4})_\d+D", 1), "detector": F.regexp_extract(name, r"D(\d)_", 1).try_cast("int"),
        "processing_version": F.regexp_extract(name, r"_(l\d[a-z]-v\d+)", 1), "file_name": name,
    }


#: Fields of an injection in a manifest. Numbers may come as text, so all are read as text.
_MANIFEST = "injections array<struct<injection_id:string,target_id:string,line_family:string,nominal_line_nm:string,injected_line_nm:string,offset_nm:string,line_width_nm:string,strength_mode:string,find_me_snr:string,line_flux_uJy:string,frames_written:string,frames_skipped:string,frames:array<struct<injected_flux_uJy:string>>>>"
#: What each reader of manifests takes: text columns, numbers, counts (0 where they are missing).
MANIFEST_READERS = {
    "recovery": (("injection_id", "target_id", "line_family", "strength_mode"), ("nominal_line_nm", "injected_line_nm", "offset_nm", "line_width_nm", "find_me_snr", "line_flux_uJy", "max_frame_flux_uJy"), ("frames_written", "frames_skipped")),
    "blind": (("injection_id", "target_id", "line_family"), ("injected_line_nm", "find_me_snr", "line_flux_uJy", "max_frame_flux_uJy"), ("frames_written", "frames_skipped")),
    "detector": (("injection_id", "target_id", "line_family"), ("injected_line_nm", "find_me_snr", "line_flux_uJy"), ("frames_written",)),
    "dataset": (("injection_id", "target_id", "line_family", "strength_mode", "manifest_path"), ("nominal_line_nm", "injected_line_nm", "offset_nm", "line_width_nm", "find_me_snr", "line_flux_uJy", "max_frame_flux_uJy"), ("frames_written", "frames_skipped")),
}


def read_manifest(spark: SparkSession, path: str, reader: str, lines: bool = False) -> DataFrame:
    """One row an injection of manifest files (each one JSON document, or one a line), with the
    columns of a reader. What is no number is null, a missing count 0; the highest frame flux of an
    injection without frames is 0."""
    texts, numbers, counts = MANIFEST_READERS[reader]
    raw = spark.read.schema(_MANIFEST).option("multiLine", not lines).json(path)
    i = raw.select(F.explode("injections").alias("i"), F.col("_metadata.file_path").alias("manifest_path")).select("i.*", "manifest_path")
    flux = F.array_max(F.transform("frames", lambda f: F.coalesce(f["injected_flux_uJy"].try_cast("double"), F.lit(0.0))))
    i = i.withColumn("max_frame_flux_uJy", F.coalesce(flux, F.lit(0.0)).cast("string"))
    return i.select(*texts, *(F.col(c).try_cast("double").alias(c) for c in numbers), *(F.coalesce(F.col(c).try_cast("double").cast("long"), F.lit(0)).alias(c) for c in counts))


def frame_path_fields(path) -> dict:
    """Columns that a frame's folder and file name hold; null where they don't match."""
    known = lambda pattern, text, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    folder = r"/(\d{4}W\d{2}_[0-9A-Z]+)/(?:(l2b-[^/]+)/)?(?:(\d+)/)?"
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    own = r"^level2_(\d{4}W\d{2}_[0-9A-Z]+)_(\d+)_([0-9])D([1-6])_"
    return {
        "planning_period": F.coalesce(known(own, name, 1), known(folder, path, 1)), "processing_version": known(folder, path, 2), "detector_dir": known(folder, path, 3).cast("int"), "exposure_id": known(own, name, 2),
        "frame_in_exposure": known(own, name, 3).cast("int"), "detector": F.coalesce(known(own, name, 4), known(r"_1D([1-6])_", name, 1), known(r"D([1-6])", name, 1)).cast("int"),
    }


def list_files(spark: SparkSession, root: str, suffix: str = "*", limit: int | None = None) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path", "length", "modificationTime").orderBy("path")
    return df.limit(limit) if limit else df


def file_hashes(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path", F.sha2("content", 256).alias("sha256"))


def build_manifest(catalog: DataFrame, cell: str = "hpx") -> DataFrame:
    """What a written catalog holds: rows, files and bytes of every cell, from the files' metadata."""
    files = catalog.groupBy(cell, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy(cell).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))


def throughput(rows: int, seconds: float) -> dict:
    return {"rows": rows, "seconds": seconds, "rows_per_sec": rows / seconds if seconds > 0 else None}


def write_csv(df: DataFrame, path: str) -> None:
    """Summaries as CSV with a header in every part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_events(events: DataFrame, path: str) -> None:
    """Add events to a log of JSON lines."""
    events.write.mode("append").json(path)


def reset_events(spark: SparkSession, path: str) -> None:
    """Empty the log; readers find no events."""
    spark.createDataFrame([], "event string").write.mode("overwrite").json(path)


def magnitude_band(catalog: DataFrame, magnitude: str, low: float, high: float) -> DataFrame:
    """Sources of a magnitude range, both ends included; what is no number is out."""
    return catalog.where(F.col(magnitude).try_cast("double").between(low, high))


def union_all(named: dict[str, DataFrame], origin: str) -> DataFrame:
    """Tables of different columns in one, with the name of each row's table."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(origin, F.lit(name)) for name, df in named.items()))


def ids_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def ids_only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def enriched(rows: DataFrame, keys: list[str], more: DataFrame, zero: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the columns of ``more`` (one row a key), null where there is none but for the
    columns of ``zero``."""
    return rows.join(more, keys, "left").fillna(0, list(zero))


def rows_of(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key another table has."""
    return rows.join(kept.select(*keys), keys, "left_semi")


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Structs as columns named after their path, down to the last level; other columns as they are."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, ())))


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Columns named after the backend that made them, but for the keys."""
    return df.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys))


def backends(df: DataFrame, keys: Sequence[str], sides: dict[str, dict[str, Column]]) -> DataFrame:
    """What several backends made of the same rows side by side, named as by ``prefixed``."""
    return df.select(*keys, *(value.alias(f"{prefix}_{name}") for prefix, columns in sides.items() for name, value in columns.items()))
