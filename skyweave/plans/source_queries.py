"""Readers and sinks on files that Spark writes from the tables: CSV, text, JSON, shards, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query
from skyweave.session import fresh_folder
from skyweave.sources import tables


@query("s8_csv_catalog", "select source_id, round(ra, 9) as ra, round(dec, 9) as dec, round(phot_g_mean_mag, 9) as phot_g_mean_mag, case when zone > 0 then round(pmra, 6) end as pmra from catalog_sources")
def csv_catalog(t: Tables) -> DataFrame:
    """The catalog through gzipped CSV, columns by name whatever their order, gaps as null."""
    path = fresh_folder(t.spark, "csv-catalog")
    columns = ["dec", "phot_g_mean_mag", "note", "pmra", "source_id", "ra"]
    t.catalog.withColumns({"note": F.lit("x"), "pmra": F.when(F.col("zone") > 0, F.col("pmra"))}).select(*columns).write.option("header", True).option("compression", "gzip").csv(path)
    got = tables.read_star_csv(t.spark, path, ["source_id", "ra", "dec", "phot_g_mean_mag", "pmra"])
    return got.select("source_id", *(F.round(c, 6 if c == "pmra" else 9).alias(c) for c in ("ra", "dec", "phot_g_mean_mag", "pmra")))


@query("s9_text_catalog", "select source_id as pts_key, round(ra, 9) as ra, round(dec, 9) as decl, case when zone % 2 = 0 then round(phot_g_mean_mag, 9) end as j_m from catalog_sources where zone <> 3")
def text_catalog(t: Tables) -> DataFrame:
    r"""Pipe-delimited gzipped text with ``\N`` for null; rows outside the sphere are left out."""
    path = fresh_folder(t.spark, "text-catalog")
    ra = F.when(F.col("zone") == 3, F.col("ra") + 360.0).otherwise(F.col("ra"))
    rows = t.catalog.select("source_id", ra.alias("ra"), "dec", F.when(F.col("zone") % 2 == 0, F.col("phot_g_mean_mag")).alias("j_m"))
    rows.write.option("sep", "|").option("nullValue", "\\N").option("compression", "gzip").csv(path)
    got = tables.read_point_source_text(t.spark, path, "pts_key long, ra double, dec double, j_m double")
    return got.select("pts_key", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("decl"), F.round("j_m", 9).alias("j_m"))


@query("s12_frame_paths", "select o_orderkey as k, case when o_orderkey % 4 = 3 then null else '2025W' || lpad(cast(10 + o_orderkey % 40 as varchar), 2, '0') || '_' || cast(1 + o_orderkey % 3 as varchar) || 'A' end as planning_period, case when o_orderkey % 4 in (0, 1) then 'l2b-v' || cast(o_orderkey % 9 as varchar) end as processing_version, case when o_orderkey % 4 = 0 then cast(1 + o_orderkey % 6 as int) end as detector_dir, case when o_orderkey % 4 in (0, 1) then lpad(cast(o_custkey as varchar), 4, '0') end as exposure_id, case when o_orderkey % 4 in (0, 1) then cast(o_orderkey % 5 as int) end as frame_in_exposure, case when o_orderkey % 4 <> 2 then cast(1 + o_orderkey % 6 as int) end as detector from orders")
def frame_paths(t: Tables) -> DataFrame:
    """Fields of frames' paths, of which some lack folders or have other names."""
    k, c = F.col("o_orderkey"), lambda v: v.cast("string")
    period = F.concat(F.lit("2025W"), F.lpad(c(10 + k % 40), 2, "0"), F.lit("_"), c(1 + k % 3), F.lit("A"))
    version, detector = F.concat(F.lit("l2b-v"), c(k % 9)), c(1 + k % 6)
    name = F.concat(F.lit("level2_"), period, F.lit("_"), F.lpad(c(F.col("o_custkey")), 4, "0"), F.lit("_"), c(k % 5), F.lit("D"), detector, F.lit("_spx_"), c(k), F.lit(".fits"))
    path = F.when(k % 4 == 0, F.concat(F.lit("/a/"), period, F.lit("/"), version, F.lit("/"), detector, F.lit("/"), name)).when(k % 4 == 1, F.concat(F.lit("/a/"), period, F.lit("/"), version, F.lit("/x/"), name))
    path = path.when(k % 4 == 2, F.concat(F.lit("/a/"), period, F.lit("/raw/frame.fits"))).otherwise(F.concat(F.lit("/b/cal_1D"), detector, F.lit("_x.fits")))
    rows = t.table("orders").select(k.alias("k"), path.alias("path"))
    return rows.select("k", *(v.alias(n) for n, v in tables.frame_path_fields(F.col("path")).items()))


@query("s16_fixed_targets", "select 'cust_' || cast(c_custkey as varchar) as target_id, 'fixed' as target_type, round(c_acctbal/100e0, 6) as ra_reference_deg, case when c_nationkey <> 4 then cast(c_nationkey as double) end as dec_reference_deg from customer")
def fixed_targets(t: Tables) -> DataFrame:
    """Fixed targets through Parquet: NaN is null, required columns are checked."""
    path = fresh_folder(t.spark, "targets")
    dec = F.when(F.col("c_nationkey") == 4, F.lit(float("nan"))).otherwise(F.col("c_nationkey").cast("double"))
    t.table("customer").select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("target_id"), F.lit("fixed").alias("target_type"), F.round(F.col("c_acctbal") / 100.0, 6).alias("ra_reference_deg"), dec.alias("dec_reference_deg")).write.parquet(path)
    return tables.read_targets(t.spark, path, "target_id", "target_type", "ra_reference_deg", "dec_reference_deg")


@query("s17_shard_collect", "select 'detector=' || cast(detector as varchar) as shard, count(*) as n, round(sum(aperture_flux_uJy), 3) as total from spectra_points group by 1")
def shard_collect(t: Tables) -> DataFrame:
    """All shards of a run in one table, each row with the shard that it came from."""
    path = fresh_folder(t.spark, "shards")
    t.points.select("target_id", "detector", "aperture_flux_uJy").write.partitionBy("detector").parquet(path)
    rows = tables.read_shards(t.spark, f"{path}/*/*.parquet")
    return rows.groupBy(F.regexp_extract("shard_path", r"(detector=\d+)/", 1).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("aperture_flux_uJy"), 3).alias("total"))


def _manifests(t: Tables) -> str:
    """Manifests of fifty injections at most, one JSON document a line; numbers as text here and
    there, missing counts, missing frames."""
    key = F.substr("target_id", F.lit(5)).cast("long")
    frame = lambda n: F.struct(F.when(key % 7 != n, (F.col("strength") * n * 10.0).cast("string")).alias("injected_flux_uJy"))
    i = F.struct(
        "injection_id", F.when(key % 11 != 0, F.col("target_id")).alias("target_id"), "line_family", F.col("injected_line_nm").alias("nominal_line_nm"), F.when(key % 5 == 0, F.lit("unknown")).otherwise(F.col("injected_line_nm").cast("string")).alias("injected_line_nm"),
        F.lit(0.5).alias("offset_nm"), F.lit("1.0").alias("line_width_nm"), F.lit("find_me").alias("strength_mode"), F.col("strength").alias("find_me_snr"), (F.col("strength") * 100.0).alias("line_flux_uJy"),
        F.when(key % 3 == 0, F.lit(None).cast("int")).otherwise(F.lit(3)).alias("frames_written"), F.lit("1").alias("frames_skipped"), F.when(key % 4 == 0, F.array().cast("array<struct<injected_flux_uJy:string>>")).otherwise(F.array(frame(1), frame(2))).alias("frames"),
    )
    plans = t.truth.withColumn("_plan", F.floor(key / 50)).groupBy("_plan").agg(F.collect_list(i).alias("injections"))
    path = fresh_folder(t.spark, "manifests")
    plans.select(F.to_json(F.struct("injections")).alias("value")).write.text(path)
    return path


_KEY = "cast(substr(target_id, 5) as bigint)"
_TEXTS = f"injection_id, case when {_KEY} % 11 <> 0 then target_id end as target_id, line_family"
_LINE = f"case when {_KEY} % 5 <> 0 then injected_line_nm end as injected_line_nm"
_FLUX = f"case when {_KEY} % 4 = 0 then 0e0 else greatest(case when {_KEY} % 7 <> 1 then strength*10e0 else 0e0 end, case when {_KEY} % 7 <> 2 then strength*20e0 else 0e0 end) end as max_frame_flux_uJy"
_COUNTS = f"case when {_KEY} % 3 = 0 then 0 else 3 end as frames_written"
_ALL = f"{_TEXTS}, 'find_me' as strength_mode, injected_line_nm as nominal_line_nm, {_LINE}, 0.5e0 as offset_nm, 1e0 as line_width_nm, strength as find_me_snr, strength*100e0 as line_flux_uJy, {_FLUX}, {_COUNTS}, 1 as frames_skipped"


@query("s19_manifest_recovery", f"select {_ALL} from injection_truth")
def manifest_recovery(t: Tables) -> DataFrame:
    return tables.read_manifest(t.spark, _manifests(t), "recovery", lines=True)


@query("s19_manifest_blind", f"select {_TEXTS}, {_LINE}, strength as find_me_snr, strength*100e0 as line_flux_uJy, {_FLUX}, {_COUNTS}, 1 as frames_skipped from injection_truth")
def manifest_blind(t: Tables) -> DataFrame:
    return tables.read_manifest(t.spark, _manifests(t), "blind", lines=True)


@query("s19_manifest_detector", f"select {_TEXTS}, {_LINE}, strength as find_me_snr, strength*100e0 as line_flux_uJy, {_COUNTS} from injection_truth")
def manifest_detector(t: Tables) -> DataFrame:
    return tables.read_manifest(t.spark, _manifests(t), "detector", lines=True)


@query("s19_manifest_dataset", f"select {_ALL} from injection_truth")
def manifest_dataset(t: Tables) -> DataFrame:
    return tables.read_manifest(t.spark, _manifests(t), "dataset", lines=True).drop("manifest_path")


@query("s20_jsonl_tail", "select event_id, image_id, event from status_events order by event_id desc limit 120")
def jsonl_tail(t: Tables) -> DataFrame:
    """The last events of a log of JSON lines that was appended to twice."""
    path = fresh_folder(t.spark, "events")
    for part in (0, 1):
        tables.append_events(t.events.where(F.col("event_id") % 2 == part), path)
    return tables.read_jsonl_tail(t.spark, path, 120, "event_id").select("event_id", "image_id", "event")


@query("s21_id_list", "select target_id, count(*) as n from spectra_points where cast(substr(target_id, 5) as bigint) % 3 = 0 group by 1")
def id_list(t: Tables) -> DataFrame:
    """Points of the targets in a text list with blanks, comments and repeats."""
    path = fresh_folder(t.spark, "ids")
    key = F.col("s_suppkey")
    line = F.when(key % 3 == 0, F.concat(F.lit("  src_"), key.cast("string"), F.lit(" "))).when(key % 3 == 1, F.concat(F.lit("# src_"), key.cast("string"))).otherwise("")
    lines = t.table("supplier").select(line.alias("value"))
    lines.union(lines).write.text(path)
    return tables.rows_of(t.points, tables.read_ids(t.spark, path), ["target_id"]).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("s23_build_manifest", "select count(*) as rows_ from catalog_sources")
def catalog_manifest(t: Tables) -> DataFrame:
    """Rows of a written catalog by its manifest."""
    from skyweave.plans.frame_queries import write_sky_catalog

    return tables.build_manifest(write_sky_catalog(t)).agg(F.sum("rows").alias("rows_"))


@query("s25_csv_summaries", "select target_id, count(*) as n, round(median(aperture_flux_uJy), 6) as median_flux from spectra_points group by 1")
def csv_summaries(t: Tables) -> DataFrame:
    path = fresh_folder(t.spark, "summaries")
    tables.write_csv(t.points.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("aperture_flux_uJy"), 6).alias("median_flux")), path)
    return t.spark.read.option("header", True).schema("target_id string, n long, median_flux double").csv(path)
