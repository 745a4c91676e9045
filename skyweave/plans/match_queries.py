"""Joins and matching: pairs, bands, truth against candidates, one-to-one matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators import bands, candidates, spectra, windows
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query
from skyweave.plans.scan_queries import _DIGITS, CLUSTERS, PLAN_GRID, _plan_lines, _points, _rounded, _scores, scan_sql
from skyweave.session import stored

FIRST = "row_number() over (partition by target_id, image_id order by cwave_um, detector, aperture_flux_uJy, psf_flux_uJy)"


@query(
    "j1_paired_delta",
    f"""with one as (select *, {FIRST} as k from spectra_points), b as (select * from one where k = 1),
i as (select target_id, image_id, cwave_um, aperture_flux_uJy + 100e0*exp(-0.5e0*pow((cwave_um - 1.55e0)/0.02e0, 2)) as f, aperture_flux_unc_uJy as u, fatal_flag_present as g from b)
select b.target_id, b.image_id, round(i.cwave_um, 9) as cwave_um, round(i.f - b.aperture_flux_uJy, 6) as delta_flux, round(sqrt(u*u + aperture_flux_unc_uJy*aperture_flux_unc_uJy), 6) as delta_unc, (g or fatal_flag_present) as fatal_flag_present from i join b on i.target_id = b.target_id and i.image_id = b.image_id""",
)
def paired_delta(t: Tables) -> DataFrame:
    bump = 100.0 * F.exp(-0.5 * F.pow((F.col("cwave_um") - 1.55) / 0.02, 2))
    out = spectra.paired_delta(t.points.withColumn("aperture_flux_uJy", F.col("aperture_flux_uJy") + bump), t.points)
    return out.select("target_id", "image_id", F.round("cwave_um", 9).alias("cwave_um"), F.round("delta_flux", 6).alias("delta_flux"), F.round("delta_unc", 6).alias("delta_unc"), "fatal_flag_present")


def _bumped_delta(t: Tables) -> DataFrame:
    bump = 1e4 * F.exp(-0.5 * F.pow((F.col("cwave_um") - 1.55) / 0.02, 2))
    return spectra.paired_delta(t.points.withColumn("aperture_flux_uJy", F.col("aperture_flux_uJy") + bump), t.points)


def _paired_sql(grid: str, **limits: int) -> str:
    """The scan over flux differences of the first rows of each (target, image)."""
    whole = scan_sql(grid=grid, **limits)
    start, end = whole.index("base as ("), whole.index("whole as (")
    bump = "1e4*exp(-0.5e0*pow((cwave_um - 1.55e0)/0.02e0, 2))"
    base = f"one as (select *, {FIRST} as k from spectra_points), pairs as (select target_id, cwave_um, cband_um, (aperture_flux_uJy + {bump}) - aperture_flux_uJy as f, sqrt(aperture_flux_unc_uJy*aperture_flux_unc_uJy + aperture_flux_unc_uJy*aperture_flux_unc_uJy) as u, fatal_flag_present from one where k = 1), base as (select target_id, cwave_um, cband_um, f, u from pairs where not coalesce(fatal_flag_present, false)),\n"
    return whole[:start] + base + whole[end:] + "select target_id, line_nm, round(amp, 3) + 0e0 as amp, round(amp_unc, 6) as amp_unc, round(snr, 5) + 0e0 as snr, round(continuum, 6) + 0e0 as continuum, cast(support as bigint) as support from scores"


def _unsigned(scores: DataFrame) -> DataFrame:
    """Rounded scores without negative zeros."""
    return _rounded(scores, _DIGITS).withColumns({c: F.col(c) + 0.0 for c in ("amp", "snr", "continuum")})


@query("f3_paired_scan", _paired_sql("grid as (select 1400e0 + 25e0*i as line_nm from range(13) t(i))"))
def paired_scan(t: Tables) -> DataFrame:
    return _unsigned(bands.scan(_bumped_delta(t), bands.line_grid(t.spark, 1400.0, 1700.0, 25.0), "delta_flux", "delta_unc"))


@query("f3_plan_lines", _paired_sql(PLAN_GRID, least_support=1))
def paired_plan_lines(t: Tables) -> DataFrame:
    """The paired scan at the plan's distinct lines."""
    return _unsigned(bands.scan(_bumped_delta(t), _plan_lines(t), "delta_flux", "delta_unc", least_support=1))


MATCH = scan_sql() + ", m as (select t.injection_id, t.target_id, t.injected_line_nm, s.line_nm, round(s.snr, 5) as snr, row_number() over (partition by t.injection_id order by s.snr desc, s.line_nm) as k from injection_truth t left join scores s on s.target_id = t.target_id and abs(s.line_nm - t.injected_line_nm) <= 40e0 and s.snr >= 5e0) select injection_id, target_id, injected_line_nm, line_nm, snr, line_nm is not null as recovered from m where k = 1"


@query("j3_recovery_best_match", MATCH)
def recovery(t: Tables) -> DataFrame:
    hits = _scores(t).where("snr >= 5").select("target_id", "line_nm", F.round("snr", 5).alias("snr"))
    best = bands.best_match(t.truth, hits, ["target_id"], "injected_line_nm", "line_nm", 40.0, "injection_id", [F.col("snr").desc_nulls_last(), F.col("line_nm")])
    return best.select("injection_id", "target_id", "injected_line_nm", "line_nm", "snr", F.col("line_nm").isNotNull().alias("recovered"))


@query("j4_blind_recovery", scan_sql() + CLUSTERS + ", c as (select target_id, max(case when k = 1 then line_nm end) as peak, max(snr) as top, count(*) >= 3 as pass from best group by target_id, cluster_index), m as (select t.injection_id, c.peak, round(c.top, 5) as top, c.pass, row_number() over (partition by t.injection_id order by c.pass desc, c.top desc, c.peak) as k from injection_truth t join c on c.target_id = t.target_id and abs(c.peak - t.injected_line_nm) <= 60e0) select injection_id, peak as line_nm, top as score, pass as quality_pass from m where k = 1")
def blind_recovery(t: Tables) -> DataFrame:
    clusters = windows.gap_clusters(_scores(t).where("snr >= 5"), ["target_id"], "line_nm", 30.0, "snr")
    clusters = clusters.select("target_id", F.col("peak_x").alias("line_nm"), F.round("peak_score", 5).alias("score"), (F.col("score_count") >= 3).alias("quality_pass"))
    best = bands.best_match(t.truth, clusters, ["target_id"], "injected_line_nm", "line_nm", 60.0, "injection_id", [F.col("quality_pass").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("line_nm")])
    return best.where("line_nm is not null").select("injection_id", "line_nm", "score", "quality_pass")


@query("j5_any_quality_match", scan_sql() + "select t.injection_id, count(s.line_nm) as matches, coalesce(bool_or(s.snr >= 100e0), false) as any_quality from injection_truth t left join scores s on s.target_id = t.target_id and abs(s.line_nm - t.injected_line_nm) <= 40e0 and s.snr >= 5e0 group by 1")
def any_quality(t: Tables) -> DataFrame:
    hits = _scores(t).where("snr >= 5").select("target_id", "line_nm", "snr")
    near = bands.band_join(t.truth, hits, ["target_id"], "injected_line_nm", "line_nm", 40.0, "left")
    return near.groupBy("injection_id").agg(F.count("line_nm").alias("matches"), F.coalesce(F.bool_or(F.col("snr") >= 100.0), F.lit(False)).alias("any_quality"))


@query("j6_false_positives", scan_sql() + "select s.target_id, s.line_nm from scores s where s.snr >= 5e0 and not exists (select 1 from injection_truth t where t.target_id = s.target_id and abs(t.injected_line_nm - s.line_nm) <= 40e0)")
def false_positives(t: Tables) -> DataFrame:
    hits = stored(_scores(t).where("snr >= 5").select("target_id", "line_nm"), "hits")  # both sides of the join
    matched = bands.band_join(hits, t.truth.select("target_id", "injected_line_nm"), ["target_id"], "line_nm", "injected_line_nm", 40.0).select("target_id", "line_nm")
    return hits.join(matched, ["target_id", "line_nm"], "left_anti")


def line_clusters(t: Tables, kind: str, step_nm: float, gap_nm: float, least_snr: float = 5.0) -> DataFrame:
    """Clusters of one flux's hits with the sources of their lines; both sides of the matching read them twice."""
    hits = bands.scan(_points(t, kind), bands.line_grid(t.spark, 750.0, 5000.0, step_nm), least_snr=least_snr, sources=("detector", "image_id"), deal="either")
    return stored(candidates.line_clusters(bands.dealt(hits, t.points), kind, gap_nm), f"clusters-{kind}")


@query("j7_greedy_match")
def greedy(t: Tables) -> DataFrame:
    return candidates.joint_candidates(*(line_clusters(t, kind, 25.0, 30.0) for kind in ("aperture", "psf")), 30.0)


@query("x28_configured_quality")
def configured(t: Tables) -> DataFrame:
    return candidates.configured_quality(greedy(t)).select("joint_candidate_id", "tier", "rank_score", "quality_score", "quality_category", "reject_reasons")


@query("x25_review_grades")
def grades(t: Tables) -> DataFrame:
    from skyweave.functions.numeric import p_global

    cells = stored(bands.dual_scan(t.points, bands.line_grid(t.spark, 750.0, 5000.0, 25.0)), "cells")
    peaks = windows.nms_topk(cells.select("target_id", F.round((F.col("line_nm") - 750) / 25).cast("long").alias("i"), "q"), ["target_id"], "i", "q", 3, 4).withColumn("line_nm", F.col("i") * 25.0 + 750.0)
    found = peaks.drop("q").join(cells, ["target_id", "line_nm"]).withColumn("p_global", p_global(F.col("q"), F.lit(5.0), F.lit(4.0))).withColumn("tier", F.when(F.col("p_global") <= 0.01, "science_pass").otherwise("raw")).withColumn("flagged_points_sum", F.lit(0))
    return candidates.review_grades(found).select("target_id", "line_nm", "review_grade", "reject_reasons")


@query("j9_points_by_line", "with g as (select 750e0 + 250e0*i as line_nm from range(18) t(i)) select g.line_nm, count(*) as n, count(distinct target_id) as targets from spectra_points p join g on abs(p.cwave_um - g.line_nm/1000e0) <= 0.18e0 group by 1")
def points_by_line(t: Tables) -> DataFrame:
    return bands.windowed_points(t.points, bands.line_grid(t.spark, 750.0, 5000.0, 250.0), 0.18).groupBy("line_nm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_id").alias("targets"))


@query("j10_annotate_near_false_positive", "select t.injection_id, max(f.line_nm) as near_nm from injection_truth t left join (select 'src_' || cast(s_suppkey as string) as target_id, 800e0 + 10e0*(s_suppkey % 50) as line_nm from supplier) f on f.target_id = t.target_id and abs(f.line_nm - t.injected_line_nm) <= 100e0 group by 1")
def annotate(t: Tables) -> DataFrame:
    f = t.table("supplier").select(F.concat(F.lit("src_"), F.col("s_suppkey").cast("string")).alias("target_id"), (800.0 + 10.0 * (F.col("s_suppkey") % 50)).alias("line_nm"))
    return bands.band_join(t.truth, f, ["target_id"], "injected_line_nm", "line_nm", 100.0, "left").groupBy("injection_id").agg(F.max("line_nm").alias("near_nm"))


@query("j17_candidate_enrichment", "with c as (select 'src_' || cast(s_suppkey as string) as target_id, 1.0e0 + 0.1e0*(s_suppkey % 20) as line_um from supplier) select c.target_id, count(distinct p.observation_id) as n_visits, count_if(p.fatal_flag_present) as flagged, array_to_string(list_sort(list(distinct cast(p.detector as varchar))), ',') as detectors from c join spectra_points p on p.target_id = c.target_id and abs(p.cwave_um - c.line_um) <= 0.05e0 group by 1")
def enrichment(t: Tables) -> DataFrame:
    c = t.table("supplier").select(F.concat(F.lit("src_"), F.col("s_suppkey").cast("string")).alias("target_id"), (1.0 + 0.1 * (F.col("s_suppkey") % 20)).alias("line_um"))
    near = bands.band_join(c, t.points, ["target_id"], "line_um", "cwave_um", 0.05)
    return near.groupBy("target_id").agg(F.count_distinct("observation_id").alias("n_visits"), F.count_if("fatal_flag_present").alias("flagged"), F.array_join(F.array_sort(F.collect_set(F.col("detector").cast("string"))), ",").alias("detectors"))


@query("j18_path_override", "select distinct image_id, case image_id when 'img_1' then 'img_x' when 'img_2' then 'img_y' else image_id end as path from spectra_points")
def override(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("img_1"), F.lit("img_x"), F.lit("img_2"), F.lit("img_y"))
    return t.points.select("image_id", F.coalesce(F.try_element_at(m, F.col("image_id")), F.col("image_id")).alias("path")).distinct()


@query("j8_point_in_region", "select f.frame_id, count(*) as n, round(min(c.phot_g_mean_mag), 9) as brightest from frames f join catalog_sources c on c.dec between f.dec_low and f.dec_high and case when f.ra_high > 360e0 then (c.ra >= f.ra_low or c.ra <= f.ra_high - 360e0) else c.ra between f.ra_low and f.ra_high end group by 1")
def point_in_region(t: Tables) -> DataFrame:
    """Frames by catalog: both sides name coarse sky cells, an equi-join on the cell, then the
    exact box."""
    from skyweave.functions.sky import in_box

    cell = 10.0
    c = t.catalog.withColumn("_ra", F.floor(F.pmod("ra", F.lit(360.0)) / cell)).withColumn("_dec", F.floor((F.col("dec") + 90.0) / cell))
    f = t.view("frames")
    f = f.withColumn("_ra", F.explode(F.sequence(F.floor(F.col("ra_low") / cell), F.floor(F.col("ra_high") / cell)))).withColumn("_ra", F.pmod("_ra", F.lit(int(360 / cell))))
    f = f.withColumn("_dec", F.explode(F.sequence(F.floor((F.col("dec_low") + 90.0) / cell), F.floor((F.col("dec_high") + 90.0) / cell))))
    hit = f.dropDuplicates(["frame_id", "_ra", "_dec"]).join(c, ["_ra", "_dec"]).where(in_box(F.col("ra"), F.col("dec"), F.col("ra_low"), F.col("ra_high"), F.col("dec_low"), F.col("dec_high")))
    return hit.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("phot_g_mean_mag"), 9).alias("brightest"))


@query("s5_frame_footprint", "with m as (select f.frame_id, c.source_id, row_number() over (partition by f.frame_id order by c.phot_g_mean_mag, c.source_id) as k from frames f join catalog_sources c on c.dec between f.dec_low and f.dec_high and case when f.ra_high > 360e0 then (c.ra >= f.ra_low or c.ra <= f.ra_high - 360e0) else c.ra between f.ra_low and f.ra_high end) select frame_id, source_id, cast(k as bigint) as place from m where k <= 20")
def frame_footprint(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    from skyweave.functions.sky import in_box

    cell = 10.0
    c = t.catalog.select("source_id", "ra", "dec", "phot_g_mean_mag", F.floor(F.pmod("ra", F.lit(360.0)) / cell).alias("_ra"), F.floor((F.col("dec") + 90.0) / cell).alias("_dec"))
    f = t.view("frames").withColumn("_ra", F.explode(F.sequence(F.floor(F.col("ra_low") / cell), F.floor(F.col("ra_high") / cell)))).withColumn("_ra", F.pmod("_ra", F.lit(int(360 / cell))))
    f = f.withColumn("_dec", F.explode(F.sequence(F.floor((F.col("dec_low") + 90.0) / cell), F.floor((F.col("dec_high") + 90.0) / cell)))).dropDuplicates(["frame_id", "_ra", "_dec"])
    hit = f.join(c, ["_ra", "_dec"]).where(in_box(F.col("ra"), F.col("dec"), F.col("ra_low"), F.col("ra_high"), F.col("dec_low"), F.col("dec_high")))
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("phot_g_mean_mag", "source_id"))
    return hit.withColumn("place", place.cast("long")).where("place <= 20").select("frame_id", "source_id", "place")
