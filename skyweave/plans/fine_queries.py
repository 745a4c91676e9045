"""Matching, recovery and grading of candidates on the fine grids: 5 nm for single fluxes with a
gap of 15 nm, 1 nm for both fluxes. Every query scans once: the hits are stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions.numeric import p_global
from skyweave.operators import bands, candidates, windows
from skyweave.plans.fixtures import Tables
from skyweave.plans.match_queries import MATCH, line_clusters
from skyweave.plans.registry import query
from skyweave.plans.scan_queries import _DIGITS, _OUT, CLUSTERS, GRID, GRID_5NM, _picks, _points, _rounded, _scores, _series, scan_sql
from skyweave.session import stored

GAP_NM, LEAST_SNR = 15.0, 5.0
CLUSTERS_5NM = CLUSTERS.replace("> 30e0", "> 15e0")


def _hits(t: Tables, kind: str = "aperture") -> DataFrame:
    """Lines with a score of at least LEAST_SNR, scanned once."""
    return stored(_scores(t, kind, 5.0).where(F.col("snr") >= LEAST_SNR), f"hits-{kind}")


def _grouped(t: Tables, hits: DataFrame) -> DataFrame:
    return windows.gap_clusters(bands.dealt(hits, t.points), ["target_id"], "line_nm", GAP_NM, "snr")


@query("f4_mean_continuum_scan_5nm", scan_sql(level="avg", grid=GRID_5NM) + _OUT)
def mean_scan(t: Tables) -> DataFrame:
    return _rounded(bands.scan(_points(t), bands.line_grid(t.spark, 750.0, 5000.0, 5.0), continuum="mean"), _DIGITS)


@query("j3_recovery_best_match_5nm", MATCH.replace(GRID, GRID_5NM))
def recovery(t: Tables) -> DataFrame:
    hits = _hits(t).select("target_id", "line_nm", F.round("snr", 5).alias("snr"))
    best = bands.best_match(t.truth, hits, ["target_id"], "injected_line_nm", "line_nm", 40.0, "injection_id", [F.col("snr").desc_nulls_last(), F.col("line_nm")])
    return best.select("injection_id", "target_id", "injected_line_nm", "line_nm", "snr", F.col("line_nm").isNotNull().alias("recovered"))


@query("j4_blind_recovery_5nm", scan_sql(grid=GRID_5NM) + CLUSTERS_5NM + ", c as (select target_id, max(case when k = 1 then line_nm end) as peak, max(snr) as top, count(*) >= 3 as pass from best group by target_id, cluster_index), m as (select t.injection_id, c.peak, round(c.top, 5) as top, c.pass, row_number() over (partition by t.injection_id order by c.pass desc, c.top desc, c.peak) as k from injection_truth t join c on c.target_id = t.target_id and abs(c.peak - t.injected_line_nm) <= 60e0) select injection_id, peak as line_nm, top as score, pass as quality_pass from m where k = 1")
def blind_recovery(t: Tables) -> DataFrame:
    clusters = _grouped(t, _hits(t)).select("target_id", F.col("peak_x").alias("line_nm"), F.round("peak_score", 5).alias("score"), (F.col("score_count") >= 3).alias("quality_pass"))
    best = bands.best_match(t.truth, clusters, ["target_id"], "injected_line_nm", "line_nm", 60.0, "injection_id", [F.col("quality_pass").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("line_nm")])
    return best.where("line_nm is not null").select("injection_id", "line_nm", "score", "quality_pass")


@query("j5_any_quality_match_5nm", scan_sql(grid=GRID_5NM) + "select t.injection_id, count(s.line_nm) as matches, coalesce(bool_or(s.snr >= 100e0), false) as any_quality from injection_truth t left join scores s on s.target_id = t.target_id and abs(s.line_nm - t.injected_line_nm) <= 40e0 and s.snr >= 5e0 group by 1")
def any_quality(t: Tables) -> DataFrame:
    near = bands.band_join(t.truth, _hits(t).select("target_id", "line_nm", "snr"), ["target_id"], "injected_line_nm", "line_nm", 40.0, "left")
    return near.groupBy("injection_id").agg(F.count("line_nm").alias("matches"), F.coalesce(F.bool_or(F.col("snr") >= 100.0), F.lit(False)).alias("any_quality"))


@query("j6_false_positives_5nm", scan_sql(grid=GRID_5NM) + "select s.target_id, s.line_nm from scores s where s.snr >= 5e0 and not exists (select 1 from injection_truth t where t.target_id = s.target_id and abs(t.injected_line_nm - s.line_nm) <= 40e0)")
def false_positives(t: Tables) -> DataFrame:
    hits = _hits(t).select("target_id", "line_nm")
    matched = bands.band_join(hits, t.truth.select("target_id", "injected_line_nm"), ["target_id"], "line_nm", "injected_line_nm", 40.0).select("target_id", "line_nm")
    return hits.join(matched, ["target_id", "line_nm"], "left_anti")


@query("j7_greedy_match_5nm")
def greedy(t: Tables) -> DataFrame:
    """Aperture and PSF clusters matched one to one within 30 nm."""
    return candidates.joint_candidates(*(line_clusters(t, kind, 5.0, GAP_NM, LEAST_SNR) for kind in ("aperture", "psf")), 30.0)


@query("v15_scan_driver_5nm", "select * from (" + scan_sql(grid=GRID_5NM) + CLUSTERS_5NM + "select target_id, cast(cluster_index as bigint) as cluster_index, max(case when k = 1 then line_nm end) as peak_x, round(max(snr), 5) as peak_score, min(line_nm) as min_x, max(line_nm) as max_x, count(*) as score_count, 'aperture' as flux_kind from best group by 1, 2) union all select * from (" + scan_sql("psf", grid=GRID_5NM) + CLUSTERS_5NM + "select target_id, cast(cluster_index as bigint) as cluster_index, max(case when k = 1 then line_nm end), round(max(snr), 5), min(line_nm), max(line_nm), count(*), 'psf' from best group by 1, 2)")
def scan_driver(t: Tables) -> DataFrame:
    """Scans of both fluxes on the fine grid and their clusters."""
    parts = [_grouped(t, _scores(t, kind, 5.0).where(F.col("snr") >= LEAST_SNR)).withColumn("flux_kind", F.lit(kind)) for kind in ("aperture", "psf")]
    return parts[0].unionByName(parts[1]).select("target_id", "cluster_index", "peak_x", F.round("peak_score", 5).alias("peak_score"), "min_x", "max_x", "score_count", "flux_kind")


@query("x28_configured_quality_5nm")
def configured(t: Tables) -> DataFrame:
    return candidates.configured_quality(greedy(t)).select("joint_candidate_id", "tier", "rank_score", "quality_score", "quality_category", "reject_reasons")


@query("x25_review_grades_1nm")
def grades(t: Tables) -> DataFrame:
    """Grades of the ten best picks of every target on the 1 nm grid."""
    series = _series(t, 1.0, ("support", "aperture_amp", "psf_amp", "joint_rho", "q"))
    series = series.withColumn("cells", F.filter("cells", lambda c: c["q"] > 0)).where(F.size("cells") > 0)
    picked = _picks(series, 1.0, 10, 10, 2.25).withColumn("crossings", windows.list_crossings("cells", "q", 4.0).cast("double"))
    cell = F.filter("maxima", lambda m: F.exists("picks", lambda p: p["i"] + 750.0 == m["line_nm"]))
    found = picked.select("target_id", "crossings", F.inline_outer(cell)).where("line_nm is not null")
    found = found.withColumn("p_global", p_global(F.col("q"), F.col("crossings"), F.lit(4.0))).withColumn("tier", F.when(F.col("p_global") <= 0.01, "science_pass").otherwise("raw")).withColumn("flagged_points_sum", F.lit(0))
    return candidates.review_grades(found).select("target_id", "line_nm", "review_grade", "reject_reasons")
