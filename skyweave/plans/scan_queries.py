"""Matched-filter scans and the sequence operators on their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions.numeric import p_global, p_local, rounded
from skyweave.operators import bands, spectra, windows
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query
from skyweave.session import stored

GRID = "grid as (select 750e0 + 25e0*i as line_nm from range(171) t(i))"
#: The grids of the reference's blind scan and dual scan, and the plan's distinct lines.
GRID_5NM = "grid as (select 750e0 + 5e0*i as line_nm from range(851) t(i))"
GRID_1NM = "grid as (select 750e0 + 1e0*i as line_nm from range(4251) t(i))"
PLAN_GRID = "grid as (select distinct injected_line_nm as line_nm from injection_truth)"
RESPONSE = "exp(-0.5e0*pow((p.cwave_um - g.line_nm/1000e0)/(sqrt(p.cband_um*p.cband_um + 0.000001e0)/2.354820045e0), 2))"


def _points(t: Tables, kind: str = "aperture") -> DataFrame:
    return t.points.withColumnsRenamed({f"{kind}_flux_uJy": "flux", f"{kind}_flux_unc_uJy": "unc"})


def _grid(t: Tables, step_nm: float = 25.0) -> DataFrame:
    return bands.line_grid(t.spark, 750.0, 5000.0, step_nm)


def _plan_lines(t: Tables) -> DataFrame:
    return t.truth.select(F.col("injected_line_nm").alias("line_nm")).distinct()


def _scores(t: Tables, kind: str = "aperture", step_nm: float = 25.0) -> DataFrame:
    return bands.scan(_points(t, kind), _grid(t, step_nm))


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


def scan_sql(kind: str = "aperture", least_continuum: int = 3, least_support: int = 2, level: str = "median", grid: str = GRID) -> str:
    return f"""with {grid},
base as (select target_id, cwave_um, cband_um, {kind}_flux_uJy as f, {kind}_flux_unc_uJy as u from spectra_points where not coalesce(fatal_flag_present, false)),
whole as (select target_id, {level}(f) as c_target from base group by target_id having count(*) >= 8),
near as (select p.target_id, g.line_nm, p.f, p.u, {RESPONSE} as t from base p join grid g on abs(p.cwave_um - g.line_nm/1000e0) <= 0.18e0),
lev as (select target_id, line_nm, {level}(case when t <= 0.25e0 then f end) as c_off, count(case when t <= 0.25e0 then 1 end) as n_off, {level}(f) as c_win, count(*) as n_win, count(case when t >= 0.001e0 then 1 end) as support from near group by 1, 2),
chosen as (select l.target_id, l.line_nm, support, case when n_off >= {least_continuum} then c_off when n_win >= {least_continuum} then c_win else c_target end as continuum from lev l join whole w on l.target_id = w.target_id where support >= {least_support}),
sums as (select n.target_id, n.line_nm, min(c.continuum) as continuum, min(c.support) as support, sum(t*(f - c.continuum)/(u*u)) as s, sum(t*t/(u*u)) as n from near n join chosen c on n.target_id = c.target_id and n.line_nm = c.line_nm where t >= 0.001e0 group by 1, 2),
scores as (select target_id, line_nm, s/n as amp, 1e0/sqrt(n) as amp_unc, s/sqrt(n) as snr, continuum, support from sums where n > 0)
"""


_OUT = "select target_id, line_nm, round(amp, 3) as amp, round(amp_unc, 6) as amp_unc, round(snr, 5) as snr, round(continuum, 6) as continuum, cast(support as bigint) as support from scores"
_DIGITS = {"amp": 3, "amp_unc": 6, "snr": 5, "continuum": 6}


@query("f1_blind_scan", scan_sql() + _OUT)
def blind_scan(t: Tables) -> DataFrame:
    return _rounded(_scores(t), _DIGITS)


@query("f2_plan_scan", scan_sql(least_continuum=5, least_support=1) + _OUT)
def plan_scan(t: Tables) -> DataFrame:
    return _rounded(bands.scan(_points(t), _grid(t), least_continuum=5, least_support=1), _DIGITS)


@query("f1_blind_scan_psf", scan_sql("psf") + _OUT)
def blind_scan_psf(t: Tables) -> DataFrame:
    return _rounded(_scores(t, "psf"), _DIGITS)


@query("f4_mean_continuum_scan", scan_sql(level="avg") + _OUT)
def mean_scan(t: Tables) -> DataFrame:
    return _rounded(bands.scan(_points(t), _grid(t), continuum="mean"), _DIGITS)


CLUSTERS = """, hits as (select target_id, line_nm, snr, case when line_nm - lag(line_nm) over (partition by target_id order by line_nm) > 30e0 then 1 else 0 end as fresh from scores where snr >= 5e0),
numbered as (select *, sum(fresh) over (partition by target_id order by line_nm rows unbounded preceding) as cluster_index from hits),
best as (select *, row_number() over (partition by target_id, cluster_index order by snr desc, line_nm) as k from numbered)
"""


@query("w4_gap_clusters", scan_sql() + CLUSTERS + "select target_id, cast(cluster_index as bigint) as cluster_index, max(case when k = 1 then line_nm end) as peak_x, round(max(snr), 5) as peak_score, min(line_nm) as min_x, max(line_nm) as max_x, max(line_nm) - min(line_nm) as width, count(*) as score_count from best group by 1, 2")
def gap_clusters(t: Tables) -> DataFrame:
    hits = _scores(t).where("snr >= 5")
    return windows.gap_clusters(hits, ["target_id"], "line_nm", 30.0, "snr").withColumn("peak_score", F.round("peak_score", 5)).orderBy(F.col("peak_score").desc(), "target_id", "cluster_index")


DUAL_SQL = f"""with {GRID},
base as (select target_id, cwave_um, cband_um, aperture_flux_uJy as fa, aperture_flux_unc_uJy as ua, psf_flux_uJy as fp, psf_flux_unc_uJy as up from spectra_points where not coalesce(fatal_flag_present, false)),
near as (select p.*, g.line_nm, {RESPONSE} as t from base p join grid g on abs(p.cwave_um - g.line_nm/1000e0) <= 0.18e0),
cont as (select target_id, line_nm, coalesce(avg(case when t <= 0.25e0 then fa end), 0e0) as ca, coalesce(avg(case when t <= 0.25e0 then fp end), 0e0) as cp from near group by 1, 2),
sums as (select n.target_id, n.line_nm, count(*) as support, sum(t*(fa - ca)/(ua*ua)) as sa, sum(t*t/(ua*ua)) as na, sum(t*(fp - cp)/(up*up)) as sp, sum(t*t/(up*up)) as np from near n join cont c on n.target_id = c.target_id and n.line_nm = c.line_nm where t >= 0.001e0 group by 1, 2),
scores as (select target_id, line_nm, support, sa/na as aperture_amp, sp/np as psf_amp, sa/sqrt(na) as aperture_snr, sp/sqrt(np) as psf_snr, (sa + sp)/sqrt(na + np) as joint_rho, case when sa + sp > 0 then (sa + sp)*(sa + sp)/(na + np) else 0e0 end as q from sums where na > 0 and np > 0)
"""


DUAL_SQL_1NM = DUAL_SQL.replace(GRID, GRID_1NM)


def _dual(t: Tables, step_nm: float = 25.0) -> DataFrame:
    return bands.dual_scan(t.points, _grid(t, step_nm))


@query("f5_dual_flux_scan", DUAL_SQL + "select target_id, line_nm, cast(support as bigint) as support, round(aperture_amp, 3) as aperture_amp, round(psf_amp, 3) as psf_amp, round(aperture_snr, 4) as aperture_snr, round(psf_snr, 4) as psf_snr, round(joint_rho, 4) as joint_rho, round(q, 2) as q from scores")
def dual_scan(t: Tables) -> DataFrame:
    return _rounded(_dual(t), {"aperture_amp": 3, "psf_amp": 3, "aperture_snr": 4, "psf_snr": 4, "joint_rho": 4, "q": 2})


def _series(t: Tables, step_nm: float = 25.0, columns: tuple[str, ...] = ("q",)) -> DataFrame:
    """A row for each target with its cells as a list."""
    return bands.dual_series(t.points, _grid(t, step_nm), columns)


def _crossings(series: DataFrame, level: float) -> DataFrame:
    return series.select("target_id", windows.list_crossings("cells", "q", level).alias("crossings"), F.array_max(F.col("cells.q")).alias("max_q"))


def _p_values(crossings: DataFrame) -> DataFrame:
    return crossings.select("target_id", "crossings", "max_q", p_local(F.col("max_q")).alias("p_local"), p_global(F.col("max_q"), F.col("crossings").cast("double"), F.lit(4.0)).alias("p_global"))


# Outer generators: from an inner one Spark infers a filter on the list's size, pushes it below the step that
# makes the list, and so computes the list anew for every cell that a lambda compares.
def _maxima(series: DataFrame) -> DataFrame:
    return _rounded(series.select("target_id", F.inline_outer(windows.list_maxima("cells", "q"))).where("line_nm is not null").select("target_id", "line_nm", "q"), {"q": 2})


def _picks(series: DataFrame, step_nm: float, k: int, separation: int, least: float = 0.0) -> DataFrame:
    index = lambda c: F.round((c["line_nm"] - 750.0) / step_nm)
    return series.withColumn("maxima", windows.list_maxima("cells", "q")).withColumn("picks", windows.list_picks("maxima", index, "q", k, separation, least))


def _ranked_picks(series: DataFrame, step_nm: float, k: int, separation: int, least: float = 0.0) -> DataFrame:
    picked = _picks(series, step_nm, k, separation, least).select("target_id", F.posexplode_outer("picks").alias("_rank", "_pick")).where("_rank is not null")
    return _rounded(picked.select("target_id", (F.col("_rank") + 1).alias("pick"), F.col("_pick.i").alias("line_index"), F.col("_pick.q").alias("q")), {"q": 2})


def _around(peaks: DataFrame, step_nm: float) -> DataFrame:
    """The 201 cells nearest to every peak_nm, within 80 nm. Cells are some lines of the grid in order, so
    their places are bounded by the grid's: only that part of the list is looked through."""
    lines, at = round(4250.0 / step_nm) + 1, lambda nm: F.floor((F.col("peak_nm") + nm - 750.0) / step_nm)
    first = F.greatest(F.lit(1), F.size("cells") - lines + at(-80.0)).cast("int")
    last = F.least(F.size("cells"), at(80.0) + 2).cast("int")
    peaks = peaks.withColumn("_part", F.slice("cells", first, F.greatest(F.lit(0), last - first + 1)))
    near = peaks.select("target_id", "peak_nm", F.inline_outer(windows.list_nearest("_part", "line_nm", "q", F.col("peak_nm"), 80.0, 201))).where("line_nm is not null")
    return _rounded(near.select("target_id", "line_nm", "peak_nm", "q"), {"q": 2})


@query("f6_p_values")
def p_values(t: Tables) -> DataFrame:
    return _p_values(_crossings(_series(t), 4.0))


@query("w5_up_crossings", DUAL_SQL + ", m as (select target_id, q, lag(q, 1, 0e0) over (partition by target_id order by line_nm) as b from scores) select target_id, cast(sum(case when b < 100e0 and q >= 100e0 then 1 else 0 end) as bigint) as crossings, round(max(q), 2) as max_q from m group by 1")
def up_crossings(t: Tables) -> DataFrame:
    return _rounded(_crossings(_series(t), 100.0), {"max_q": 2})


@query("w6_local_maxima", DUAL_SQL + ", m as (select target_id, line_nm, q, lag(q, 1, -1e0) over (partition by target_id order by line_nm) as a, lead(q, 1, -1e0) over (partition by target_id order by line_nm) as b from scores) select target_id, line_nm, round(q, 2) as q from m where q >= a and q >= b")
def local_maxima(t: Tables) -> DataFrame:
    return _maxima(_series(t))


@query("w7_nms_topk")
def nms_topk(t: Tables) -> DataFrame:
    return _ranked_picks(_series(t), 25.0, 5, 4)


@query("w3_neighbour_residual", "select target_id, round(median(abs(r)), 4) as jag from (select target_id, aperture_flux_uJy - 0.5e0*(lag(aperture_flux_uJy) over w + lead(aperture_flux_uJy) over w) as r from spectra_points window w as (partition by target_id order by cwave_um, image_id, detector, aperture_flux_uJy, psf_flux_uJy)) where r is not null group by 1")
def neighbour_residual(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("target_id").orderBy("cwave_um", "image_id", "detector", "aperture_flux_uJy", "psf_flux_uJy")
    f = F.col("aperture_flux_uJy")
    r = t.points.select("target_id", (f - 0.5 * (F.lag(f).over(w) + F.lead(f).over(w))).alias("r")).where("r is not null")
    return r.groupBy("target_id").agg(F.round(F.median(F.abs("r")), 4).alias("jag"))


@query("f10_pack_series", "select target_id, count(*) as length, round(min(cwave_um), 9) as first_um, round(max(cwave_um), 9) as last_um from spectra_points group by 1")
def pack_series(t: Tables) -> DataFrame:
    packed = spectra.pack_series(t.points, "aperture_flux_uJy", "aperture_flux_unc_uJy")
    return packed.select("target_id", "length", F.round(F.element_at("series", 1)["cwave_um"], 9).alias("first_um"), F.round(F.element_at("series", -1)["cwave_um"], 9).alias("last_um"))


@query("d10_line_grid", f"with {GRID_5NM} select line_nm from grid where line_nm >= (select min(cwave_um)*1000e0 from spectra_points) and line_nm <= (select max(cwave_um)*1000e0 from spectra_points)")
def grid(t: Tables) -> DataFrame:
    """The lines of the fine grid within the range that the points cover."""
    span = t.points.agg((F.min("cwave_um") * 1000.0).alias("low"), (F.max("cwave_um") * 1000.0).alias("high"))
    return _grid(t, 5.0).crossJoin(F.broadcast(span)).where(F.col("line_nm").between(F.col("low"), F.col("high"))).select("line_nm")


@query("f8_diagnostic_window", DUAL_SQL + ", best as (select target_id, line_nm as peak_nm, row_number() over (partition by target_id order by q desc, line_nm) as k from scores), around as (select s.target_id, s.line_nm, b.peak_nm, round(s.q, 2) as q, row_number() over (partition by s.target_id order by abs(s.line_nm - b.peak_nm), s.line_nm) as k from scores s join best b on s.target_id = b.target_id and b.k = 1 where abs(s.line_nm - b.peak_nm) <= 80e0) select target_id, line_nm, peak_nm, q from around where k <= 201")
def diagnostic_window(t: Tables) -> DataFrame:
    best = F.array_max(F.transform("cells", lambda c: F.struct(c["q"].alias("q"), (-c["line_nm"]).alias("n"))))["n"]
    return _around(_series(t).withColumn("peak_nm", -best), 25.0)


@query("v15_scan_driver", "select * from (" + scan_sql() + CLUSTERS + "select target_id, cast(cluster_index as bigint) as cluster_index, max(case when k = 1 then line_nm end) as peak_x, round(max(snr), 5) as peak_score, min(line_nm) as min_x, max(line_nm) as max_x, max(line_nm) - min(line_nm) as width, count(*) as score_count, 'aperture' as flux_kind from best group by 1, 2) union all select * from (" + scan_sql("psf") + CLUSTERS + "select target_id, cast(cluster_index as bigint), max(case when k = 1 then line_nm end), round(max(snr), 5), min(line_nm), max(line_nm), max(line_nm) - min(line_nm), count(*), 'psf' from best group by 1, 2)")
def scan_driver(t: Tables) -> DataFrame:
    """Scan of both fluxes, clusters of each, ready for merging."""
    parts = []
    for kind in ("aperture", "psf"):
        hits = _scores(t, kind).where("snr >= 5")
        parts.append(windows.gap_clusters(bands.dealt(hits, t.points), ["target_id"], "line_nm", 30.0, "snr").withColumns({"peak_score": F.round("peak_score", 5), "flux_kind": F.lit(kind)}))
    return parts[0].unionByName(parts[1])


# The queries above run on a 25 nm grid; those below on the reference's grids, with its gap, separation and number of picks.
@query("f1_blind_scan_5nm", scan_sql(grid=GRID_5NM) + _OUT)
def blind_scan_5nm(t: Tables) -> DataFrame:
    return _rounded(_scores(t, step_nm=5.0), _DIGITS)


@query("f1_blind_scan_psf_5nm", scan_sql("psf", grid=GRID_5NM) + _OUT)
def blind_scan_psf_5nm(t: Tables) -> DataFrame:
    return _rounded(_scores(t, "psf", 5.0), _DIGITS)


@query("f2_plan_lines", scan_sql(least_continuum=5, least_support=1, grid=PLAN_GRID) + _OUT)
def plan_lines(t: Tables) -> DataFrame:
    return _rounded(bands.scan(_points(t), _plan_lines(t), least_continuum=5, least_support=1), _DIGITS)


@query("w4_gap_clusters_5nm", scan_sql(grid=GRID_5NM) + CLUSTERS.replace("> 30e0", "> 15e0") + "select target_id, cast(cluster_index as bigint) as cluster_index, max(case when k = 1 then line_nm end) as peak_x, round(max(snr), 5) as peak_score, min(line_nm) as min_x, max(line_nm) as max_x, max(line_nm) - min(line_nm) as width, count(*) as score_count from best group by 1, 2")
def gap_clusters_5nm(t: Tables) -> DataFrame:
    hits = _scores(t, step_nm=5.0).where("snr >= 5")
    return windows.gap_clusters(hits, ["target_id"], "line_nm", 15.0, "snr").withColumn("peak_score", F.round("peak_score", 5))


@query("f5_dual_flux_scan_1nm", DUAL_SQL_1NM + "select target_id, line_nm, cast(support as bigint) as support, round(aperture_amp, 3) as aperture_amp, round(psf_amp, 3) as psf_amp, round(aperture_snr, 4) as aperture_snr, round(psf_snr, 4) as psf_snr, round(joint_rho, 4) as joint_rho, round(q, 2) as q from scores")
def dual_scan_1nm(t: Tables) -> DataFrame:
    return _rounded(_dual(t, 1.0), {"aperture_amp": 3, "psf_amp": 3, "aperture_snr": 4, "psf_snr": 4, "joint_rho": 4, "q": 2})


@query("f6_p_values_1nm")
def p_values_1nm(t: Tables) -> DataFrame:
    return _p_values(_crossings(_series(t, 1.0), 4.0))


@query("w5_up_crossings_1nm", DUAL_SQL_1NM + ", m as (select target_id, q, lag(q, 1, 0e0) over (partition by target_id order by line_nm) as b from scores) select target_id, cast(sum(case when b < 4e0 and q >= 4e0 then 1 else 0 end) as bigint) as crossings, round(max(q), 2) as max_q from m group by 1")
def up_crossings_1nm(t: Tables) -> DataFrame:
    return _rounded(_crossings(_series(t, 1.0), 4.0), {"max_q": 2})


# no oracle for the picks: where one point serves several lines, q is equal but for rounding
@query("w6_local_maxima_1nm")
def local_maxima_1nm(t: Tables) -> DataFrame:
    return _maxima(_series(t, 1.0))


@query("w7_nms_topk_1nm")
def nms_topk_1nm(t: Tables) -> DataFrame:
    return _ranked_picks(_series(t, 1.0), 1.0, 10, 10, 2.25)


@query("f8_diagnostic_window_1nm")
def diagnostic_window_1nm(t: Tables) -> DataFrame:
    """The lines around every pick of the 1 nm scan."""
    picked = _picks(_series(t, 1.0), 1.0, 10, 10, 2.25).select("target_id", "cells", F.explode_outer("picks").alias("_pick")).where("_pick is not null")
    return _around(picked.select("target_id", "cells", (F.col("_pick.i") + 750.0).alias("peak_nm")), 1.0)
