"""Summaries: targets, flags, quality, magnitudes, stages, confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.numeric import rounded
from skyweave.operators import bands, spectra
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query


@query("a1_target_summary", "select target_id, count(*) as n_measurements, round(min(cwave_um), 9) as wavelength_min_um, round(max(cwave_um), 9) as wavelength_max_um, round(median(aperture_flux_uJy), 6) as median_flux_uJy, round(median(psf_flux_uJy), 6) as median_psf_flux_uJy, round(max(aperture_flux_uJy/aperture_flux_unc_uJy), 8) as max_snr from spectra_points group by 1")
def target_summary(t: Tables) -> DataFrame:
    out = spectra.target_summary(t.points)
    return out.withColumns({c: F.round(c, d) for c, d in (("wavelength_min_um", 9), ("wavelength_max_um", 9), ("median_flux_uJy", 6), ("median_psf_flux_uJy", 6), ("max_snr", 8))})


@query("a2_distinct_strings", "select target_id, array_to_string(list_sort(list(distinct cast(detector as varchar))), ',') as detectors, count(distinct detector) as n from spectra_points group by 1")
def distinct_strings(t: Tables) -> DataFrame:
    return t.points.groupBy("target_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("detector").cast("string"))), ",").alias("detectors"), F.count_distinct("detector").alias("n"))


@query("a3_flag_summary", "select target_id, cast(sum(case when fatal_flag_present then 1 else 0 end) as bigint) as flagged, count(*) as points, round(sum(case when fatal_flag_present then 1e0 else 0e0 end)/count(*), 9) as flag_fraction from spectra_points group by 1")
def flag_summary(t: Tables) -> DataFrame:
    return spectra.flag_summary(t.points).withColumn("flag_fraction", F.round("flag_fraction", 9))


def _tiebroken(df: DataFrame) -> DataFrame:
    """Points with one row for each wavelength of a target, so that neighbours are defined."""
    w = Window.partitionBy("target_id", "cwave_um").orderBy("image_id", "detector", "aperture_flux_uJy", "psf_flux_uJy")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@query(
    "a4_spectrum_quality",
    """with one as (select * from (select *, row_number() over (partition by target_id, cwave_um order by image_id, detector, aperture_flux_uJy, psf_flux_uJy) as k from spectra_points) where k = 1),
g as (select target_id, cwave_um, aperture_flux_uJy as a, psf_flux_uJy as p, aperture_flux_unc_uJy as u from one where not fatal_flag_present),
c as (select target_id, count(*) as n, sum(case when fatal_flag_present then 1 else 0 end)*1e0/count(*) as ff from one group by 1),
m as (select target_id, median(a) as ma from g group by 1),
d as (select g.target_id, count(*) as usable, (max(cwave_um) - min(cwave_um))*1000e0 as span, median(abs(a/u)) as snr, corr(a, p) as corr, median(abs(a - p)/greatest(abs(a), abs(p))) as fd, 1.4826e0*median(abs(a - ma)) as sc from g join m on g.target_id = m.target_id group by 1),
j as (select target_id, median(abs(r)) as jag from (select target_id, a - 0.5e0*(lag(a) over (partition by target_id order by cwave_um) + lead(a) over (partition by target_id order by cwave_um)) as r from g) where r is not null group by 1),
s as (select c.target_id, n, usable, ff, span, corr, fd, snr, 1e0/(1e0 + jag/sc) as smooth, 0.65e0*(corr + 1e0)/2e0 + 0.35e0/(1e0 + 2e0*fd) as agree, least(1e0, log10(greatest(snr, 1e0))/log10(20e0)) as ss from c join d on c.target_id = d.target_id join j on c.target_id = j.target_id)
select target_id, n as n_measurements, usable as n_usable, round(ff, 9) as flag_fraction, round(smooth, 8) as smoothness, round(agree, 8) as agreement, round(ss, 8) as snr_score, round(span, 5) as span_nm,
 round(100e0*(0.28e0*greatest(0e0, 1e0 - 2e0*ff) + 0.24e0*smooth + 0.2e0*least(1e0, usable/80e0) + 0.18e0*agree + 0.1e0*ss), 6) as score from s""",
)
def spectrum_quality(t: Tables) -> DataFrame:
    q = spectra.spectrum_quality(_tiebroken(t.points))
    return q.select("target_id", "n_measurements", "n_usable", *(F.round(c, d).alias(c) for c, d in (("flag_fraction", 9), ("smoothness", 8), ("agreement", 8), ("snr_score", 8), ("span_nm", 5), ("score", 6))))


def quality_sql(points: str) -> str:
    """Quality of every target of ``points`` (target_id, x, a, u, p, bad), from its definition."""
    return f"""q0 as ({points}), gg as (select * from q0 where not bad),
mm as (select target_id, median(a) as ma from gg group by 1),
jj as (select target_id, median(abs(r)) as jag from (select target_id, a - 0.5e0*(lag(a) over w + lead(a) over w) as r from gg window w as (partition by target_id order by x, a, p)) group by 1),
cc as (select target_id, count(*) as n, count(case when bad then 1 end)*1e0/count(*) as ff from q0 group by 1),
dd as (select g.target_id, count(*) as usable, (max(x) - min(x))*1000e0 as span, median(abs(a/u)) as snr, corr(a, p) as corr, median(abs(a - p)/greatest(abs(a), abs(p))) as fd, 1.4826e0*median(abs(a - ma)) as sc from gg g join mm m on g.target_id = m.target_id group by 1),
ss as (select c.target_id, n, ff, usable, span, snr, corr, fd, least(1e0, greatest(0e0, 1e0/(1e0 + jag/sc))) as smooth, least(1e0, greatest(0e0, 0.65e0*(corr + 1e0)/2e0 + 0.35e0/(1e0 + 2e0*fd))) as agree, least(1e0, log10(greatest(snr, 1e0))/log10(20e0)) as ss from cc c join dd d on c.target_id = d.target_id join jj j on c.target_id = j.target_id),
sc as (select *, 100e0*(0.28e0*greatest(0e0, 1e0 - 2e0*ff) + 0.24e0*smooth + 0.2e0*least(1e0, usable/80e0) + 0.18e0*agree + 0.1e0*ss) as score,
 concat_ws(',', case when usable < 50 then 'too_few_usable_points' end, case when span < 4000e0 then 'insufficient_wavelength_span' end, case when ff > 0.25e0 then 'too_many_fatal_flags' end, case when smooth < 0.45e0 then 'jagged_or_noisy_continuum' end, case when corr < 0.75e0 then 'low_aperture_psf_shape_agreement' end, case when fd > 1e0 then 'large_aperture_psf_flux_disagreement' end) as hard from ss),
quality as (select *, case when score >= 70e0 and hard = '' then 'good' when score >= 45e0 and ff <= 0.35e0 and usable >= 25 then 'review' else 'bad' end as category, concat_ws(',', nullif(hard, ''), case when snr < 1e0 then 'low_median_snr' end) as reasons from sc)"""


_ONE = "row_number() over (partition by target_id, cwave_um order by image_id, detector, aperture_flux_uJy, psf_flux_uJy) as k"


@query("a4_quality_reasons", "with " + quality_sql(f"select target_id, cwave_um as x, aperture_flux_uJy as a, aperture_flux_unc_uJy as u, psf_flux_uJy as p, fatal_flag_present as bad from (select *, {_ONE} from spectra_points) where k = 1") + " select target_id, category, reasons from quality")
def quality_reasons(t: Tables) -> DataFrame:
    return spectra.spectrum_quality(_tiebroken(t.points)).select("target_id", "category", "reasons")


@query("a5_robust_scale", "with m as (select target_id, median(aperture_flux_uJy) as m from spectra_points group by 1) select p.target_id, round(1.4826e0*median(abs(aperture_flux_uJy - m)), 5) as scale from spectra_points p join m on p.target_id = m.target_id group by 1")
def robust_scale(t: Tables) -> DataFrame:
    return bands.residual_rms(t.points, "aperture_flux_uJy", ["target_id"]).withColumn("scale", F.round("scale", 5))


@query("a6_percentiles", "select target_id, round(quantile_cont(aperture_flux_uJy, 0.1), 5) as p10, round(median(aperture_flux_uJy), 5) as p50, round(quantile_cont(aperture_flux_uJy, 0.9), 5) as p90 from spectra_points group by 1")
def percentiles(t: Tables) -> DataFrame:
    f = F.col("aperture_flux_uJy")
    return t.points.groupBy("target_id").agg(*(F.round(F.percentile(f, q), 5).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))))


@query("a14_value_counts", "select event as item, count(*) as n from (select event from status_events union all select case when value > 50 then 'slow' else 'fast' end from status_events) group by 1")
def value_counts(t: Tables) -> DataFrame:
    tags = F.concat_ws(",", "event", F.when(F.col("value") > 50, "slow").otherwise("fast"))
    return t.events.select(F.explode(F.split(tags, ",")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("a16_injected_rollup", "select cast(substr(target_id, 5) as bigint) % 4 as grp, count(*) as n, sum(strength) as total, max(strength) as most, array_to_string(list_sort(list(distinct line_family)), ',') as families, array_to_string(list_sort(list(distinct cast(cast(injected_line_nm as bigint) as varchar))), ',') as lines from injection_truth group by 1")
def injected_rollup(t: Tables) -> DataFrame:
    from skyweave.functions.numeric import general_format

    g = (F.substring("target_id", 5, 20).cast("long") % 4).alias("grp")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return t.truth.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("total"), F.max("strength").alias("most"), joined(F.col("line_family")).alias("families"), joined(general_format(F.col("injected_line_nm"))).alias("lines"))


@query("a19_first_row", "select target_id, image_id as first_image, round(cwave_um, 9) as first_um, n from (select *, row_number() over (partition by target_id order by cwave_um, image_id, detector, aperture_flux_uJy) as k, count(*) over (partition by target_id) as n from spectra_points) where k = 1")
def first_row(t: Tables) -> DataFrame:
    key = F.struct("cwave_um", "image_id", "detector", "aperture_flux_uJy")
    return t.points.groupBy("target_id").agg(F.min_by("image_id", key).alias("first_image"), F.round(F.min("cwave_um"), 9).alias("first_um"), F.count(F.lit(1)).alias("n"))


@query("a25_upper_median", "select image_id, s[cast(len(s) // 2 as bigint) + 1] as upper_median, round(total, 4) as total from (select image_id, list_sort(list(value)) as s, sum(value) as total from status_events group by 1)")
def upper_median(t: Tables) -> DataFrame:
    s = F.sort_array(F.collect_list("value"))
    got = t.events.groupBy("image_id").agg(s.alias("s"), F.sum("value").alias("total"))
    return got.select("image_id", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("upper_median"), F.round("total", 4).alias("total"))


@query("a26_channel_percentiles", "select detector, round(quantile_cont(cwave_um, 0.05), 9) as p05, round(quantile_cont(cwave_um, 0.5), 9) as p50, round(quantile_cont(cwave_um, 0.95), 9) as p95 from spectra_points where not fatal_flag_present group by 1")
def channel_percentiles(t: Tables) -> DataFrame:
    p = F.percentile("cwave_um", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    got = t.points.where(~F.col("fatal_flag_present")).groupBy("detector").agg(p.alias("p"))
    return got.select("detector", *(F.round(F.col("p")[k], 9).alias(n) for k, n in enumerate(("p05", "p50", "p95"))))


@query("a28_binned_median", "select target_id, cast(floor(cwave_um/0.05e0) as bigint) as bin, round(median(aperture_flux_uJy), 5) as median_flux, count(*) as n from spectra_points group by 1, 2")
def binned_median(t: Tables) -> DataFrame:
    return spectra.binned_median(t.points, 0.05).withColumn("median_flux", rounded(F.col("median_flux"), 5))


@query("a29_backend_pivot", "select detector, round(avg(case when kind = 'a' then f end), 5) as a, round(avg(case when kind = 'p' then f end), 5) as p from (select detector, 'a' as kind, aperture_flux_uJy as f from spectra_points union all select detector, 'p', psf_flux_uJy from spectra_points) group by 1")
def backend_pivot(t: Tables) -> DataFrame:
    long = t.points.select("detector", F.explode(F.array(F.struct(F.lit("a").alias("k"), F.col("aperture_flux_uJy").alias("f")), F.struct(F.lit("p").alias("k"), F.col("psf_flux_uJy").alias("f")))).alias("x")).select("detector", "x.*")
    wide = long.groupBy("detector").pivot("k", ["a", "p"]).agg(F.avg("f"))
    return wide.select("detector", F.round("a", 5).alias("a"), F.round("p", 5).alias("p"))


@query("a4_quality_gate_points", "with sm as (select target_id, image_id, detector, cwave_um, 1e4/cwave_um + aperture_flux_uJy*1e-4 as aperture_flux_uJy, (1e4/cwave_um + aperture_flux_uJy*1e-4)*1.01e0 as psf_flux_uJy, aperture_flux_unc_uJy, fatal_flag_present from spectra_points where not fatal_flag_present), " + quality_sql(f"select target_id, cwave_um as x, aperture_flux_uJy as a, aperture_flux_unc_uJy as u, psf_flux_uJy as p, false as bad from (select *, {_ONE} from sm) where k = 1") + " select q0.target_id, count(*) as n from q0 join quality on q0.target_id = quality.target_id where category = 'good' and usable >= 50 and span >= 4000e0 and corr >= 0.75e0 and fd <= 1e0 group by 1")
def gated(t: Tables) -> DataFrame:
    smooth = t.points.withColumn("aperture_flux_uJy", 1e4 / F.col("cwave_um") + F.col("aperture_flux_uJy") * 1e-4).withColumn("psf_flux_uJy", F.col("aperture_flux_uJy") * 1.01)
    one = _tiebroken(smooth.where("not fatal_flag_present"))
    return spectra.quality_gate(one, spectra.spectrum_quality(one)).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
