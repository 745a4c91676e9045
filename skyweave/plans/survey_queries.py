"""Review pages, series lookup, cone and quality scans, progress tables and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions import numeric, sky, strings
from skyweave.operators import bands, candidates, review
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query

# ------------------------------------------------------------------ catalog scans

QUALITY = "case c_custkey % 4 when 0 then 'AAA' when 1 then 'ABC' when 2 then 'BCU' else 'UAE' end"


@query("s3_band_quality_scan", f"select source_id, round(h_m, 9) as h_m, ph_qual from (select c_custkey as source_id, 8e0 + (c_custkey*31 % 900)/100e0 as h_m, {QUALITY} as ph_qual from customer) where h_m between 9e0 and 14e0 and substr(ph_qual, 2, 1) in ('A', 'B') order by h_m, source_id limit 400")
def band_quality_scan(t: Tables) -> DataFrame:
    """Sources of a magnitude range in one band whose quality letter of that band is allowed,
    brightest first: 20 for each target wanted."""
    band = {"j": 1, "h": 2, "k": 3}["h"]
    rows = t.table("customer").select(F.col("c_custkey").alias("source_id"), (8.0 + (F.col("c_custkey") * 31 % 900) / 100.0).alias("h_m"), F.expr(QUALITY).alias("ph_qual"))
    good = rows.where(F.col("h_m").between(9.0, 14.0) & F.substring("ph_qual", band, 1).isin("A", "B"))
    return good.orderBy("h_m", "source_id").limit(20 * 20).withColumn("h_m", F.round("h_m", 9))


@query("s4_cone_search", """select source_id, round(sep, 7) as separation_deg from (select source_id, degrees(2*asin(least(1e0, sqrt(pow(sin((radians(dec) - radians(40e0))/2), 2) + cos(radians(40e0))*cos(radians(dec))*pow(sin(radians(ra - 2e0)/2), 2))))) as sep from catalog_sources
 where dec between 20e0 and 60e0 and (ra >= 2e0 - 20e0/cos(radians(40e0)) + 360e0 or ra <= 2e0 + 20e0/cos(radians(40e0)))) where sep <= 20e0""")
def cone_search(t: Tables) -> DataFrame:
    """Sources within a radius: a box with wrapped right ascension reaches the scan, the exact
    separation decides."""
    return sky.cone(t.catalog, 2.0, 40.0, 20.0).select("source_id", F.round("separation_deg", 7).alias("separation_deg"))


@query("s18_series_lookup", "select image_id, round(cwave_um, 9) as cwave_um, aperture_flux_uJy from spectra_points where target_id = 'src_7'")
def series_lookup(t: Tables) -> DataFrame:
    """One target's series: the columns wanted that the table has; key and columns reach the scan."""
    wanted = ["image_id", "cwave_um", "aperture_flux_uJy", "not_in_this_version"]
    found = t.points.where(F.col("target_id") == "src_7")
    return found.select(*(c for c in wanted if c in found.columns)).withColumn("cwave_um", F.round("cwave_um", 9))


# ------------------------------------------------------------------ review

FILTERS = (
    ("science_pass", {"source": "science"}, "source in ('baseline', 'uninjected', 'science') and quality_pass"),
    ("injected_all", {"source": "injected", "quality": "all", "campaign": "camp2", "tier": "A"}, "source in ('injected', 'injected_raw') and tier = 'A' and (campaign = 'camp2' or starts_with(run_name, 'camp2_'))"),
    ("paired_rejects", {"source": "paired", "quality": "reject", "min_snr": 90.0}, "source in ('paired', 'paired_delta') and not quality_pass and greatest(rank_score, psf_peak_snr, aperture_peak_snr) >= 90e0"),
    ("urgent_review", {"source": "all", "quality": "review", "text": "URGENT"}, "quality_category = 'review' and lower(detectors) like '%urgent%'"),
    ("high_in_run", {"source": "all", "quality": "high_confidence", "text": "camp3_t1"}, "quality_category = 'high_confidence' and run_name like '%camp3_t1%'"),
)


@query("p21_review_filter", " union all ".join(f"select '{name}' as filter, joint_candidate_id from review_candidates where {where}" for name, _, where in FILTERS))
def review_filter(t: Tables) -> DataFrame:
    """The review page's criteria, alone and together."""
    parts = [review.filter_candidates(t.view("review_candidates"), **how).select(F.lit(name).alias("filter"), "joint_candidate_id") for name, how, _ in FILTERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _order_sql(columns: tuple[str, ...]) -> str:
    return ", ".join([*(f"{c} {'asc' if c in review.ASCENDING else 'desc'} nulls last" for c in columns), "joint_candidate_id"])


@query("o2_sort_menu", " union all ".join(f"select * from (select '{name}' as sort, joint_candidate_id from review_candidates order by {_order_sql(columns)} limit 100 offset 50)" for name, columns in review.SORTS.items()))
def sort_menu(t: Tables) -> DataFrame:
    """A page under each order of the menu."""
    out = None
    for name in review.SORTS:
        page = review.candidate_page(t.view("review_candidates"), name, 100, 50).select(F.lit(name).alias("sort"), "joint_candidate_id")
        out = page if out is None else out.union(page)
    return out


@query("v2_recovery_page", "select joint_candidate_id, run_name, round(greatest(psf_peak_snr, aperture_peak_snr), 6) as max_snr from review_candidates where (campaign = 'camp1' or starts_with(run_name, 'camp1_')) and (lower(run_name) like '%_t3%' or lower(target_id) like '%_t3%' or lower(joint_candidate_id) like '%_t3%') order by greatest(psf_peak_snr, aperture_peak_snr) desc nulls last, joint_candidate_id limit 50")
def recovery_page(t: Tables) -> DataFrame:
    found = review.strongest_false_positives(t.view("review_candidates"), "camp1", "_t3")
    return found.select("joint_candidate_id", "run_name", F.round("max_snr", 6).alias("max_snr"))


@query("v3_target_detail", "select * from (select image_id, round(cwave_um, 9) as cwave_um, 'aperture' as flux_kind, aperture_flux_uJy as flux, aperture_flux_unc_uJy as unc from spectra_points where target_id = 'src_7' union all select image_id, round(cwave_um, 9), 'psf', psf_flux_uJy, psf_flux_unc_uJy from spectra_points where target_id = 'src_7') order by cwave_um, flux_kind, image_id, flux limit 4000")
def target_detail(t: Tables) -> DataFrame:
    """A target's points by kind of flux, in order of wavelength."""
    points = t.points.where("target_id = 'src_7'").select("image_id", F.round("cwave_um", 9).alias("cwave_um"), "aperture_flux_uJy", "aperture_flux_unc_uJy", "psf_flux_uJy", "psf_flux_unc_uJy")
    return review.long_fluxes(points).orderBy("cwave_um", "flux_kind", "image_id", "flux").limit(4000)


@query("v6_frame_progress", "select s.target_id, case when m.target_id is null then 'queued' else 'done' end as status, m.image_id from (select distinct target_id from injection_truth) s left join (select target_id, image_id, row_number() over (partition by target_id order by cwave_um, image_id) as k from spectra_points where observation_id = 5 and detector = 3) m on s.target_id = m.target_id and m.k = 1")
def frame_progress(t: Tables) -> DataFrame:
    measured = t.points.where("observation_id = 5 and detector = 3")
    return review.frame_progress(t.truth.select("target_id").distinct(), measured, [F.col("cwave_um"), F.col("image_id")], ["image_id"])


COMMANDS = "select o_custkey % 97 as tile_id, case when o_orderkey % 50 = 0 then 'failed' when o_orderkey % 20 = 0 then 'active' when o_orderstatus = 'O' then 'done' when o_orderstatus = 'P' then 'pending' else 'idle' end as state from {source}"


@query("v10_tile_states", f"select tile_id, case when failed > 0 then 'failed' when active > 0 then 'active' when pending > 0 then 'pending' when done > 0 then 'done' else 'idle' end as status, campaigns, failed, active, pending, done, idle from (select tile_id, count(*) as campaigns, count_if(state = 'failed') as failed, count_if(state = 'active') as active, count_if(state = 'pending') as pending, count_if(state = 'done') as done, count_if(state = 'idle') as idle from ({COMMANDS.format(source='orders')}) group by 1)")
def tile_states(t: Tables) -> DataFrame:
    return review.tile_states(t.spark.sql(COMMANDS, source=t.table("orders")))


@query("v24_example_set", "select injection_id, target_id from injection_truth where target_id not in (select target_id from injection_truth where strength >= 12e0) order by injection_id limit 40")
def example_set(t: Tables) -> DataFrame:
    """The first examples that are no part of the challenge."""
    challenge = t.truth.where("strength >= 12").select("target_id")
    return t.truth.join(challenge, "target_id", "left_anti").orderBy("injection_id").limit(40).select("injection_id", "target_id")


@query("v25_binary_metrics", """with r as (select strength >= 8e0 as y, ((length(injection_id)*37 + cast(substr(injection_id, 5) as bigint)*53) % 100)/100e0 >= 0.5e0 as p from injection_truth),
c as (select count_if(y) as injected_total, count_if(not y) as baseline_total, count_if(p and y) as injected_recovered, count_if(not p and y) as injected_missed, count_if(not p and not y) as baseline_correct, count_if(p and not y) as baseline_false_alarms from r)
select *, round(injected_recovered/cast(greatest(injected_total, 1) as double), 9) as injected_recovered_fraction, round(baseline_false_alarms/cast(greatest(baseline_total, 1) as double), 9) as baseline_false_alarm_fraction from c""")
def binary_metrics(t: Tables) -> DataFrame:
    probability = ((F.length("injection_id") * 37 + F.substring("injection_id", 5, 20).cast("long") * 53) % 100) / 100.0
    got = review.binary_metrics(t.truth, F.when(F.col("strength") >= 8, 1.0).otherwise(0.0), probability)
    return got.withColumns({c: F.round(c, 9) for c in ("injected_recovered_fraction", "baseline_false_alarm_fraction")})


@query("x27_support_rank", """select joint_candidate_id, case when s >= 3 and b then 'A' when s >= 3 or (s >= 2 and b) then 'B' when s >= 2 then 'C' else 'D' end as tier,
 round(p + least(s, 5)*2.5e0 + case when b then 8e0 else 0e0 end + 1.5e0 + 0.75e0*2 - case when s <= 1 then 12e0 else 0e0 end - least(flagged_points_sum, 10)*2e0 - case when w > 250e0 then 5e0 else 0e0 end, 6) as rank
 from (select *, greatest(aperture_support, psf_support) as s, aperture_peak_snr is not null and psf_peak_snr is not null as b, greatest(coalesce(aperture_peak_snr, 0e0), coalesce(psf_peak_snr, 0e0)) as p, peak_line_nm/10e0 as w from review_candidates)""")
def support_rank(t: Tables) -> DataFrame:
    rows = t.view("review_candidates").withColumns({"has_aperture": F.col("aperture_peak_snr").isNotNull(), "has_psf": F.col("psf_peak_snr").isNotNull(), "cluster_width_nm": F.col("peak_line_nm") / 10.0, "detectors": F.lit("3"), "best_frame_ids": F.lit("f1,f2")})
    both = F.col("has_aperture") & F.col("has_psf")
    return rows.select("joint_candidate_id", candidates.support_tier(F.col("aperture_support"), F.col("psf_support"), both).alias("tier"), F.round(candidates.rank_score(), 6).alias("rank"))


# ------------------------------------------------------------------ scalar functions


@query("x1_math", "select c_custkey, round(exp(c_acctbal/1e4), 9) as e, round(sqrt(abs(c_acctbal)), 9) as r, round(case when c_acctbal > 0 then log10(c_acctbal) end, 9) as l, cast(floor(c_acctbal) as bigint) as f, round(sqrt(c_acctbal*c_acctbal + c_nationkey*c_nationkey), 6) as h, least(100e0, greatest(-100e0, c_acctbal)) as c from customer")
def math_functions(t: Tables) -> DataFrame:
    x = F.col("c_acctbal").cast("double")
    return t.table("customer").select(
        "c_custkey", F.round(F.exp(x / 1e4), 9).alias("e"), F.round(F.sqrt(F.abs(x)), 9).alias("r"), F.round(numeric.log10_positive(x), 9).alias("l"), F.floor(x).cast("long").alias("f"),
        F.round(F.hypot(x, F.col("c_nationkey").cast("double")), 6).alias("h"), numeric.clip(x, -100.0, 100.0).alias("c"),
    )


@query("x2_clip01", "select event_id, round(coalesce(least(1e0, greatest(0e0, nullif(value, 0e0)/100e0)), 0e0), 9) as c from status_events")
def clip01(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(numeric.clip01(F.nullif(F.col("value"), F.lit(0.0)) / 100.0), 9).alias("c"))


@query("x3_snr_feature", "select l_orderkey, l_linenumber, round(least(50e0, greatest(-50e0, case when l_quantity - 5e0 > 0 then l_extendedprice/(l_quantity - 5e0) else 0e0 end))/50e0, 9) as snr, round(least(12e0, greatest(-12e0, (l_extendedprice - 30000e0)/2000e0)), 9) as norm from lineitem")
def snr_feature(t: Tables) -> DataFrame:
    flux, unc = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double") - 5.0
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.snr_feature(flux, unc), 9).alias("snr"), F.round(numeric.robust_norm(flux, F.lit(30000.0), F.lit(2000.0)), 9).alias("norm"))


UNFLAGGED = "select target_id, aperture_flux_uJy as a, psf_flux_uJy as p, aperture_flux_unc_uJy as u from spectra_points where not coalesce(fatal_flag_present, false)"


@query("x4_agreement", f"with s as (select target_id, count(*) as n, corr(a, p) as c, median(abs(a - p)/greatest(abs(a), abs(p))) as d from ({UNFLAGGED}) group by 1) select target_id, round(c, 6) as correlation, round(d, 6) as fractional_delta, round(case when n < 8 then 0.55e0 else least(1e0, greatest(0e0, 0.65e0*least(1e0, greatest(0e0, (c + 1e0)/2e0)) + 0.35e0/(1e0 + 2e0*d))) end, 6) as agreement from s")
def agreement(t: Tables) -> DataFrame:
    a, p = F.col("aperture_flux_uJy"), F.col("psf_flux_uJy")
    good = t.points.where(~F.coalesce("fatal_flag_present", F.lit(False)) & numeric.finite(a).isNotNull() & numeric.finite(p).isNotNull())
    largest = F.greatest(F.abs(a), F.abs(p))
    got = good.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.corr(a, p).alias("c"), F.median(F.when(largest > 0, F.abs(a - p) / largest)).alias("d"), F.stddev_pop(a).alias("sa"), F.stddev_pop(p).alias("sp"))
    spread = (F.col("n") >= 8) & (F.col("sa") > 0) & (F.col("sp") > 0)
    correlation = F.coalesce(numeric.clip((numeric.finite(F.col("c")) + 1.0) / 2.0, 0.0, 1.0), F.lit(0.55))
    delta = F.coalesce(1.0 / (1.0 + 2.0 * F.greatest("d", F.lit(0.0))), F.lit(0.55))
    score = F.when(spread, numeric.clip01(0.65 * correlation + 0.35 * delta)).otherwise(0.55)
    return got.select("target_id", F.round("c", 6).alias("correlation"), F.round("d", 6).alias("fractional_delta"), F.round(score, 6).alias("agreement"))


@query("x5_snr_score", f"select target_id, round(case when count(*) < 5 then 0e0 else least(1e0, log10(greatest(median(abs(a/u)), 1e0))/log10(20e0)) end, 9) as score from ({UNFLAGGED} and aperture_flux_unc_uJy > 0) group by 1")
def snr_score(t: Tables) -> DataFrame:
    good = t.points.where(~F.coalesce("fatal_flag_present", F.lit(False)) & (F.col("aperture_flux_unc_uJy") > 0))
    got = good.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.median(F.abs(F.col("aperture_flux_uJy") / F.col("aperture_flux_unc_uJy"))).alias("m"))
    return got.select("target_id", F.round(F.when(F.col("n") >= 5, numeric.clip01(F.log10(F.greatest("m", F.lit(1.0))) / F.log10(F.lit(20.0)))).otherwise(0.0), 9).alias("score"))


@query("x8_bilinear", "with p as (select source_id, ra/60e0 - 0.5e0 as x, (dec + 90e0)/40e0 as y from catalog_sources), q as (select *, least(floor(x) + 1, 4e0) as x1, least(floor(y) + 1, 3e0) as y1, floor(x) as x0, floor(y) as y0 from p) select source_id, round(case when x >= 0 and y >= 0 and x <= 4e0 and y <= 3e0 then (y0*10e0 + x0*x0)*(1e0 - x + x0)*(1e0 - y + y0) + (y0*10e0 + x1*x1)*(x - x0)*(1e0 - y + y0) + (y1*10e0 + x0*x0)*(1e0 - x + x0)*(y - y0) + (y1*10e0 + x1*x1)*(x - x0)*(y - y0) end, 7) as value from q")
def bilinear(t: Tables) -> DataFrame:
    image = F.array(*(F.array(*(F.lit(10.0 * y + float(x * x)) for x in range(5))) for y in range(4)))
    return t.catalog.select("source_id", F.round(numeric.bilinear(image, F.col("ra") / 60.0 - 0.5, (F.col("dec") + 90.0) / 40.0), 7).alias("value"))


@query("x9_bits", "select target_id, bit_or(flags_summary) as all_flags, bit_or(flags_summary >> 2) as shifted, bit_or(flags_summary & 5) as masked from spectra_points group by 1")
def bits(t: Tables) -> DataFrame:
    flags = F.col("flags_summary")
    return t.points.groupBy("target_id").agg(F.bit_or(flags).alias("all_flags"), F.bit_or(F.shiftright(flags, 2)).alias("shifted"), F.bit_or(flags.bitwiseAND(F.lit(5))).alias("masked"))


@query("x11_content_hash", "select page_id, sha256(coalesce(html, '')) as sha256 from pages")
def content_hash(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha256"))


@query("x15_run_targets", "with r as (select joint_candidate_id, run_name || '_u_' || tier as stem from review_candidates) select joint_candidate_id, case when stem = 'camp2' or starts_with(stem, 'camp2_') then 'camp2' else regexp_extract(stem, '^(.*)_[^_]*$', 1) end as campaign, case when starts_with(stem, 'camp2_') then substr(stem, 7) else stem end as target from r")
def run_targets(t: Tables) -> DataFrame:
    name = F.concat("run_name", F.lit("_u_"), "tier", F.when(F.col("tier") == "A", "_injected").otherwise("_baseline"))
    campaign, target = strings.campaign_and_target(name, ["camp2"])
    return t.view("review_candidates").select("joint_candidate_id", campaign.alias("campaign"), target.alias("target"))


@query("x17_query_strings", "select o_orderkey, 'a+b ' || o_orderpriority as q, 'v' || cast(o_orderkey as string) as k, cast(null as varchar) as absent, '' as bare from orders")
def query_strings(t: Tables) -> DataFrame:
    text = F.concat(F.lit("bare&q=a+b%20"), F.url_encode("o_orderpriority"), F.lit("&k=v"), F.col("o_orderkey").cast("string"), F.lit("&k=second"))
    # what is encoded keeps its blanks as plus signs only where the text had plus signs
    text = F.replace(text, F.lit("T+S"), F.lit("T%20S"))
    return t.table("orders").select("o_orderkey", strings.query_parameter(text, "q").alias("q"), strings.query_parameter(text, "k").alias("k"), strings.query_parameter(text, "none").alias("absent"), strings.query_parameter(text, "bare").alias("bare"))


@query("x19_clean_json", "select s_suppkey, '{\"key\":' || cast(s_suppkey as string) || case when s_suppkey % 3 = 0 or s_suppkey % 3 = 1 then '' else ',\"value\":' || cast(s_suppkey as string) || '.5' end || '}' as json from supplier")
def clean_json(t: Tables) -> DataFrame:
    """Numbers that JSON can't hold are left out like nulls."""
    k = F.col("s_suppkey")
    value = F.when(k % 3 == 0, float("nan")).when(k % 3 == 1, float("inf")).otherwise(k + 0.5)
    return t.table("supplier").select("s_suppkey", F.to_json(F.struct(k.alias("key"), numeric.finite(value).alias("value"))).alias("json"))


@query("x22_log_times", "select o_orderkey, cast(epoch(cast(o_orderdate as timestamp)) as bigint) + 11045 as started, cast(null as bigint) as unmarked, 60.0e0 as elapsed from orders")
def log_times(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    started = strings.log_time(F.concat(F.lit("=== "), day, F.lit("T03:04:05 run begins")))
    ended = strings.log_time(F.concat(F.lit("x === "), day, F.lit("T03:05:05 ===")))
    return t.table("orders").select("o_orderkey", started.alias("started"), strings.log_time(F.lit("no mark here")).alias("unmarked"), F.greatest((ended - started).cast("double"), F.lit(0.0)).alias("elapsed"))


@query("x24_series_arrays", "with p as (select target_id, list(cast(detector as integer) order by detector) as d, list(l) as unused from (select target_id, detector, 1 as l from spectra_points) group by 1) select target_id, len(list_distinct(d)) as kinds, cast(list_sum(list_transform(d, lambda x: x*2)) as bigint) as doubled, cast(coalesce(list_position(d, 3), 0) as bigint) as first_three, cast(list_sum(d[1:5]) as bigint) as head from p")
def series_arrays(t: Tables) -> DataFrame:
    series = t.points.groupBy("target_id").agg(F.array_sort(F.collect_list("detector")).alias("d"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return series.select("target_id", F.size(F.array_distinct("d")).cast("long").alias("kinds"), total(F.transform("d", lambda x: x * 2)).alias("doubled"), F.array_position("d", 3).alias("first_three"), total(F.slice("d", 1, 5)).alias("head"))


@query("x30_lookup_default", "select o_orderkey, case o_orderstatus when 'F' then '/new/F' when 'O' then '/new/O' else '/old/' || o_orderstatus end as path from orders")
def lookup_default(t: Tables) -> DataFrame:
    moved = F.create_map(*(F.lit(x) for k in "FO" for x in (k, f"/new/{k}")))
    return t.table("orders").select("o_orderkey", F.coalesce(F.try_element_at(moved, F.col("o_orderstatus")), F.concat(F.lit("/old/"), F.col("o_orderstatus"))).alias("path"))


@query("f7_line_response", "select target_id, image_id, detector, round(sum(exp(-0.5e0*pow((cwave_um - 1.55e0)/(coalesce(case when detector <> 2 then cband_um end, 0.04e0)/2.355e0), 2))), 7) as response from spectra_points group by 1, 2, 3")
def line_response(t: Tables) -> DataFrame:
    band = F.when(F.col("detector") != 2, F.col("cband_um"))
    return t.points.groupBy("target_id", "image_id", "detector").agg(F.round(F.sum(bands.line_response(F.col("cwave_um"), band, F.lit(1.55))), 7).alias("response"))


@query("a11_campaign_totals", "select campaign, count(*) as candidates, count(distinct run_name) as runs, count(distinct target_id) as targets, count_if(quality_pass) as passed, count_if(tier = 'A') as tier_a, count_if(tier = 'B') as tier_b, count_if(tier = 'C') as tier_c, count_if(source = 'injected') as injected, count_if(flagged_points_sum > 0) as flagged, round(max(greatest(psf_peak_snr, aperture_peak_snr)), 6) as best_snr, round(sum(rank_score), 3) as rank_sum from review_candidates group by 1")
def campaign_totals(t: Tables) -> DataFrame:
    tiers = [F.count_if(F.col("tier") == x).alias(f"tier_{x.lower()}") for x in "ABC"]
    best = F.round(F.max(F.greatest("psf_peak_snr", "aperture_peak_snr")), 6).alias("best_snr")
    return t.view("review_candidates").groupBy("campaign").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("run_name").alias("runs"), F.count_distinct("target_id").alias("targets"), F.count_if("quality_pass").alias("passed"), *tiers,
        F.count_if(F.col("source") == "injected").alias("injected"), F.count_if(F.col("flagged_points_sum") > 0).alias("flagged"), best, F.round(F.sum("rank_score"), 3).alias("rank_sum"),
    )
