"""Queries over the library's small operators, each with its definition in SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import numeric, sky, strings
from skyweave.operators import inference, ml, recovery, runs, spectra, windows
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query
from skyweave.sources import tables


@query("a7_magnitude_bins", """with per as (select c_custkey as target, cast(floor(8e0 + c_custkey % 11) as bigint) as mag_bin, count(o_orderkey) as usable, avg(case when o_orderstatus = 'P' then 1e0 else 0e0 end) as fatal, median(o_totalprice/1000e0) as snr from customer left join orders on c_custkey = o_custkey group by 1, 2)
select mag_bin, count(*) as targets, cast(sum(case when usable >= 5 and fatal <= 0.6e0 and snr >= 2e0 then 1 else 0 end) as bigint) as allowed, round(median(snr), 8) as median_snr, round(median(usable), 3) as median_usable from per group by 1""")
def magnitude_bins(t: Tables) -> DataFrame:
    """Usable targets by magnitude bin: per target first, then per bin."""
    orders = t.table("orders").select(F.col("o_custkey").alias("_key"), "o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1000.0).alias("snr"))
    joined = t.table("customer").select("c_custkey", F.floor(8.0 + F.col("c_custkey") % 11).cast("long").alias("mag_bin")).join(orders, F.col("c_custkey") == F.col("_key"), "left")
    per = joined.groupBy("c_custkey", "mag_bin").agg(F.count("o_orderkey").alias("usable"), F.avg((F.coalesce(F.col("o_orderstatus") == "P", F.lit(False))).cast("double")).alias("fatal"), F.median("snr").alias("snr"))
    got = spectra.magnitude_report(per, "mag_bin", least_usable=5, most_fatal=0.6, least_snr=2.0)
    return got.select("mag_bin", "targets", "allowed", F.round("median_snr", 8).alias("median_snr"), F.round("median_usable", 3).alias("median_usable"))


@query("a8_recovery_by_strength", "with c as (select target_id, line_family, strength, case when cast(substr(target_id, 5) as bigint) % 3 = 0 then 0 else 1 end as recovered from injection_truth) select line_family, strength, count(*) as injected, cast(sum(recovered) as bigint) as recovered, round(avg(recovered*1e0), 9) as fraction, round(median(strength*recovered), 6) as median_score from c group by 1, 2")
def recovery_by_strength(t: Tables) -> DataFrame:
    hit = F.substr("target_id", F.lit(5)).cast("long") % 3 != 0
    cases = t.truth.withColumns({"recovered": hit, "score": F.when(hit, F.col("strength"))})
    return recovery.recovery_groups(cases, "line_family", "strength").withColumns({"fraction": F.round("fraction", 9), "median_score": F.round("median_score", 6)})


@query("a9_reaggregated_partials", "with runs as (select l_suppkey % 7 as run, l_returnflag as family, count(*) as n, median(l_quantity) as m from lineitem group by 1, 2) select family, cast(sum(n) as bigint) as n, round(median(m), 6) as median_of_medians from runs group by 1")
def reaggregated_partials(t: Tables) -> DataFrame:
    runs = t.table("lineitem").groupBy((F.col("l_suppkey") % 7).alias("run"), F.col("l_returnflag").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.median("l_quantity").alias("m"))
    return recovery.reaggregated(runs, "family", sums=["n"], medians=["m"]).select("family", "n", F.round("median_of_m", 6).alias("median_of_medians"))


@query("a10_recovery_totals", "with t as (select count(*) as injected, cast(sum(case when strength >= 8e0 then 1 else 0 end) as bigint) as recovered from injection_truth) select injected, recovered, case when injected > 0 then round(recovered*1e0/injected, 9) end as fraction from t")
def recovery_totals(t: Tables) -> DataFrame:
    runs = t.truth.groupBy("line_family").agg(F.count(F.lit(1)).alias("injected"), F.count_if(F.col("strength") >= 8.0).alias("recovered"), F.lit(0).alias("false_positives"))
    return recovery.recovery_totals(runs).select("injected", "recovered", F.round("fraction", 9).alias("fraction"))


@query("a11_campaign_metrics", "select l_suppkey % 5 as campaign, count(*) as points, count_if(l_returnflag = 'A') as grade_a, count_if(l_returnflag = 'N') as grade_b, count_if(l_returnflag = 'R') as grade_c, count_if(l_linestatus = 'O') as open_points, count(distinct l_orderkey) as frames, round(sum(l_discount), 4) as total_discount from lineitem group by 1")
def campaign_metrics(t: Tables) -> DataFrame:
    c = F.col
    got = recovery.campaign_metrics(
        t.table("lineitem").withColumn("campaign", c("l_suppkey") % 5), "campaign", {"grade_a": c("l_returnflag") == "A", "grade_b": c("l_returnflag") == "N", "grade_c": c("l_returnflag") == "R", "open_points": c("l_linestatus") == "O"},
        {"total_discount": c("l_discount")}, {"frames": c("l_orderkey")},
    )
    return got.withColumn("total_discount", F.round("total_discount", 4))


@query("a12_stage_timing", "select event as stage, count(*) as n, round(sum(value), 4) as total, round(avg(value), 8) as mean, max(value) as most from status_events group by 1")
def stage_timing(t: Tables) -> DataFrame:
    return runs.stage_timing(t.events, "event", "value").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 8)})


@query("a13_stage_status", "select image_id, case when count_if(event = 'field_error') > 0 then 'error' when count_if(event = 'field_start') > count_if(event = 'field_done') then 'active' when count_if(event = 'field_done') = count(*) then 'done' else 'waiting' end as status, count(*) as n from status_events group by 1")
def stage_status(t: Tables) -> DataFrame:
    return runs.stage_status(t.events, "image_id", "event")


@query("a15_distinct_counts", "select count(distinct target_id) as targets, count(distinct observation_id) as visits, count(distinct detector) as detectors, count(distinct image_id) as frames from spectra_points")
def distinct_counts(t: Tables) -> DataFrame:
    return spectra.distinct_counts(t.points, targets="target_id", visits="observation_id", detectors="detector", frames="image_id")


@query("a17_target_support", "select target_id, count_if(not fatal_flag_present and t >= 0.001e0) as usable, round(max(t), 9) as max_response, round(median(case when not fatal_flag_present and t >= 0.001e0 then aperture_flux_unc_uJy end), 6) as median_unc from (select *, exp(-0.5e0*pow((cwave_um - 1.55e0)/(sqrt(cband_um*cband_um + 0.000001e0)/2.354820045e0), 2)) as t from spectra_points) group by 1")
def target_support(t: Tables) -> DataFrame:
    return recovery.target_support(t.points, 1.55).withColumns({"max_response": F.round("max_response", 9), "median_unc": F.round("median_unc", 6)})


@query("a18_find_me_flux", "select target_id, round(median(aperture_flux_unc_uJy*5e0/t), 5) as line_flux from (select *, exp(-0.5e0*pow((cwave_um - 1.55e0)/(sqrt(cband_um*cband_um + 0.000001e0)/2.354820045e0), 2)) as t from spectra_points) where t >= 0.05e0 and not fatal_flag_present group by 1")
def find_me_flux(t: Tables) -> DataFrame:
    return recovery.find_me_flux(t.points, 1.55, 5.0).withColumn("line_flux", F.round("line_flux", 5))


@query("a20_truth_map", "select concat('run', cast(cast(substr(target_id, 5) as bigint) % 3 as string), '::', target_id) as run_target, median(injected_line_nm) as line_nm from injection_truth group by 1")
def truth_map(t: Tables) -> DataFrame:
    runs_of = F.concat(F.lit("run"), (F.substr("target_id", F.lit(5)).cast("long") % 3).cast("string"))
    return recovery.truth_map(t.truth.withColumn("run_name", runs_of))


@query("a21_metadata_stats", "select round(median(ln(1e0 + c_acctbal + 2000e0)), 8) as med, round(stddev_samp(ln(1e0 + c_acctbal + 2000e0)), 8) as sd from customer")
def metadata_stats(t: Tables) -> DataFrame:
    got = ml.metadata_stats(t.table("customer").select(F.ln(1.0 + F.col("c_acctbal") + 2000.0).alias("log_balance")), "log_balance")
    return got.select(F.round("median", 8).alias("med"), F.round("sd", 8).alias("sd"))


@query("a22_probability_summary", "select round(avg(l_discount*10e0), 8) as mean_p, round(median(l_discount*10e0), 8) as median_p, max(l_discount*10e0) as max_p, count_if(l_discount >= 0.01e0) as ge10, count_if(l_discount >= 0.03e0) as ge30, count_if(l_discount >= 0.05e0) as ge50, count_if(l_discount >= 0.07e0) as ge70, count_if(l_discount >= 0.09e0) as ge90 from lineitem")
def probability_summary(t: Tables) -> DataFrame:
    got = recovery.probability_summary(t.table("lineitem"), F.round(F.col("l_discount") * 10.0, 9), {"ge10": 0.1, "ge30": 0.3, "ge50": 0.5, "ge70": 0.7, "ge90": 0.9})
    return got.withColumns({"mean_p": F.round("mean_p", 8), "median_p": F.round("median_p", 8)})


@query("a23_confusion", "with c as (select count_if(quality = 1 and toxic = 0) as tp, count_if(quality = 0 and toxic = 0) as fp, count_if(quality = 0 and toxic = 1) as tn, count_if(quality = 1 and toxic = 1) as fn from labels) select tp, fp, tn, fn, case when tp + fp > 0 then round(tp*1e0/(tp + fp), 9) end as precision_, case when tp + fn > 0 then round(tp*1e0/(tp + fn), 9) end as recall from c")
def confusion(t: Tables) -> DataFrame:
    got = recovery.confusion(t.table("labels"), F.col("toxic") == F.lit(0), F.col("quality") == F.lit(1))
    return got.withColumns({"precision_": F.round("precision_", 9), "recall": F.round("recall", 9)})


@query("a24_cluster_stats", "select label as cluster_id, count(*) as n, median(vec_id) as median_id from embeddings group by 1")
def cluster_stats(t: Tables) -> DataFrame:
    return ml.cluster_statistics(t.table("embeddings").withColumnRenamed("label", "cluster_id"), "cluster_id", {"median_id": "vec_id"})


@query("a27_background_selection", "select target_id, n, med from (select target_id, count_if(not fatal_flag_present) as n, round(median(aperture_flux_unc_uJy), 6) as med from spectra_points group by 1) where n >= 50 order by n desc, target_id limit 12")
def background_selection(t: Tables) -> DataFrame:
    got = spectra.background_selection(t.points, 50, 12)
    return got.select("target_id", "n", F.round("median_unc", 6).alias("med"))


@query("a30_dataset_counts", "select quality, toxic, count(*) as n from labels group by 1, 2")
def dataset_counts(t: Tables) -> DataFrame:
    return ml.dataset_counts(t.table("labels"), "quality", "toxic")


@query("a31_flag_or", "select target_id, bit_or(cast(flags_summary as bigint)) as flags from spectra_points group by 1")
def flag_or(t: Tables) -> DataFrame:
    return spectra.flags_of(t.points)


@query("a33_evidence_summary", "select target_id, count(*) as n, round(min(cwave_um), 9) as lo, round(max(cwave_um), 9) as hi, count_if(fatal_flag_present) as flagged, count(distinct detector) as detectors, round(median(aperture_flux_uJy), 5) as med from spectra_points group by 1")
def evidence_summary(t: Tables) -> DataFrame:
    return spectra.evidence(t.points).withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9), "med": F.round("med", 5)})


@query("v19_stage_share", "select stage, total, round(100e0*total/sum(total) over (), 8) as percent from (select event as stage, round(sum(value), 4) as total from status_events group by 1)")
def stage_share(t: Tables) -> DataFrame:
    timed = runs.stage_timing(t.events, "event", "value").select("stage", F.round("total", 4).alias("total"))
    return runs.shares(timed, "total").withColumn("percent", F.round("percent", 8))


@query("v18_proportional_split", "with s as (select n_regionkey as dev, count(*)*1e0 as rate from nation group by 1), q as (select dev, 1000e0*rate/sum(rate) over () as want from s), f as (select dev, want, floor(want) as base, row_number() over (order by want - floor(want) desc, dev) as k, 1000e0 - sum(floor(want)) over () as rest from q) select dev, cast(base + case when k <= rest then 1 else 0 end as bigint) as share from f")
def proportional_split(t: Tables) -> DataFrame:
    rates = t.table("nation").groupBy(F.col("n_regionkey").alias("dev")).agg(F.count(F.lit(1)).cast("double").alias("rate"))
    return runs.proportional_split(rates, "dev", "rate", 1000)


@query("p1_magnitude_band", "select source_id, round(phot_g_mean_mag, 9) as mag from catalog_sources where phot_g_mean_mag between 9e0 and 12e0")
def magnitude_band(t: Tables) -> DataFrame:
    return tables.magnitude_band(t.catalog, "phot_g_mean_mag", 9.0, 12.0).select("source_id", F.round("phot_g_mean_mag", 9).alias("mag"))


@query("p15_unflagged", "select target_id, count(*) as n from spectra_points where not coalesce(fatal_flag_present, false) group by 1")
def unflagged(t: Tables) -> DataFrame:
    return spectra.unflagged(t.points).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("p17_finite", "select l_orderkey, count(*) as n from lineitem where l_discount > 0 and l_quantity/l_discount < 1000e0 group by 1")
def finite(t: Tables) -> DataFrame:
    value = numeric.finite(numeric.ratio(F.col("l_quantity"), F.col("l_discount")))
    return t.table("lineitem").where((value < 1000.0) & (F.col("l_discount") > 0)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("p19_group_filter", "select target_id, n from (select target_id, count(*) as n from spectra_points group by 1) where n >= 550")
def group_filter(t: Tables) -> DataFrame:
    return windows.groups_of_at_least(t.points, ["target_id"], 550)


@query("p22_shard_pruning", "select target_id, count(*) as n from spectra_points where image_id like 'img_1%' group by 1")
def shard_pruning(t: Tables) -> DataFrame:
    return t.points.where(F.col("image_id").startswith("img_1")).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("o7_heterogeneous_union", "select target_id, 'truth' as origin, strength, cast(null as bigint) as n from injection_truth union all select target_id, 'points', cast(null as double), count(*) from spectra_points group by 1, 2")
def heterogeneous_union(t: Tables) -> DataFrame:
    points = t.points.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    return tables.union_all({"truth": t.truth.select("target_id", "strength"), "points": points}, "origin").select("target_id", "origin", "strength", "n")


@query("o8_set_algebra", "select 'both' as kind, count(*) as n from (select target_id from spectra_points intersect select target_id from injection_truth) union all select 'truth_only', count(*) from (select target_id from injection_truth where strength < 100e0 except select target_id from spectra_points where cwave_um < 1e0)")
def set_algebra(t: Tables) -> DataFrame:
    blue = t.points.where(F.col("cwave_um") < 1.0)
    both = tables.ids_in_both(t.points, t.truth, "target_id").select(F.lit("both").alias("kind"))
    only = tables.ids_only_in(t.truth.where(F.col("strength") < 100.0), blue, "target_id").select(F.lit("truth_only").alias("kind"))
    kinds = t.spark.createDataFrame([("both",), ("truth_only",)], "kind string")
    found = both.union(only).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("o10_plan_grid", "select concat(t.target_id, '_', f.fam, '_', cast(s.strength as string)) as injection_id, t.target_id, f.fam, s.strength, f.nominal + o.off as line_nm, o.off as offset_nm from (select distinct target_id from injection_truth) t cross join (select 'er' as fam, 1550 as nominal union all select 'yb', 1064) f cross join (select 3 as strength union all select 8) s cross join (select -5 as off union all select 5) o")
def plan_grid(t: Tables) -> DataFrame:
    return runs.plan_grid(t.truth.select("target_id").distinct(), {"er": 1550, "yb": 1064}, [3, 8], [-5, 5])


@query("o11_duplicate_groups", "select line_family, injected_line_nm, count(*) as n from injection_truth group by 1, 2 having count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return runs.duplicate_groups(t.truth, "line_family", "injected_line_nm")


@query("o12_batches", "select target_id, cast(floor((row_number() over (order by target_id) - 1)/4e0) as bigint) as batch from injection_truth")
def batches(t: Tables) -> DataFrame:
    return runs.batches(t.truth.select("target_id"), [F.col("target_id")], 4)


@query("w1_point_index", "select target_id, round(cwave_um, 9) as cwave_um, cast(row_number() over (partition by target_id order by cwave_um, image_id, detector, aperture_flux_uJy, psf_flux_uJy) - 1 as bigint) as point_index from spectra_points")
def point_index(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("cwave_um", "image_id", "detector", "aperture_flux_uJy", "psf_flux_uJy")]
    return windows.numbered(t.points, ["target_id"], "cwave_um", 0.05, order, "point_index").select("target_id", F.round("cwave_um", 9).alias("cwave_um"), "point_index")


@query("w2_group_count", "select injection_id, count(*) over (partition by line_family) as n from injection_truth")
def group_count(t: Tables) -> DataFrame:
    return windows.with_group_size(t.truth, ["line_family"], "n").select("injection_id", "n")


@query("x6_flat_distance", "select source_id, round(sqrt(pow((ra - 180e0)*cos(radians(dec)), 2) + dec*dec), 9) as distance from catalog_sources")
def flat_distance(t: Tables) -> DataFrame:
    return t.catalog.select("source_id", F.round(sky.flat_distance(F.col("ra"), F.col("dec"), 180.0, 0.0), 9).alias("distance"))


@query("x7_flux_units", "select target_id, round(sum(aperture_flux_uJy)*23.50443053909789e0/1000000e0, 6) as total from spectra_points group by 1")
def flux_units(t: Tables) -> DataFrame:
    return t.points.groupBy("target_id").agg(F.round(F.sum(numeric.to_micro_jansky(F.col("aperture_flux_uJy"), F.lit(1.0))) / 1e6, 6).alias("total"))


@query("x29_first_value", "select o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), nullif(o_orderstatus, 'O'), 'none') as first_value from orders")
def first_value(t: Tables) -> DataFrame:
    c = F.col
    first = strings.first_known(F.nullif(c("o_orderpriority"), F.lit("1-URGENT")), F.nullif(c("o_orderstatus"), F.lit("O")), default="none")
    return t.table("orders").select("o_orderkey", first.alias("first_value"))


@query("j2_enrichment", "select s.target_id, s.n, coalesce(t.lines, 0) as lines, t.strongest from (select target_id, count(*) as n from spectra_points group by 1) s left join (select target_id, count(*) as lines, max(strength) as strongest from injection_truth where strength >= 5e0 group by 1) t on s.target_id = t.target_id")
def enrichment(t: Tables) -> DataFrame:
    sizes = t.points.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    lines = t.truth.where(F.col("strength") >= 5.0).groupBy("target_id").agg(F.count(F.lit(1)).alias("lines"), F.max("strength").alias("strongest"))
    return tables.enriched(sizes, ["target_id"], lines, zero=["lines"])


@query("j11_selected_injection_flag", "select injection_id, (line_family = 'fam4' and abs(injected_line_nm - 1550e0) <= 10e0) as selected from injection_truth")
def selected_injection_flag(t: Tables) -> DataFrame:
    flag = recovery.selected_injection(F.col("line_family"), F.col("injected_line_nm"), "fam4", 1550.0)
    return t.truth.select("injection_id", flag.alias("selected"))


@query("j12_injection_table", "select u.target_id, u.kind, u.line_nm, coalesce(c.n, 0) as candidates from (select target_id, 'truth' as kind, injected_line_nm as line_nm from injection_truth union all select 'src_' || cast(s_suppkey as string), 'false_positive', 900e0 from supplier where s_suppkey % 4 = 0) u left join (select target_id, count(*) as n from spectra_points where detector = 3 group by 1) c on u.target_id = c.target_id")
def injection_table(t: Tables) -> DataFrame:
    truth = t.truth.select("target_id", F.col("injected_line_nm").alias("line_nm"))
    false = t.table("supplier").where(F.col("s_suppkey") % 4 == 0).select(F.concat(F.lit("src_"), F.col("s_suppkey").cast("string")).alias("target_id"), F.lit(900.0).alias("line_nm"))
    return recovery.injection_table(truth, false, t.points.where(F.col("detector") == 3)).select("target_id", "kind", "line_nm", "candidates")


@query("j13_ml_recovery", "select t.injection_id, max(case when abs(s.line_nm - t.injected_line_nm) <= 100e0 and s.prob >= 0.5e0 then 1 else 0 end) as recovered from injection_truth t left join (select 'src_' || cast(s_suppkey as string) as target_id, 800e0 + 100e0*(s_suppkey % 13) as line_nm, abs(s_acctbal)/10000e0 as prob from supplier) s on s.target_id = t.target_id group by 1")
def ml_recovery(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    scores = t.table("supplier").select(F.concat(F.lit("src_"), key.cast("string")).alias("target_id"), (800.0 + 100.0 * (key % 13)).alias("line_nm"), (F.abs("s_acctbal") / 10000.0).alias("probability"))
    found = inference.recovery(t.truth, scores, 100.0)
    return found.groupBy("injection_id").agg(F.max(F.col("recovered").cast("int")).alias("recovered"))


@query("j14_points_of_kept_targets", "select p.target_id, count(*) as n from spectra_points p where p.target_id in (select target_id from injection_truth where strength >= 8e0) group by 1")
def points_of_kept_targets(t: Tables) -> DataFrame:
    kept = t.truth.where(F.col("strength") >= 8.0)
    return tables.rows_of(t.points, kept, ["target_id"]).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("j15_run_pairs", "select a.run, b.run as baseline from (select distinct 'run' || cast(n_regionkey as string) || '_injected' as run from nation) a join (select distinct 'run' || cast(r_regionkey as string) || '_baseline' as run from region) b on replace(a.run, '_injected', '_baseline') = b.run")
def run_pairs(t: Tables) -> DataFrame:
    named = lambda table, key, kind: t.table(table).select(F.concat(F.lit("run"), F.col(key).cast("string"), F.lit(kind)).alias("run"))
    return recovery.run_pairs(named("nation", "n_regionkey", "_injected"), named("region", "r_regionkey", "_baseline"))


@query("j16_positional_join", "select cast(a.i as bigint) as i, a.name as shown, b.name as truth from (select row_number() over (order by n_name) - 1 as i, 'anon' as name from nation) a join (select row_number() over (order by n_name) - 1 as i, n_name as name from nation) b on a.i = b.i")
def positional_join(t: Tables) -> DataFrame:
    nations = t.table("nation").select("n_name")
    got = recovery.positional_join(nations.select(F.lit("anon").alias("shown"), "n_name"), nations.select(F.col("n_name").alias("truth")), [F.col("n_name")], [F.col("truth")])
    return got.select("i", "shown", "truth")


@query("o2_candidate_page", "select injection_id, strength, injected_line_nm from injection_truth where strength >= 5e0 order by strength desc, injected_line_nm, injection_id limit 25 offset 2")
def candidate_page(t: Tables) -> DataFrame:
    rows = t.truth.where(F.col("strength") >= 5.0).select("injection_id", "strength", "injected_line_nm")
    return windows.page(rows, [F.col("strength").desc(), F.col("injected_line_nm"), F.col("injection_id")], 2, 25)


@query("v5_recovery_fallback", "select injection_id, coalesce(r, false) as recovered from (select injection_id, case when strength >= 8e0 then true end as r from injection_truth)")
def recovery_fallback(t: Tables) -> DataFrame:
    found = t.truth.where(F.col("strength") >= 8.0).select("injection_id", F.lit(True).alias("recovered"))
    return recovery.recovered_or_missed(t.truth, found, "injection_id").select("injection_id", "recovered")


@query("v7_run_progress", "select image_id, case when done = total then 'finished' when done > 0 then 'running' else 'queued' end as phase, round(100e0*done/total, 6) as percent from (select image_id, count_if(event = 'field_done') as done, count(*) as total from status_events group by 1)")
def run_progress(t: Tables) -> DataFrame:
    return runs.progress(t.events, "image_id", F.col("event") == "field_done").withColumn("percent", F.round("percent", 6))


@query("v9_dispatch_state", "select o_orderpriority as command, case when count_if(o_orderstatus = 'P') > 0 then 'active' when count_if(o_orderstatus = 'F') > 0 then 'failed' else 'done' end as state, count(*) as n from orders group by 1")
def dispatch_state(t: Tables) -> DataFrame:
    o = F.col("o_orderstatus")
    return runs.dispatch_state(t.table("orders"), "o_orderpriority", o == "P", o == "F", o == "O")


@query("v11_tile_map", "select r.r_regionkey as tile, coalesce(s.state, 'idle') as state from region r left join (select n_regionkey as tile, 'busy' as state from nation group by 1 having count(*) > 4) s on r.r_regionkey = s.tile")
def tile_map(t: Tables) -> DataFrame:
    busy = t.table("nation").groupBy(F.col("n_regionkey").alias("tile")).agg(F.count(F.lit(1)).alias("n")).where("n > 4").select("tile", F.lit("busy").alias("state"))
    return runs.tile_map(t.table("region").select(F.col("r_regionkey").alias("tile")), busy, "tile")


@query("v14_dispatch_plan", "select concat('tile', cast(r_regionkey as string), '_', b.bin, '_b', cast(k.batch as string)) as command, r_regionkey as tile from region cross join (select 'g11_12' as bin union all select 'g12_13') b cross join (select 0 as batch union all select 1) k")
def dispatch_plan(t: Tables) -> DataFrame:
    bins = t.spark.createDataFrame([("g11_12",), ("g12_13",)], "bin string")
    return runs.dispatch_plan(t.table("region"), "r_regionkey", bins, 2).select("command", "tile")
