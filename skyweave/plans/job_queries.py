"""The jobs as queries: each runs twice into one new folder, and the result is what stands there.
Beside them the operators that they are made of: datasets, tensor shards, stage states, index shards."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobs import log_status, training_shards
from skyweave.operators import dataset
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query
from skyweave.session import fresh_folder, stored
from skyweave.streaming import status


def job_config(name: str) -> dict:
    """The config file that lies beside a job."""
    return json.loads((Path(log_status.__file__).parent / f"{name}.json").read_text(encoding="utf-8"))


LOG_STATUS_SQL = r"""
with c as (select cast(doc_id as varchar) as log_id, source as run, lang as stage, coalesce(text, '') as t from documents),
d as (select *, left(t, 8192) as head, right(t, 6000) as tail from c),
l as (select *, contains(head, chr(10)) or contains(tail, chr(10)) as real_log, contains(tail, 'License') or contains(tail, 'Traceback') or contains(tail, 'ERROR') as has_error,
 list_filter(list_transform(string_split_regex(tail, '\r\n|\n|\r'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') as spoken,
 list_filter(list_transform(string_split_regex(head || chr(10) || tail, '\r\n|\n|\r'), lambda x: try_cast(nullif(regexp_extract(x, '^.*?=== ([0-9]{4}-[0-9]{2}-[0-9]{2}[^ ]*)', 1), '') as timestamp)), lambda x: x is not null) as times from d),
b as (select cast(user_id as varchar) as log_id, max(ts) as log_time from events group by 1),
n as (select max(ts) as now from events),
o as (select distinct cast(doc_id as varchar) as log_id from labels where quality is not null and doc_id is not null),
j as (select l.*, b.log_time, case when o.log_id is not null then coalesce(b.log_time, n.now) end as output_time, n.now,
 case when real_log then times[1] end as began from l left join b on l.log_id = b.log_id left join o on l.log_id = o.log_id cross join n),
e as (select *, coalesce(output_time, case when real_log then log_time end) as ended from j)
select log_id, run, stage, length(t) as n_chars, strlen(t) as n_bytes, cast(round_even(length(t)/4e0, 0) as bigint) as tokens_4, cast(round_even(length(t)/3e0, 0) as bigint) as tokens_3, cast(round_even(length(t)/2.5e0, 0) as bigint) as tokens_2p5,
 real_log, has_error, times[1] as start_time, case when real_log then spoken[len(spoken)] end as message, log_time, output_time,
 case when output_time is not null then 'done' when real_log and has_error then 'error' when real_log and coalesce(epoch(now) - epoch(log_time) < 86400, false) then 'active' else 'waiting' end as status,
 case when epoch(ended) - epoch(began) >= 0 then epoch(ended) - epoch(began) end as elapsed_sec from e
"""


@query("job1_log_status", LOG_STATUS_SQL)
def log_board(t: Tables) -> DataFrame:
    config, out = job_config("log_status"), fresh_folder(t.spark, "log-status")
    for _ in range(2):
        board = log_status.run(t.spark, config, f"{t.sf_dir}/documents.parquet", f"{t.sf_dir}/labels.parquet", f"{t.sf_dir}/events.parquet", out)
    return board


TRAINING_SQL = """
with pts as (select 'survey_baseline' as run_name, 'baseline' as run_kind, target_id, substr(target_id, 5) as source_id, image_id, detector, cwave_um as x, aperture_flux_uJy as a, aperture_flux_unc_uJy as u, psf_flux_uJy as p, fatal_flag_present as f, false as inj from spectra_points
 union all select 'survey_injected', 'injected', target_id, null, image_id, detector, cwave_um, aperture_flux_uJy + case when cast(substr(target_id, 5) as bigint) % 3 = 0 then 5e2 else 0e0 end, aperture_flux_unc_uJy, null, fatal_flag_present, cast(substr(target_id, 5) as bigint) % 3 = 0 from spectra_points
 union all select 'wide_shallow', 'unknown', 'cust_' || cast(o_custkey as varchar), 'g' || cast(o_custkey % 40 as varchar), 'ord_' || cast(o_orderkey as varchar), 1, 0.75e0 + 4.25e0*cast((o_orderkey*7919) % 100003 as double)/100003e0, cast(o_totalprice as double), 1000e0, null, null, false from orders),
truth as (select 'survey_injected' as run_name, 'src_' || cast(s_suppkey as varchar) as target_id, case s_suppkey % 4 when 0 then 808e0 when 1 then 1064e0 when 2 then 1550e0 else 5200e0 end as line from supplier where s_suppkey % 3 = 0),
g as (select *, not coalesce(f, false) as fine, coalesce(f, false) as bad from pts),
mid as (select run_name, target_id, median(case when fine then a end) as mg, median(a) as ma from g group by 1, 2),
jag as (select run_name, target_id, median(abs(r)) as jag from (select run_name, target_id, a - 0.5e0*(lag(a) over w + lead(a) over w) as r from g where fine window w as (partition by run_name, target_id order by x, a, p)) group by 1, 2),
s as (select g.run_name, g.target_id, any_value(run_kind) as run_kind, count(*) as n_points, count(case when inj then 1 end) as injected_points, max(source_id) as source_id, count(case when fine then 1 end) as usable, count(case when bad then 1 end)*1e0/count(*) as ff,
 (max(case when fine then x end) - min(case when fine then x end))*1000e0 as span, median(case when fine then abs(a/u) end) as snr, count(case when fine and u > 0 then 1 end) as ns, 1.4826e0*median(case when fine then abs(a - mg) end) as mad, stddev_pop(case when fine then a end) as sd,
 count(case when fine and p is not null then 1 end) as nb, corr(case when fine then a end, case when fine then p end) as corr, median(case when fine and p is not null then abs(a - p)/greatest(abs(a), abs(p)) end) as fd, 1.4826e0*median(abs(a - ma)) as scale_all, any_value(ma) as ma
 from g join mid m on g.run_name = m.run_name and g.target_id = m.target_id group by 1, 2),
q as (select s.*, case when usable < 8 then 0e0 when coalesce(case when mad > 0 then mad when sd > 0 then sd end, 0e0) = 0e0 then 0.5e0 else least(1e0, greatest(0e0, 1e0/(1e0 + greatest(0e0, jag/(case when mad > 0 then mad else sd end))))) end as smooth,
 case when nb >= 8 then least(1e0, greatest(0e0, 0.65e0*least(1e0, greatest(0e0, (corr + 1e0)/2e0)) + 0.35e0/(1e0 + 2e0*fd))) else 0.55e0 end as agree,
 case when ns >= 5 then least(1e0, greatest(0e0, log10(greatest(snr, 1e0))/log10(20e0))) else 0e0 end as ss from s left join jag j on s.run_name = j.run_name and s.target_id = j.target_id),
c as (select *, round(100e0*(0.28e0*least(1e0, greatest(0e0, 1e0 - 2e0*ff)) + 0.24e0*smooth + 0.2e0*least(1e0, usable/80e0) + 0.18e0*agree + 0.1e0*ss), 9) as score,
 usable < 50 or coalesce(span < 4000e0, true) or ff > 0.25e0 or smooth < 0.45e0 or (nb >= 8 and corr < 0.75e0) or (nb >= 8 and fd > 1e0) as hard from q),
k as (select c.*, case when score >= 70e0 and not hard then 'good' when score >= 45e0 and ff <= 0.35e0 and usable >= 25 then 'review' else 'bad' end as category, coalesce(t.n, 0) as injection_count, t.line from c
 left join (select run_name, target_id, count(*) as n, any_value(line) as line from truth group by 1, 2) t on c.run_name = t.run_name and c.target_id = t.target_id),
r as (select *, row_number() over (partition by run_name order by injection_count > 0 desc, score desc, usable desc, target_id) as place from k where category in ('good', 'review', 'bad')),
z as (select *, cast('0x' || substr(sha1(coalesce(source_id, target_id)), 1, 8) as bigint) % 100 as bucket from r where place <= 400 or injection_count > 0),
y as (select *, case when bucket < 70 then 'train' when bucket < 85 then 'validation' else 'test' end as split_id from z),
o as (select run_name, target_id, x, a, u, row_number() over (partition by run_name, target_id order by x, image_id, detector, a, p) as i from pts),
e as (select o.run_name, o.target_id, count(*) as used, round(sum(cast(cast(x as float) as double)), 2) as sum_wave, round(sum(cast(cast(greatest(-50e0, least(50e0, a/u))/50e0 as float) as double)), 2) as sum_ap_snr,
 round(sum(cast(cast(case when scale_all > 0 then greatest(-12e0, least(12e0, (a - ma)/scale_all)) else 0e0 end as float) as double)), 2) as sum_ap_norm from o join y on o.run_name = y.run_name and o.target_id = y.target_id where i <= 384 group by 1, 2 having count(*) >= 8),
h as (select y.run_name, y.target_id, row_number() over (partition by split_id order by sha1(y.run_name || '::' || y.target_id), y.run_name, y.target_id) - 1 as seat from y join e on y.run_name = e.run_name and y.target_id = e.target_id)
select y.run_name, y.target_id, split_id, run_kind, n_points, injected_points, injection_count, injection_count > 0 as is_injected_target, category, round(score, 6) as quality_score, cast(seat // 64 as bigint) as shard, cast(seat % 64 as bigint) as shard_row,
 case when seat is not null then case when line between 700e0 and 5000e0 then 1e0 else 0e0 end end as y, case when seat is not null then round(cast(cast(case when line between 700e0 and 5000e0 then (line - 700e0)/4300e0 else 0e0 end as float) as double), 6) end as line_norm, used, sum_wave, sum_ap_snr, sum_ap_norm
 from y left join e on y.run_name = e.run_name and y.target_id = e.target_id left join h on y.run_name = h.run_name and y.target_id = h.target_id
"""


@query("job2_training_shards", TRAINING_SQL)
def training(t: Tables) -> DataFrame:
    config, out = job_config("training_shards"), fresh_folder(t.spark, "training-shards")
    for _ in range(2):
        manifest = training_shards.run(t.spark, config, t.sf_dir, out)
    return manifest


def _survey(t: Tables) -> tuple[DataFrame, DataFrame, dict]:
    """Points of all runs of the training job's config, and its truth."""
    config = job_config("training_shards")
    points = dataset.all_runs({part["name"]: training_shards.read_part(t.spark, t.sf_dir, part) for part in config["runs"]})
    truth = training_shards.read_part(t.spark, t.sf_dir, config["truth"]).withColumn("run_name", F.lit(config["truth"]["run"]))
    return points, truth, config


@query("m6_dataset", f"select run_name, target_id, split_id, run_kind, n_points, injected_points, injection_count, is_injected_target, category, quality_score from ({TRAINING_SQL})")
def dataset_targets(t: Tables) -> DataFrame:
    """Targets of a dataset over runs of three schemas: quality, caps, one split a source."""
    points, truth, config = _survey(t)
    # the score is stored first: a filter on it would be copied into every later expression
    quality = stored(dataset.quality_of(points), "quality")
    chosen = dataset.select_targets(points, truth, config["categories"], config["most"], quality=quality)
    return chosen.select("run_name", "target_id", "split_id", "run_kind", "n_points", "injected_points", "injection_count", "is_injected_target", "category", F.round("quality_score", 6).alias("quality_score"))


@query("s26_tensor_shards", f"select split_id, shard, count(*) as examples, cast(sum(y) as bigint) as positives, cast(sum(used) as bigint) as used, max(shard_row) as last_row, round(sum(line_norm), 4) as line_norms from ({TRAINING_SQL}) where shard is not null group by 1, 2")
def shard_table(t: Tables) -> DataFrame:
    """Tensor shards written and read back: examples, labels and mask of each."""
    points, truth, config = _survey(t)
    chosen = stored(dataset.select_targets(points, truth, config["categories"], config["most"], quality=stored(dataset.quality_of(points), "quality")), "targets")
    shards = dataset.tensor_shards(dataset.select_points(points, chosen), truth, config["max_points"], config["low_nm"], config["high_nm"], config["shard_rows"])
    out = fresh_folder(t.spark, "tensor-shards")
    dataset.write_shards(shards, out)
    held = t.spark.read.schema(shards.schema).parquet(out)
    used = F.size(F.filter("mask", lambda m: m)).cast("long")
    return held.groupBy("split_id", "shard").agg(F.count(F.lit(1)).alias("examples"), F.sum("y").cast("long").alias("positives"), F.sum(used).alias("used"), F.max("shard_row").alias("last_row"), F.round(F.sum(F.round(F.col("line_norm").cast("double"), 6)), 4).alias("line_norms"))


@query("r5_stage_status", f"select run, case when count(case when status = 'error' then 1 end) > 0 then 'error' when count(case when status = 'active' then 1 end) > 0 then 'active' when count(case when status = 'done' then 1 end) = count(*) then 'done' else 'waiting' end as state, count(*) as stages, count(case when status = 'done' then 1 end) as done, count(case when status = 'error' then 1 end) as error, count(case when status = 'active' then 1 end) as active, count(case when status = 'waiting' then 1 end) as waiting from ({LOG_STATUS_SQL}) group by 1")
def stage_status(t: Tables) -> DataFrame:
    """States of all runs from their stages' logs, outputs and heartbeats, in one batch plan."""
    config = job_config("log_status")
    facts = log_status.facts_of(t.table("documents"), config).withColumn("batch", F.lit(0).cast("long"))
    return status.run_states(log_status.board(facts, t.table("labels"), t.table("events"), config), "run")


@query("r7_index_shards", "select campaign, source, joint_candidate_id, run_name, target_id, tier, quality_pass, round(quality_score, 6) as quality_score, round(rank_score, 6) as rank_score, peak_line_nm from review_candidates")
def index_shards(t: Tables) -> DataFrame:
    """Review index by campaign and source, upserted from a stream; the second start finds nothing
    new and leaves the shards as they are."""
    out = fresh_folder(t.spark, "index")
    for _ in range(2):
        stream = t.view_of("review_candidates", t.spark.readStream.schema(t.table("orders").schema).parquet(f"{t.sf_dir}/orders.parque[t]"))
        status.upsert_shards(stream, out, f"{out}/_checkpoint", "joint_candidate_id", ["rank_score"], ["campaign", "source"]).awaitTermination()
    index = t.spark.read.schema(t.view("review_candidates").schema).parquet(f"{out}/index")
    return index.select("campaign", "source", "joint_candidate_id", "run_name", "target_id", "tier", "quality_pass", F.round("quality_score", 6).alias("quality_score"), F.round("rank_score", 6).alias("rank_score"), "peak_line_nm")
