"""Catalog scans, sky predicates, samples, identifiers and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import numeric, sky, strings
from skyweave.operators import windows
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query


@query("s1_catalog_scan", "select source_id, round(ra, 9) as ra, round(dec, 9) as dec, round(phot_g_mean_mag, 9) as mag from catalog_sources where phot_g_mean_mag between 8e0 and 17e0 and dec between -20e0 and 30e0 and ra between 40e0 and 200e0 order by phot_g_mean_mag, source_id limit 50")
def catalog_scan(t: Tables) -> DataFrame:
    from skyweave.sources.tables import catalog_cone

    corners = [(40.0, -20.0), (200.0, -20.0), (200.0, 30.0), (40.0, 30.0)]
    # the polygon's upper and right edges are open, as the even-odd rule has it
    got = catalog_cone(t.catalog, corners, "phot_g_mean_mag", 8.0, 17.0, 50)
    return got.select("source_id", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"), F.round("phot_g_mean_mag", 9).alias("mag"))


@query("p2_wrapped_box", "select source_id from catalog_sources where dec between -30e0 and 30e0 and (ra >= 330e0 or ra <= 20e0)")
def wrapped_box(t: Tables) -> DataFrame:
    one = F.lit
    return t.catalog.where(sky.in_box(F.col("ra"), F.col("dec"), one(330.0), one(380.0), one(-30.0), one(30.0))).select("source_id")


@query(
    "p4_point_in_polygon",
    """with e as (select source_id, case when ((10e0 > dec) <> (-30e0 > dec)) and ra < (200e0 - 100e0)*(dec + 30e0)/40e0 + 100e0 then 1 else 0 end + case when ((50e0 > dec) <> (10e0 > dec)) and ra < (120e0 - 200e0)*(dec - 10e0)/40e0 + 200e0 then 1 else 0 end
 + case when ((-30e0 > dec) <> (50e0 > dec)) and ra < (100e0 - 120e0)*(dec - 50e0)/(-80e0) + 120e0 then 1 else 0 end as crossed from catalog_sources) select source_id from e where crossed % 2 = 1""",
)
def point_in_polygon(t: Tables) -> DataFrame:
    v = F.array(*(F.struct(F.lit(a).alias("ra"), F.lit(b).alias("dec")) for a, b in ((100.0, -30.0), (200.0, 10.0), (120.0, 50.0))))
    return t.catalog.where(sky.in_polygon(F.col("ra"), F.col("dec"), v)).select("source_id")


@query("p5_polygon_text", "select frame_id, 4 as vertices, round(ra_low, 6) as first_ra from frames")
def polygon_text(t: Tables) -> DataFrame:
    c = lambda n: F.col(n)
    text = F.format_string("POLYGON ICRS %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f", c("ra_low"), c("dec_low"), c("ra_high"), c("dec_low"), c("ra_high"), c("dec_high"), c("ra_low"), c("dec_high"), c("ra_low"), c("dec_low"))
    v = sky.polygon_vertices(text)
    return t.view("frames").select("frame_id", F.size(v).alias("vertices"), v[0]["ra"].alias("first_ra"))


@query("p6_pixel_of_id", "select source_id, source_id >> 53 as pixel from catalog_sources")
def pixel_of_id(t: Tables) -> DataFrame:
    return t.catalog.select("source_id", sky.pixel_of_source(F.col("source_id"), 3).alias("pixel"))


@query("p7_nested_pixel")
def nested_pixel(t: Tables) -> DataFrame:
    p = t.catalog.select("source_id", "ra", "dec", sky.nested_pixel(F.col("ra"), F.col("dec"), 5).alias("pixel"))
    ra, dec = sky.pixel_center(F.col("pixel"), 5)
    return p.select("source_id", "pixel", sky.separation_deg(F.col("ra"), F.col("dec"), ra, dec).alias("from_center"))


@query("p8_pixel_corners")
def pixel_corners(t: Tables) -> DataFrame:
    """Corners of every pixel that a source of the catalog stands in."""
    pixels = t.catalog.select(sky.nested_pixel(F.col("ra"), F.col("dec"), 3).alias("pixel")).distinct()
    return pixels.select("pixel", sky.pixel_corners(F.col("pixel"), 3).alias("corners"))


@query("p9_map_projection", "select source_id, round((1e0 - ra/360e0)*360e0, 6) as x, round((90e0 - dec)/180e0*180e0, 6) as y from catalog_sources")
def map_projection(t: Tables) -> DataFrame:
    x, y = sky.map_xy(F.col("ra"), F.col("dec"), 360.0, 180.0)
    return t.catalog.select("source_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("p10_square_region", "select source_id, 8 as numbers from catalog_sources")
def square_region(t: Tables) -> DataFrame:
    text = sky.square_polygon(F.col("ra"), F.col("dec"), 0.5)
    return t.catalog.select("source_id", F.size(F.regexp_extract_all(text, F.lit(r"[-+]?\d+\.\d+"), F.lit(0))).alias("numbers"))


@query(
    "p11_proper_motion",
    """with m as (select source_id, ra, dec, pmra*(2000e0 + (61000e0 - 51544.5e0)/365.25e0 - 2016e0)*(pi()/180e0/3600000e0) as e, radians(ra) as a, radians(dec) as d from catalog_sources),
v as (select source_id, cos(d)*cos(a) - e*sin(a) as x, cos(d)*sin(a) + e*cos(a) as y, sin(d) as z from m)
select source_id, round((degrees(atan2(y, x)) + 360e0) % 360e0, 7) as ra_obs_deg, round(degrees(atan2(z, sqrt(x*x + y*y))), 7) as dec_obs_deg from v""",
)
def proper_motion(t: Tables) -> DataFrame:
    moved = sky.propagate(F.col("ra"), F.col("dec"), F.lit(2016.0), F.col("pmra"), F.lit(0.0), F.lit(61000.0))
    return t.catalog.select("source_id", F.round(moved["ra_obs_deg"], 7).alias("ra_obs_deg"), F.round(moved["dec_obs_deg"], 7).alias("dec_obs_deg"))


@query("p16_fatal_bits", "select target_id, count(*) as n from spectra_points where (flags_summary & 2097156) <> 0 group by 1")
def fatal_bits(t: Tables) -> DataFrame:
    return t.points.where(numeric.has_bits(F.col("flags_summary"), [2, 21])).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("p18_id_membership", "select target_id, count(*) as n from spectra_points where target_id in (select target_id from injection_truth where strength >= 8e0) group by 1")
def membership(t: Tables) -> DataFrame:
    return t.points.join(t.truth.where("strength >= 8").select("target_id"), "target_id", "left_semi").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("p20_text_search", "select p_partkey from part where lower(p_name) like '%ring%' or lower(p_type) like '%ring%'")
def text_search(t: Tables) -> DataFrame:
    return t.table("part").where(strings.matches_text([F.col("p_name"), F.col("p_type")], "RING")).select("p_partkey")


@query("p24_tiled_sample")
def tiled_sample(t: Tables) -> DataFrame:
    return windows.tiled_sample(t.catalog.select("source_id", "ra", "dec", "phot_g_mean_mag"), F.col("ra"), F.col("dec"), ["phot_g_mean_mag", "source_id"], 64).select("source_id", "tile")


@query("p25_stratified_sample")
def stratified_sample(t: Tables) -> DataFrame:
    return windows.stratified_sample(t.catalog.select("source_id", "phot_g_mean_mag"), "phot_g_mean_mag", ["phot_g_mean_mag", "source_id"], 60).select("source_id", "stratum")


@query("p26_seeded_sample")
def seeded_sample(t: Tables) -> DataFrame:
    rows = t.catalog.withColumn("bin", F.floor("phot_g_mean_mag"))
    return windows.first_n(rows, ["bin"], [F.xxhash64("source_id", F.lit(42)), F.col("source_id")], 5).select("source_id", "bin")


@query("p27_evenly_spaced", "with r as (select target_id, image_id, cwave_um, row_number() over (partition by target_id order by cwave_um, image_id, detector, aperture_flux_uJy) - 1 as i, count(*) over (partition by target_id) as n from spectra_points), s as (select *, case when n > 24 then (n - 1)/23e0 end as step from r) select target_id, image_id, round(cwave_um, 9) as cwave_um from s where step is null or i = 0 or floor((i + 0.5e0)/step) <> floor((i - 0.5e0)/step)")
def evenly_spaced(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("cwave_um", "image_id", "detector", "aperture_flux_uJy")]
    return windows.evenly_spaced(t.points, ["target_id"], order, 24).select("target_id", "image_id", F.round("cwave_um", 9).alias("cwave_um"))


@query("p27_nearest_points", "select target_id, image_id, round(d, 9) as d from (select target_id, image_id, abs(cwave_um - 1.55e0) as d, row_number() over (partition by target_id order by abs(cwave_um - 1.55e0), image_id, detector, aperture_flux_uJy) as k from spectra_points) where k <= 24")
def nearest_points(t: Tables) -> DataFrame:
    d = F.abs(F.col("cwave_um") - 1.55)
    return windows.nearest_k(t.points.withColumn("d", F.round(d, 9)), ["target_id"], d, [F.col("image_id"), F.col("detector"), F.col("aperture_flux_uJy")], 24).select("target_id", "image_id", "d")


@query("p28_anchor_choice", "select zone, source_id from (select zone, source_id, row_number() over (partition by zone order by case when phot_g_mean_mag between 11e0 and 13e0 then 0 else 1 end, abs(ra - zone*14e0) + 0.15e0*abs(phot_g_mean_mag - 12e0), source_id) as k from catalog_sources) where k = 1")
def anchor_choice(t: Tables) -> DataFrame:
    cost = F.struct(F.when(F.col("phot_g_mean_mag").between(11.0, 13.0), 0).otherwise(1), F.abs(F.col("ra") - F.col("zone") * 14.0) + 0.15 * F.abs(F.col("phot_g_mean_mag") - 12.0), F.col("source_id"))
    return t.catalog.groupBy("zone").agg(F.min_by("source_id", cost).alias("source_id"))


@query("p29_calibration_targets", "select source_id, 'magcal_g' || lpad(cast(g as varchar), 2, '0') || '_' || lpad(cast(k - 1 as varchar), 2, '0') as calibration_id from (select source_id, cast(floor(phot_g_mean_mag) as int) as g, row_number() over (partition by floor(phot_g_mean_mag) order by phot_g_mean_mag, source_id) as k from catalog_sources) where k <= 10")
def calibration_targets(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    g = F.floor("phot_g_mean_mag").cast("int")
    rows = t.catalog.withColumn("g", g).withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("phot_g_mean_mag", "source_id"))).where("k <= 10")
    return rows.select("source_id", F.format_string("magcal_g%02d_%02d", F.col("g"), F.col("k") - 1).alias("calibration_id"))


@query("p30_canonical_rows", "select 'gaia_' || cast(source_id as varchar) as target_id, cast(source_id as varchar) as source_id, round(100e0 - least(phot_g_mean_mag, 99e0), 9) as priority_score from catalog_sources")
def canonical_rows(t: Tables) -> DataFrame:
    sid = F.col("source_id").cast("string")
    return t.catalog.select(F.concat(F.lit("gaia_"), sid).alias("target_id"), sid.alias("source_id"), F.round(100.0 - F.least("phot_g_mean_mag", F.lit(99.0)), 9).alias("priority_score"))


@query("p32_run_names", "select run_name, case when run_name like '%injected' then 'injected' else 'baseline' end as run_kind, regexp_replace(run_name, '_(injected|baseline)$', '') as campaign, 'g11p5_13p0' as mag_bin, cast(k as bigint) as hpx, 64 as nside from (select n_nationkey as k, 'sky_hpx_nside64_nested_' || lpad(cast(n_nationkey as varchar), 8, '0') || '_g11p5_13p0_' || case when n_regionkey % 2 = 0 then 'injected' else 'baseline' end as run_name from nation)")
def run_names(t: Tables) -> DataFrame:
    name = F.concat(F.lit("sky_hpx_nside64_nested_"), F.format_string("%08d", F.col("n_nationkey")), F.lit("_g11p5_13p0_"), F.when(F.col("n_regionkey") % 2 == 0, "injected").otherwise("baseline"))
    rows = t.table("nation").select(name.alias("run_name"))
    return rows.select("run_name", *(c.alias(n) for n, c in strings.run_parts(F.col("run_name")).items()))


@query("p33_provenance", "select o_orderkey, (o_orderpriority <> '1-URGENT' and o_orderstatus = 'O') as injected from orders")
def provenance(t: Tables) -> DataFrame:
    original, path = F.lit("a"), F.when((F.col("o_orderpriority") != "1-URGENT") & (F.col("o_orderstatus") == "O"), "b").otherwise("a")
    return t.table("orders").select("o_orderkey", ((original != "") & (path != original)).alias("injected"))


@query("x10_split_bucket", "select target_id, b as bucket, case when b < 70 then 'train' when b < 85 then 'validation' else 'test' end as split from (select target_id, cast(cast('0x' || substr(sha1(target_id), 1, 8) as bigint) % 100 as bigint) as b from injection_truth)")
def split_bucket(t: Tables) -> DataFrame:
    return t.truth.select("target_id", strings.split_bucket(F.col("target_id")).alias("bucket"), strings.data_split(F.col("target_id")).alias("split"))


@query("x12_sanitise", "select p_partkey, regexp_replace(p_type || ' #' || p_brand, '[^A-Za-z0-9_.+-]', '_', 'g') as a, regexp_replace(p_type || ' #' || p_brand, '[^A-Za-z0-9_.+-]+', '_', 'g') as b from part")
def sanitise(t: Tables) -> DataFrame:
    s = F.concat("p_type", F.lit(" #"), "p_brand")
    return t.table("part").select("p_partkey", strings.sanitise(s).alias("a"), strings.sanitise(s, True).alias("b"))


@query("x13_csv_lists", "select n_nationkey, array_to_string(list_sort(list_distinct(list_concat([n_name, 'x'], ['x', cast(n_regionkey as varchar)]))), ',') as merged from nation")
def csv_lists(t: Tables) -> DataFrame:
    return t.table("nation").select("n_nationkey", strings.csv_union(F.concat("n_name", F.lit(",,x")), F.concat(F.lit("x,"), F.col("n_regionkey").cast("string"))).alias("merged"))


@query("x14_general_format", "select s_suppkey, printf('%g', s_acctbal) as text from supplier where abs(s_acctbal) >= 1")
def general_format(t: Tables) -> DataFrame:
    return t.table("supplier").where(F.abs("s_acctbal") >= 1).select("s_suppkey", numeric.general_format(F.col("s_acctbal")).alias("text"))


@query("x16_base36", f"select o_orderkey, case when o_orderkey = 0 then '0' else ltrim(array_to_string(list_transform({[36**k for k in range(12, -1, -1)]}, lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + cast((o_orderkey // p) % 36 as int), 1)), ''), '0') end as code from orders")
def base36(t: Tables) -> DataFrame:
    return t.table("orders").select("o_orderkey", strings.base36(F.col("o_orderkey")).alias("code"))


@query("x18_json_field", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", F.get_json_object(strings.first_json_object(F.concat(F.lit("note: "), "props")), "$.k").cast("long").alias("k"))


@query("x20_bucket_uri", "select event_id, 's3://b' || json_extract_string(props, '$.k') || '/key' as uri from events")
def uri(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    cloud = F.concat(F.lit('{"aws": {"bucket_name": "b'), k, F.lit('", "key": "key"}}'))
    return t.table("events").select("event_id", strings.bucket_uri(cloud).alias("uri"))


@query("x21_mjd_times", "select n_nationkey, strftime(make_timestamp(cast(round((60000e0 + n_nationkey*1.25e0 - 40587e0)*86400000000e0) as bigint)), '%Y-%m-%dT%H:%M:%S.000') as iso from nation")
def mjd_times(t: Tables) -> DataFrame:
    return t.table("nation").select("n_nationkey", sky.mjd_to_iso(60000.0 + F.col("n_nationkey") * 1.25).alias("iso"))


@query("x23_half_even", "select l_orderkey, l_linenumber, cast(round_even(l_discount*10, 0) as bigint) as scaled, count(*) as n from lineitem group by 1, 2, 3")
def half_even(t: Tables) -> DataFrame:
    return t.table("lineitem").select("l_orderkey", "l_linenumber", numeric.half_even(F.col("l_discount"), 10.0).alias("scaled")).groupBy("l_orderkey", "l_linenumber", "scaled").agg(F.count(F.lit(1)).alias("n"))


@query("x26_reject_reasons", "select s_suppkey, array_to_string(list_filter([case when s_acctbal < 0 then 'negative' end, case when s_acctbal > 5000 then 'large' end, case when s_nationkey = 3 then 'zone' end], lambda x: x is not null), ',') as reasons from supplier")
def reject_reasons(t: Tables) -> DataFrame:
    return t.table("supplier").select("s_suppkey", strings.reasons((F.col("s_acctbal") < 0, "negative"), (F.col("s_acctbal") > 5000, "large"), (F.col("s_nationkey") == 3, "zone")).alias("reasons"))


@query("v12_integer_ranges", "select n_nationkey, [n_nationkey, n_nationkey + 1, n_nationkey + 2, 99] as numbers from nation")
def integer_ranges(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.concat_ws(",", F.concat_ws("-", k.cast("string"), (k + 2).cast("string")), F.lit("99"), k.cast("string"), F.lit("bad"))
    return t.table("nation").select("n_nationkey", strings.integer_ranges(text).alias("numbers"))


@query("v23_float_lists", "select n_nationkey, [n_nationkey*1e0, 2.5e0] as numbers from nation")
def float_lists(t: Tables) -> DataFrame:
    return t.table("nation").select("n_nationkey", strings.float_list(F.concat(F.col("n_nationkey").cast("string"), F.lit(", 2.5,,x"))).alias("numbers"))


WCS_SQL = """with p as (select source_id, radians(ra) as a, radians(dec) as d, radians(180e0) as a0, radians(10e0) as d0 from catalog_sources),
c as (select source_id, sin(d0)*sin(d) + cos(d0)*cos(d)*cos(a - a0) as c, cos(d)*sin(a - a0) as e, cos(d0)*sin(d) - sin(d0)*cos(d)*cos(a - a0) as n from p),
x as (select source_id, degrees(e/c)/(-0.05e0) + 512e0 as x, degrees(n/c)/0.05e0 + 512e0 as y from c where c > 0)
"""


def _projected(t: Tables) -> DataFrame:
    one = F.lit
    wcs = {"crval1": one(180.0), "crval2": one(10.0), "crpix1": one(512.0), "crpix2": one(512.0), "cd11": one(-0.05), "cd12": one(0.0), "cd21": one(0.0), "cd22": one(0.05)}
    x, y = sky.world_to_pixel(F.col("ra"), F.col("dec"), wcs)
    return t.catalog.select("source_id", x.alias("x"), y.alias("y")).where("x is not null")


@query("p12_world_to_pixel", WCS_SQL + "select source_id, round(x, 5) as x_pix, round(y, 5) as y_pix, (x between 1e0 and 1024e0 and y between 1e0 and 1024e0) as in_frame from x")
def world_to_pixel(t: Tables) -> DataFrame:
    return _projected(t).select("source_id", F.round("x", 5).alias("x_pix"), F.round("y", 5).alias("y_pix"), sky.in_frame(F.col("x"), F.col("y"), 1024, 1024).alias("in_frame"))


@query("p14_edge_selection", WCS_SQL + "select source_id, case when least(x, y, 1024e0 - x, 1024e0 - y) >= 8e0 then 'selected' else 'outside_or_edge' end as status from x")
def edge_selection(t: Tables) -> DataFrame:
    d = sky.edge_distance(F.col("x"), F.col("y"), 1024.0, 1024.0)
    return _projected(t).select("source_id", F.when(d >= 8.0, "selected").otherwise("outside_or_edge").alias("status"))


@query("p21_candidate_filter", "select o_orderkey from orders where o_orderstatus in ('F', 'O') and greatest(o_totalprice/1000e0, o_custkey*1e0) >= 100e0 and (o_orderpriority like '%urgent%' or lower(o_orderpriority) like '%high%')")
def candidate_filter(t: Tables) -> DataFrame:
    o = t.table("orders")
    best = F.greatest(F.col("o_totalprice") / 1000.0, F.col("o_custkey").cast("double"))
    return o.where(F.col("o_orderstatus").isin("F", "O") & (best >= 100.0) & strings.matches_text([F.col("o_orderpriority")], "HIGH")).select("o_orderkey")


@query("p31_column_aliases", "select injection_id, line_family as tier, injected_line_nm as peak_line_nm, cast(null as double) as peak_snr from injection_truth")
def column_aliases(t: Tables) -> DataFrame:
    """Candidate tables of other versions: known aliases are renamed, missing columns are null."""
    aliases = {"tier": "line_family", "peak_line_nm": "injected_line_nm", "peak_snr": "score"}
    df = t.truth
    return df.select("injection_id", *((F.col(a) if a in df.columns else F.lit(None).cast("double")).alias(n) for n, a in aliases.items()))


@query("m2_augmented_view")
def augmented_view(t: Tables) -> DataFrame:
    """A random view of each series: a seeded subset of points with noise on the fluxes."""
    draw = lambda k: F.xxhash64("target_id", "image_id", "cwave_um", "aperture_flux_uJy", F.lit(k))
    kept = t.points.where(F.pmod(draw(5), F.lit(100)) < 80)
    # noise from two hashes of the row (Box and Muller), so that reruns agree
    uniform = lambda k: (F.shiftrightunsigned(draw(k), 11) + 0.5) / float(1 << 53)
    noise = F.sqrt(-2.0 * F.log(uniform(6))) * F.cos(2.0 * math.pi * uniform(7))
    return kept.select("target_id", "cwave_um", (F.col("aperture_flux_uJy") + noise * 0.05 * F.col("aperture_flux_unc_uJy")).alias("flux"))


@query("a32_cutout_summary", "select detector, round(quantile_cont(aperture_flux_uJy, 0.1), 5) as p10, round(median(aperture_flux_uJy), 5) as p50, round(quantile_cont(aperture_flux_uJy, 0.9), 5) as p90 from spectra_points group by 1")
def cutout_summary(t: Tables) -> DataFrame:
    p = F.percentile("aperture_flux_uJy", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    got = t.points.groupBy("detector").agg(p.alias("p"))
    return got.select("detector", *(F.round(F.col("p")[k], 5).alias(n) for k, n in enumerate(("p10", "p50", "p90"))))
