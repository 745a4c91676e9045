"""Survey-shaped views over the driver's tables; each text is valid in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPECTRA_POINTS = """
select 'src_' || cast(l_suppkey as string) as target_id, 'img_' || cast(l_orderkey as string) as image_id, l_orderkey % 97 as observation_id, cast(1 + l_linenumber % 6 as int) as detector,
 0.75e0 + 4.25e0 * cast((l_partkey*7919 + l_orderkey*104729 + l_linenumber*31) % 100003 as double) / 100003e0 as cwave_um,
 (0.75e0 + 4.25e0 * cast((l_partkey*7919 + l_orderkey*104729 + l_linenumber*31) % 100003 as double) / 100003e0) / 60e0 as cband_um,
 l_extendedprice as aperture_flux_uJy, 10e0 + 20e0*l_quantity as aperture_flux_unc_uJy, l_extendedprice*(1e0 - l_discount + l_tax) as psf_flux_uJy, 12e0 + 20e0*l_quantity as psf_flux_unc_uJy,
 (l_returnflag = 'R' and l_linenumber <= 3) as fatal_flag_present, case when l_returnflag='R' then 4 else 0 end + case when l_linestatus='O' then 2097152 else 0 end as flags_summary,
 l_shipdate as obs_mid_time, 'spectral_wcs_CWAVE_CBAND' as wavelength_source from lineitem
"""
CATALOG_SOURCES = """
select (c_custkey % 768)*9007199254740992 + c_custkey as source_id, cast((c_custkey*137507764) % 360000000 as double)/1e6 as ra,
 degrees(asin(-1e0 + 2e0*cast((c_custkey*7919) % 10007 as double)/10007e0)) as dec, 8e0 + 11e0*cast((c_custkey*104729) % 10009 as double)/10009e0 as phot_g_mean_mag,
 c_acctbal/100e0 as pmra, c_nationkey as zone from customer
"""
#: One run of injected truth: a line for every supplier, five strengths, six families.
INJECTION_TRUTH = """
select 'inj_' || cast(s_suppkey as string) as injection_id, 'src_' || cast(s_suppkey as string) as target_id, 'fam' || cast(s_suppkey % 6 as string) as line_family,
 case s_suppkey % 6 when 0 then 808e0 when 1 then 980e0 when 2 then 1064e0 when 3 then 1310e0 when 4 then 1550e0 else 2000e0 end as injected_line_nm,
 case s_suppkey % 5 when 0 then 3e0 when 1 then 5e0 when 2 then 8e0 when 3 then 12e0 else 20e0 end as strength from supplier
"""
#: Frames with a sky box each, some over 360 degrees.
FRAMES = """
select 'frame_' || cast(n_nationkey as string) as frame_id, 14.4e0*n_nationkey as ra_low, 14.4e0*n_nationkey + 20e0 as ra_high, -40e0 + 3e0*n_nationkey as dec_low, -20e0 + 3e0*n_nationkey as dec_high from nation
"""
#: Frames with a tangent-plane projection and SIP distortion of third order each, the axes turned and
#: of different size; one for every supplier.
SIP_FRAMES = """
select 'sip_' || cast(s_suppkey as string) as frame_id, cra - 3e0/c as ra_low, cra + 3e0/c as ra_high, cdec - 3e0 as dec_low, cdec + 3e0 as dec_high, cra as crval1, cdec as crval2, 512.5e0 as crpix1, 500e0 as crpix2,
 -5e-3*cos(turn) as cd11, 5e-3*sin(turn) as cd12, 5e-3*sin(turn) as cd21, 5e-3*cos(turn) as cd22, 1024 as naxis1, 1000 as naxis2,
 2e-6*w as a_20, -1e-6 as a_11, 5e-7*w as a_02, 1e-10*w as a_30, 0e0 as a_21, -2e-10 as a_12, 3e-11*w as a_03, -1e-6*w as b_20, 2e-6 as b_11, 1e-6*w as b_02, 0e0 as b_30, 2e-10*w as b_21, -1e-10 as b_12, 4e-11 as b_03
 from (select s_suppkey, cra, cdec, cos(radians(cdec)) as c, radians(cast(s_suppkey % 90 as double)) as turn, cast(s_suppkey % 7 as double) - 3e0 as w
 from (select s_suppkey, cast((s_suppkey*7919) % 360000 as double)/1e3 as cra, -70e0 + 140e0*cast((s_suppkey*6113) % 9973 as double)/9973e0 as cdec from supplier))
"""
#: Images of 24 x 24 pixels, one for every supplier, summed from its line items; a few pixels have none.
PIXEL_VALUES = """
select 'pix_' || cast(l_suppkey as string) as frame_id, cast(floor(cell/24e0) as int) as y, cast(cell % 24 as int) as x, 20e0 + sum(l_extendedprice)/1e4 as value, 1e0 + sum(l_quantity)/50e0 as variance,
 max(case when l_returnflag = 'R' and l_quantity = 7 then 64 else 0 end) + max(case when l_linestatus = 'O' then 2 else 0 end) as flags
 from (select l_suppkey, (l_orderkey*31 + l_partkey*17 + l_linenumber*7) % 576 as cell, l_extendedprice, l_quantity, l_returnflag, l_linestatus from lineitem) group by 1, 2, 3
"""
#: Up to seven targets of each image: one without place, one outside, one at the edge.
PIXEL_TARGETS = """
select 'pix_' || cast(l_suppkey as string) as frame_id, 't' || cast(l_linenumber as string) as target_id, case l_linenumber when 1 then null when 2 then 30e0 when 3 then 1.25e0 else 8e0 + ((l_suppkey*37 + l_linenumber*1013) % 700)/100e0 end as x,
 7e0 + ((l_suppkey*53 + l_linenumber*409) % 900)/100e0 as y from (select distinct l_suppkey, l_linenumber from lineitem)
"""
STATUS_EVENTS = """
select event_id, ts, 'img_' || cast(user_id as string) as image_id,
 case event_type when 'signup' then 'field_start' when 'error' then 'field_error' when 'click' then 'field_retry' when 'purchase' then 'field_done' end as event, value from events where event_type <> 'view'
"""
#: Reviewed candidates of several campaigns, runs and sources, with scores missing here and there.
REVIEW_CANDIDATES = """
select 'jc_' || cast(o_orderkey as string) as joint_candidate_id, 'src_' || cast(o_custkey % 500 as string) as target_id, case o_orderkey % 4 when 0 then 'baseline' when 1 then 'injected' when 2 then 'science' else 'paired_delta' end as source,
 'camp' || cast(o_custkey % 5 as string) as campaign, 'camp' || cast(o_custkey % 7 as string) || '_t' || cast(o_custkey % 11 as string) as run_name, case o_orderstatus when 'F' then 'A' when 'O' then 'B' else 'C' end as tier,
 (o_orderkey % 3 = 0) as quality_pass, case o_orderkey % 5 when 0 then 'high_confidence' when 1 then 'review' else 'reject' end as quality_category, o_totalprice/5000e0 as quality_score, o_totalprice/1000e0 as rank_score,
 case when o_orderkey % 6 <> 0 then 2e0 + ((o_orderkey*7919) % 1000)/10e0 end as psf_peak_snr, case when o_orderkey % 7 <> 0 then 1e0 + ((o_custkey*104729) % 1000)/9e0 end as aperture_peak_snr,
 700e0 + (o_orderkey*31) % 4300 as peak_line_nm, o_orderkey % 6 as psf_support, o_custkey % 6 as aperture_support, o_orderkey % 4 as flagged_points_sum, o_orderpriority as detectors from orders
"""
VIEWS = {"spectra_points": SPECTRA_POINTS, "catalog_sources": CATALOG_SOURCES, "injection_truth": INJECTION_TRUTH, "frames": FRAMES, "status_events": STATUS_EVENTS, "sip_frames": SIP_FRAMES, "pixel_values": PIXEL_VALUES, "pixel_targets": PIXEL_TARGETS, "review_candidates": REVIEW_CANDIDATES}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.view_of(name, self.table(self._base(name)))

    @staticmethod
    def _base(name: str) -> str:
        return VIEWS[name].split(" from ")[-1].split(")")[0].split()[0]

    def view_of(self, name: str, source: DataFrame) -> DataFrame:
        """The view over another table or stream of its base table's columns."""
        base = self._base(name)
        return self.spark.sql(VIEWS[name].replace(f" from {base}", " from {source}"), source=source)

    @property
    def points(self) -> DataFrame:
        return self.view("spectra_points")

    @property
    def catalog(self) -> DataFrame:
        return self.view("catalog_sources")

    @property
    def truth(self) -> DataFrame:
        return self.view("injection_truth")

    @property
    def events(self) -> DataFrame:
        return self.view("status_events")


def with_views(sql: str) -> str:
    """Oracle SQL with the views it names as common table expressions."""
    used = [n for n in VIEWS if n in sql]
    views = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in used)
    if not used:
        return sql
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"
