"""Declared table schemas and the checks that every operator starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


#: Bright-star catalog; partitioned by hpx_level and hpx.
STAR_CATALOG = (
    "source_id long, ra double, dec double, ref_epoch double, pmra double, pmdec double, parallax double, parallax_error double, "
    "phot_g_mean_mag double, phot_bp_mean_mag double, phot_rp_mean_mag double, bp_rp double, ruwe double, duplicated_source boolean, astrometric_params_solved int"
)
#: Point-source catalog after canonicalisation.
POINT_SOURCES = (
    "target_id string, target_type string, source_id string, source_catalog string, source_catalog_id string, object_name string, ra_deg double, dec_deg double, "
    "reference_epoch_yr double, parallax_mas double, mag_primary double, mag_primary_band string, priority_score double, target_filter_flags string, "
    "j_m double, h_m double, k_m double, ph_qual string, rd_flg string, cc_flg string, prox double, pts_key long"
)
CANONICAL_TARGET = (
    "target_id string, target_type string, source_id string, object_name string, ra_reference_deg double, dec_reference_deg double, reference_epoch_yr double, "
    "pmra_masyr double, pmdec_masyr double, parallax_mas double, priority_score double, target_filter_flags string"
)
STATUS_EVENT = "time double, event string, image_id string, attempt int, elapsed_sec double, targets_measured long, measurements long, worker_name string, error string, total_fields int, worker_count int"
INJECTION_PLAN = (
    "plan_id string, injections array<struct<injection_id:string,target_id:string,line_family:string,nominal_line_nm:double,injected_line_nm:double,offset_nm:double,"
    "line_width_nm:double,strength_mode:string,find_me_snr:double,line_flux_uJy:double,frames:array<struct<image_id:string,detector:int,line_response:double,status:string,reason:string>>>>"
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def present(df: DataFrame, *names: str) -> list[str]:
    """Those of ``names`` that the table has, in the given order."""
    return [n for n in names if n in df.columns]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are null everywhere: NaN and infinities become null at ingestion."""
    return df.withColumns({f.name: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def provenance_guard(df: DataFrame, expected: str = "spectral_wcs_CWAVE_CBAND") -> DataFrame:
    """Refuse spectra whose wavelengths don't all come from the expected calibration."""
    found = require_columns(df, "wavelength_source").select("wavelength_source").distinct().limit(3).collect()
    if {r[0] for r in found} - {expected}:
        raise ValueError(f"wavelength sources other than {expected}: {sorted(str(r[0]) for r in found)}")
    return df
