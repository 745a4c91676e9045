"""The candidate review: filters, sort orders, recovery and progress tables, binary metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.strings import matches_text
from skyweave.operators import bands, windows

# Source names that mean the same, columns of the text search, and the sort menu.
SOURCE_GROUPS = (("baseline", "uninjected", "science"), ("injected", "injected_raw"), ("paired", "paired_delta"))
TEXT_COLUMNS = ("joint_candidate_id", "target_id", "tier", "detectors", "best_frame_ids", "run_name", "campaign", "target")
SNR_COLUMNS = ("rank_score", "psf_peak_snr", "aperture_peak_snr")
SORTS = {
    "rank": ("rank_score", "psf_peak_snr", "aperture_peak_snr"),
    "snr": ("psf_peak_snr", "aperture_peak_snr", "rank_score"),
    "wave": ("peak_line_nm",),
    "support": ("psf_support", "aperture_support", "rank_score"),
    "flags": ("flagged_points_sum", "rank_score"),
    "quality": ("quality_pass", "quality_score", "rank_score"),
    "target": ("target_id", "peak_line_nm"),
    "run": ("run_name", "rank_score"),
}
ASCENDING = ("peak_line_nm", "flagged_points_sum", "target_id", "run_name")
#: Tile states, the strongest first.
STATES = ("failed", "active", "pending", "done", "idle")


def source_aliases(source: str) -> list[str]:
    if source == "all":
        return [n for group in SOURCE_GROUPS for n in group]
    return next((list(group) for group in SOURCE_GROUPS if source in group), [source])


def of_campaign(campaign: str) -> Column:
    """Rows of a campaign, by its name or by a run name that begins with it."""
    return F.coalesce(F.col("campaign") == campaign, F.lit(False)) | F.coalesce(F.col("run_name").startswith(f"{campaign}_"), F.lit(False))


def filter_candidates(df: DataFrame, source: str = "baseline", campaign: str = "", tier: str = "all", quality: str = "pass", min_snr: float | None = None, text: str = "") -> DataFrame:
    """Candidates under all criteria of the review page; columns that the table lacks don't filter.

    Equalities reach the scan; ``min_snr`` holds for the largest of the scores that are present."""
    have = set(df.columns)
    if source != "all" and "source" in have:
        df = df.where(F.col("source").isin(source_aliases(source)))
    if campaign and "campaign" in have:
        df = df.where(of_campaign(campaign))
    if tier != "all" and "tier" in have:
        df = df.where(F.col("tier") == tier)
    if quality in ("pass", "reject") and "quality_pass" in have:
        df = df.where(F.coalesce("quality_pass", F.lit(False)) == F.lit(quality == "pass"))
    if quality in ("high_confidence", "review") and "quality_category" in have:
        df = df.where(F.col("quality_category") == quality)
    scores = [F.col(c).try_cast("double") for c in SNR_COLUMNS if c in have]
    if min_snr is not None and scores:
        df = df.where((F.greatest(*scores) if len(scores) > 1 else scores[0]) >= min_snr)
    if text.strip():
        df = df.where(matches_text([F.col(c) for c in TEXT_COLUMNS if c in have], text.strip()))
    return df


def sort_order(df: DataFrame, sort: str, tie: str = "joint_candidate_id") -> list[Column]:
    """The order of the menu's ``sort``, nulls last; ties by ``tie``."""
    columns = [c for c in SORTS.get(sort, ("rank_score",)) if c in df.columns]
    return [F.col(c).asc_nulls_last() if c in ASCENDING else F.col(c).desc_nulls_last() for c in columns] + [F.col(tie)]


def candidate_page(df: DataFrame, sort: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of sorted candidates."""
    return df.orderBy(*sort_order(df, sort)).offset(max(0, offset)).limit(min(5000, max(25, limit)))


def strongest_false_positives(df: DataFrame, campaign: str = "", text: str = "", most: int = 50) -> DataFrame:
    """The recovery page's list: rows of a campaign by descending SNR."""
    df = df.where(of_campaign(campaign)) if campaign else df
    df = df.where(matches_text([F.col(c) for c in TEXT_COLUMNS if c in df.columns], text)) if text else df
    snr = F.greatest("psf_peak_snr", "aperture_peak_snr")
    return df.withColumn("max_snr", snr).orderBy(F.col("max_snr").desc_nulls_last(), "joint_candidate_id").limit(most)


def long_fluxes(points: DataFrame, kinds: tuple[str, ...] = ("aperture", "psf")) -> DataFrame:
    """A row for each point and kind of flux, from the columns of each kind."""
    entries = F.array(*(F.struct(F.lit(k).alias("flux_kind"), F.col(f"{k}_flux_uJy").alias("flux"), F.col(f"{k}_flux_unc_uJy").alias("unc")) for k in kinds))
    own = [c for c in points.columns if not any(c in (f"{k}_flux_uJy", f"{k}_flux_unc_uJy") for k in kinds)]
    return points.select(*own, F.inline(entries))


def frame_progress(selected: DataFrame, measured: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Selected targets, done with their first measurement or queued."""
    first = measured.withColumn("_k", F.row_number().over(Window.partitionBy("target_id").orderBy(*order))).where("_k = 1")
    out = selected.join(first.select("target_id", F.lit("done").alias("status"), *columns), "target_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("queued")))


def tile_states(commands: DataFrame) -> DataFrame:
    """Commands (tile_id, state) rolled up by tile: the strongest state, and how many of each."""
    priority = F.coalesce(*(F.when(F.col("state") == s, len(STATES) - k) for k, s in enumerate(STATES)), F.lit(0))
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return commands.groupBy("tile_id").agg(F.max_by("state", F.struct(priority, F.col("state"))).alias("status"), F.count(F.lit(1)).alias("campaigns"), *counts)


def binary_metrics(rows: DataFrame, label: Column, probability: Column) -> DataFrame:
    """Counts and fractions of a two-class decision at one half; one row."""
    hit, real = F.coalesce(probability >= 0.5, F.lit(False)), F.coalesce(label >= 0.5, F.lit(False))
    got = rows.agg(
        F.count_if(real).alias("injected_total"), F.count_if(~real).alias("baseline_total"), F.count_if(hit & real).alias("injected_recovered"), F.count_if(~hit & real).alias("injected_missed"),
        F.count_if(~hit & ~real).alias("baseline_correct"), F.count_if(hit & ~real).alias("baseline_false_alarms"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return got.withColumns({"injected_recovered_fraction": share("injected_recovered", "injected_total"), "baseline_false_alarm_fraction": share("baseline_false_alarms", "baseline_total")})


def best_near(candidates: DataFrame, wanted_nm: float, tolerance_nm: float = 5.0) -> DataFrame:
    """Each target's best candidate (peak_nm, score, candidate_id): of those within the tolerance if
    there are any, else of all; the highest score, of equal ones the smaller id."""
    near = F.coalesce(F.abs(F.col("peak_nm") - wanted_nm) <= tolerance_nm, F.lit(False))
    return windows.keep_first(candidates, ["target_id"], [near.desc(), F.col("score").desc_nulls_last(), F.col("candidate_id")])


def inspection(points: DataFrame, best: DataFrame, window_um: float = 0.18, most: int = 5, least: float = 1e-3) -> DataFrame:
    """Points around each target's line with their response to it, and whether they are among the
    ``most`` that support it. Points outside the window go before anything is ranked."""
    line = F.col("peak_nm") / 1000.0
    near = points.join(best, "target_id").where(F.abs(F.col("cwave_um") - line) <= window_um).withColumn("line_response", bands.response(F.col("cwave_um"), F.col("cband_um"), line))
    order = [F.round("line_response", 12).desc(), *(F.col(c) for c in ("image_id", "cwave_um", "detector", "aperture_flux_uJy"))]
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(*order))
    return near.withColumn("is_support", (place <= most) & (F.col("line_response") >= least))
