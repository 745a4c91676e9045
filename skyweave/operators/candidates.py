"""Candidates: joining two lists, tiers, ranks, grades and configured quality rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.numeric import general_format, ratio
from skyweave.functions.strings import csv_items, csv_union, reasons
from skyweave.operators import windows

# Sections, keys and defaults of the published quality rules.
DEFAULT_RULES = {
    "thresholds": {
        "require_both_methods": True, "max_flagged_points_sum": 1, "min_aperture_support": 3, "min_psf_support": 3, "min_detector_count": 1, "min_frame_count": 2, "flux_ratio_psf_aperture_min": 0.3,
        "flux_ratio_psf_aperture_max": 3.0, "max_aperture_peak_snr": 1000.0, "max_psf_peak_snr": 1000.0, "max_cluster_width_nm": 120.0,
    },
    "weights": {
        "base": 0.0, "both_methods_bonus": 25.0, "support_per_point": 4.0, "detector_per_detector": 2.0, "frame_per_frame": 1.0, "snr_log_bonus": 8.0, "flux_ratio_penalty_per_log10": 12.0,
        "flagged_point_penalty": 12.0, "cluster_width_penalty_per_100nm": 5.0, "missing_method_penalty": 60.0, "failed_threshold_penalty": 40.0,
    },
    "categories": {"high_confidence": {"min_quality_score": 70.0, "require_quality_pass": True}, "review": {"min_quality_score": 35.0, "require_quality_pass": False}, "reject": {"max_quality_score": 35.0}},
}


def quality_rules(given: dict | None = None) -> dict:
    """The rules with the given sections over the defaults; unknown sections and keys are errors.
    A threshold of None is not applied."""
    rules: dict = {}
    given = {k: v for k, v in (given or {}).items() if k != "version"}
    for section in given:
        if section not in DEFAULT_RULES:
            raise ValueError(f"unknown section {section} of the quality rules")
    for section, defaults in DEFAULT_RULES.items():
        own = given.get(section) or {}
        for key in own:
            if key not in defaults:
                raise ValueError(f"unknown key {section}.{key} of the quality rules")
        rules[section] = {k: (v | (own.get(k) or {}) if isinstance(v, dict) else own.get(k, v)) for k, v in defaults.items()}
    return rules


_MATCHES = "target_id string, left_id string, right_id string"


def _match_group(target: str, left: list[tuple], right: list[tuple], tolerance: float) -> list[tuple]:
    """Greedy matches of one group; rows are (id, x, score), best first."""
    free, out = list(right), []
    for name, x, _ in left:
        hit = next((k for k, r in enumerate(free) if x is not None and r[1] is not None and abs(r[1] - x) <= tolerance), None)
        out.append((target, name, free.pop(hit)[0] if hit is not None else None))
    return out + [(target, None, r[0]) for r in free]


def greedy_match(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """One-to-one matches of (target_id, id, x, score) rows: left rows in descending score (equal
    ones by id) take the best unused right row within the tolerance; unmatched rows of both
    sides stay, and so do rows without x.

    The choice is sequential, but only among rows that can reach each other: rows of a target
    further apart along x than the tolerance part it into groups. Groups, not targets, are dealt to
    tasks, which walk through their rows group by group."""
    side = lambda df, n: df.select("target_id", "id", F.col("x").cast("double").alias("x"), F.col("score").cast("double").alias("score"), F.lit(n).alias("side"))
    along = Window.partitionBy("target_id").orderBy("x")
    fresh = F.when(F.col("x").isNull(), 1).otherwise(F.coalesce((F.col("x") - F.lag("x").over(along) > tolerance).cast("int"), F.lit(1)))
    rows = side(left, 0).union(side(right, 1)).withColumn("_new", fresh).withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = rows.repartition("target_id", "_group").sortWithinPartitions("target_id", "_group", "side", F.col("score").desc_nulls_last(), "id")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, sides = None, ([], [])
        for batch in batches:
            out = []
            for target, name, x, score, which, number in zip(*(batch[c].tolist() for c in ("target_id", "id", "x", "score", "side", "_group")), strict=True):
                if (target, number) != group:
                    if group:
                        out += _match_group(group[0], *sides, tolerance)
                    group, sides = (target, number), ([], [])
                sides[which].append((name, None if x is None or x != x else x, score))
            yield pd.DataFrame(out, columns=["target_id", "left_id", "right_id"]).astype("object")
        if group:
            yield pd.DataFrame(_match_group(group[0], *sides, tolerance), columns=["target_id", "left_id", "right_id"]).astype("object")

    return dealt.select("target_id", "id", "x", "score", "side", "_group").mapInPandas(match, _MATCHES)


def support_tier(ap: Column, psf: Column, both: Column) -> Column:
    support = F.greatest(ap, psf)
    return F.when((support >= 3) & both, "A").when((support >= 3) | ((support >= 2) & both), "B").when(support >= 2, "C").otherwise("D")


def rank_score() -> Column:
    """Additive rank of a joint candidate."""
    peak = F.greatest(F.coalesce("aperture_peak_snr", F.lit(0.0)), F.coalesce("psf_peak_snr", F.lit(0.0)))
    support = F.greatest(F.coalesce("aperture_support", F.lit(0)), F.coalesce("psf_support", F.lit(0)))
    both = F.col("has_aperture") & F.col("has_psf")
    score = peak + F.least(support, F.lit(5)) * 2.5 + F.when(both, 8.0).otherwise(0.0)
    score = score + F.least(F.size(csv_items(F.col("detectors"))), F.lit(3)) * 1.5 + F.least(F.size(csv_items(F.col("best_frame_ids"))), F.lit(5)) * 0.75
    score = score - F.when(support <= 1, 12.0).otherwise(0.0) - F.least(F.coalesce("flagged_points_sum", F.lit(0)), F.lit(10)) * 2.0
    return score - F.when(F.coalesce("cluster_width_nm", F.lit(0.0)) > 250.0, 5.0).otherwise(0.0)


def line_clusters(hits: DataFrame, kind: str, gap_nm: float) -> DataFrame:
    """Clusters of a scan's hits of one flux, whose lines name their sources: the best line's score and flux,
    the best support, all detectors, and the first 12 images in order of the lines. The scan leaves flagged points out, so none
    is near a line."""
    best = F.struct(F.col("snr"), -F.col("line_nm"))
    in_order = F.array_sort(F.collect_list(F.struct("line_nm", "detectors", "best_frame_ids")))
    c = windows.gap_clusters(hits, ["target_id"], "line_nm", gap_nm, "snr", F.max_by("amp", best).alias("peak_flux"), F.max("support").alias("most"), in_order.alias("lines"))
    items = lambda name: F.array_remove(F.array_distinct(F.flatten(F.col(f"lines.{name}"))), "")
    return c.select(
        F.concat_ws("::", "target_id", F.lit(kind), F.col("cluster_index").cast("string")).alias("cluster_id"), "target_id", F.col("peak_x").alias("peak_line_nm"), F.col("peak_score").alias("peak_snr"), F.col("peak_flux").alias("peak_flux_uJy"), F.col("min_x").alias("line_min_nm"),
        F.col("max_x").alias("line_max_nm"), F.col("most").alias("supporting_points_max"), F.lit(0).alias("flagged_points_sum"), F.array_join(F.array_sort(items("detectors")), ",").alias("detectors"), F.array_join(F.slice(items("best_frame_ids"), 1, 12), ",").alias("best_frame_ids"),
    )


def joint_candidates(aperture: DataFrame, psf: DataFrame, tolerance_nm: float) -> DataFrame:
    """Clusters of both fluxes merged one to one, with tier and rank score, the best tier and then the best
    rank first. An id names the target, the place among all candidates in order of the matching (aperture
    clusters by score, then what is left of the others) and the line."""
    cols = ["cluster_id", "target_id", "peak_line_nm", "peak_snr", "peak_flux_uJy", "line_min_nm", "line_max_nm", "supporting_points_max", "flagged_points_sum", "detectors", "best_frame_ids"]
    short = lambda df: df.select("target_id", F.col("cluster_id").alias("id"), F.col("peak_line_nm").alias("x"), F.col("peak_snr").alias("score"))
    pairs = greedy_match(short(aperture), short(psf), tolerance_nm)
    a = aperture.select(F.col("cluster_id").alias("left_id"), *(F.col(c).alias(f"a_{c}") for c in cols[2:]))
    p = psf.select(F.col("cluster_id").alias("right_id"), *(F.col(c).alias(f"p_{c}") for c in cols[2:]))
    m = pairs.join(a, "left_id", "left").join(p, "right_id", "left")
    lines = F.array_compact(F.array("a_peak_line_nm", "p_peak_line_nm"))
    mean = F.aggregate(lines, F.lit(0.0), lambda x, y: x + y) / F.size(lines)
    m = m.select(
        "target_id", F.col("left_id").alias("aperture_cluster_id"), F.col("right_id").alias("psf_cluster_id"), mean.alias("peak_line_nm"), F.col("left_id").isNotNull().alias("has_aperture"), F.col("right_id").isNotNull().alias("has_psf"),
        F.col("a_peak_snr").alias("aperture_peak_snr"), F.col("p_peak_snr").alias("psf_peak_snr"), F.coalesce("a_supporting_points_max", F.lit(0)).alias("aperture_support"), F.coalesce("p_supporting_points_max", F.lit(0)).alias("psf_support"),
        F.col("a_peak_flux_uJy").alias("aperture_peak_flux_uJy"), F.col("p_peak_flux_uJy").alias("psf_peak_flux_uJy"), ratio(F.col("p_peak_flux_uJy"), F.col("a_peak_flux_uJy")).alias("flux_ratio"), F.least("a_line_min_nm", "p_line_min_nm", mean).alias("line_min_nm"), F.greatest("a_line_max_nm", "p_line_max_nm", mean).alias("line_max_nm"),
        csv_union(F.col("a_detectors"), F.col("p_detectors")).alias("detectors"), F.array_join(F.slice(F.array_union(csv_items(F.col("a_best_frame_ids")), csv_items(F.col("p_best_frame_ids"))), 1, 12), ",").alias("best_frame_ids"),
        (F.coalesce("a_flagged_points_sum", F.lit(0)) + F.coalesce("p_flagged_points_sum", F.lit(0))).alias("flagged_points_sum"),
    ).withColumn("cluster_width_nm", F.col("line_max_nm") - F.col("line_min_nm"))
    m = m.withColumn("tier", support_tier(F.col("aperture_support"), F.col("psf_support"), F.col("has_aperture") & F.col("has_psf"))).withColumn("rank_score", rank_score())
    placed = windows.ranked(m, [F.col("has_aperture").desc(), F.coalesce("aperture_peak_snr", "psf_peak_snr").desc_nulls_last(), F.coalesce("aperture_cluster_id", "psf_cluster_id")], "_place")
    name = F.concat_ws("::", "target_id", F.lit("joint"), (F.col("_place") - 1).cast("string"), general_format(F.col("peak_line_nm")))
    return placed.withColumn("joint_candidate_id", name).drop("_place").orderBy("tier", F.col("rank_score").desc_nulls_last(), "joint_candidate_id")


def configured_quality(joint: DataFrame, rules: dict | None = None) -> DataFrame:
    """Quality score, reasons, pass and category from the sections of ``quality_rules``; one
    generated expression."""
    rules = quality_rules(rules)
    limit, weight = rules["thresholds"], rules["weights"]
    high, review = rules["categories"]["high_confidence"], rules["categories"]["review"]
    both = F.col("has_aperture") & F.col("has_psf")
    ap, psf = F.coalesce("aperture_support", F.lit(0)), F.coalesce("psf_support", F.lit(0))
    support = F.when(both, F.least(ap, psf)).otherwise(F.greatest(ap, psf))
    flags = F.coalesce("flagged_points_sum", F.lit(0))
    detectors, frames = F.size(csv_items(F.col("detectors"))), F.size(csv_items(F.col("best_frame_ids")))
    fr, width = F.col("flux_ratio"), F.coalesce("cluster_width_nm", F.lit(0.0))
    peak = F.greatest(F.coalesce("aperture_peak_snr", F.lit(0.0)), F.coalesce("psf_peak_snr", F.lit(0.0)))
    bad_ratio = fr.isNull() | (fr <= 0)
    over = lambda c, key: c > limit[key] if limit[key] is not None else F.lit(False)
    under = lambda c, key: c < limit[key] if limit[key] is not None else F.lit(False)
    failed = [
        (~both & F.lit(bool(limit["require_both_methods"])), "missing_aperture_or_psf_match"), (over(flags, "max_flagged_points_sum"), "too_many_flagged_points"), (under(ap, "min_aperture_support"), "aperture_support_too_low"),
        (under(psf, "min_psf_support"), "psf_support_too_low"), (under(detectors, "min_detector_count"), "detector_count_too_low"), (under(frames, "min_frame_count"), "frame_count_too_low"),
        (bad_ratio, "flux_ratio_missing_or_invalid"), (~bad_ratio & under(fr, "flux_ratio_psf_aperture_min"), "psf_aperture_flux_ratio_too_low"), (~bad_ratio & over(fr, "flux_ratio_psf_aperture_max"), "psf_aperture_flux_ratio_too_high"),
        (over(F.col("aperture_peak_snr"), "max_aperture_peak_snr"), "aperture_snr_pathologically_high"), (over(F.col("psf_peak_snr"), "max_psf_peak_snr"), "psf_snr_pathologically_high"), (over(width, "max_cluster_width_nm"), "cluster_too_wide"),
    ]
    score = F.lit(float(weight["base"])) + F.when(both, float(weight["both_methods_bonus"])).otherwise(-float(weight["missing_method_penalty"]) if limit["require_both_methods"] else 0.0)
    score = score + support * weight["support_per_point"] + F.least(detectors, F.lit(4)) * weight["detector_per_detector"] + F.least(frames, F.lit(8)) * weight["frame_per_frame"]
    score = score + F.when(peak > 0, F.log10(F.greatest(peak, F.lit(1.0))) * weight["snr_log_bonus"]).otherwise(0.0) - flags * weight["flagged_point_penalty"]
    score = score - F.when(bad_ratio, 2.0).otherwise(F.abs(F.log10(F.when(fr > 0, fr)))) * weight["flux_ratio_penalty_per_log10"] - F.greatest(width, F.lit(0.0)) / 100.0 * weight["cluster_width_penalty_per_100nm"]
    out = joint.withColumn("reject_reasons", reasons(*failed))
    score = score - F.size(csv_items(F.col("reject_reasons"))) * weight["failed_threshold_penalty"]
    out = out.withColumn("quality_score", score).withColumn("quality_pass", F.col("reject_reasons") == "")
    fits = lambda rule: (F.col("quality_score") >= rule["min_quality_score"]) & (F.col("quality_pass") | F.lit(not rule["require_quality_pass"]))
    return out.withColumn("quality_category", F.when(fits(high), "high_confidence").when(fits(review), "review").otherwise("reject"))


def review_grades(candidates: DataFrame, alpha_tier: str = "science_pass") -> DataFrame:
    """S to D grades of narrowband candidates from ordered conditions."""
    counted = candidates.withColumn("target_candidate_count", F.count(F.lit(1)).over(Window.partitionBy("target_id")))
    low = F.greatest(F.least(F.abs("aperture_amp"), F.abs("psf_amp")), F.lit(1e-9))
    counted = counted.withColumn("amp_ratio", F.greatest(F.abs("aperture_amp"), F.abs("psf_amp")) / low)
    science = F.col("tier") == alpha_tier
    failed = [(~science, "p_global_above_alpha"), (F.coalesce("support", F.lit(0)) < 3, "support_below_min"), (F.coalesce("flagged_points_sum", F.lit(0)) > 2, "too_many_flagged_points"), (F.col("target_candidate_count") > 3, "too_many_competing_peaks"), (F.coalesce(F.col("amp_ratio") > 3.0, F.lit(True)), "aperture_psf_ratio_out_of_range")]
    out = counted.withColumn("reject_reasons", reasons(*failed)).withColumn("quality_pass", F.col("reject_reasons") == "")
    s = F.col("quality_pass") & (F.col("p_global") <= 1e-6) & (F.col("joint_rho") >= 8.0) & (F.col("support") >= 5) & (F.coalesce("flagged_points_sum", F.lit(0)) <= 0) & (F.col("target_candidate_count") <= 1) & (F.col("amp_ratio") <= 2.0)
    a = F.col("quality_pass") & (F.col("p_global") <= 1e-4) & (F.col("support") >= 4) & (F.col("target_candidate_count") <= 2)
    return out.withColumn("review_grade", F.when(s, "S").when(a, "A").when(F.col("quality_pass"), "B").when(science, "C").otherwise("D"))


