"""Recovery of injected lines: support of a target, plans, flags, groups, totals, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.numeric import ratio
from skyweave.functions.strings import remove_suffixes
from skyweave.operators import bands, windows
from skyweave.operators.dataset import example_key

#: Response below which a point doesn't count as support, and the response a line flux is set at.
LEAST_RESPONSE, PLAN_RESPONSE = 1e-3, 0.05


def _usable() -> Column:
    return ~F.coalesce("fatal_flag_present", F.lit(False))


def target_support(points: DataFrame, line_um: float, least: float = LEAST_RESPONSE) -> DataFrame:
    """For each target how many unflagged points respond to a line, the highest response of any
    point, and the median uncertainty of those that support it."""
    rows = points.withColumn("_t", bands.response(F.col("cwave_um"), F.col("cband_um"), F.lit(line_um)))
    good = _usable() & (F.col("_t") >= least)
    return rows.groupBy("target_id").agg(F.count_if(good).alias("usable"), F.max("_t").alias("max_response"), F.median(F.when(good, F.col("aperture_flux_unc_uJy"))).alias("median_unc"))


def find_me_flux(points: DataFrame, line_um: float, snr: float, least: float = PLAN_RESPONSE) -> DataFrame:
    """The line flux at which a target's supporting points reach ``snr`` in the median."""
    rows = points.withColumn("_t", bands.response(F.col("cwave_um"), F.col("cband_um"), F.lit(line_um))).where((F.col("_t") >= least) & _usable())
    return rows.groupBy("target_id").agg(F.median(F.col("aperture_flux_unc_uJy") * snr / F.col("_t")).alias("line_flux"))


def recovery_groups(cases: DataFrame, *keys: str, recovered: str = "recovered", score: str = "score") -> DataFrame:
    """Injections, how many of them were recovered, the share, and the median score of each group.
    An unknown outcome counts as missed, a missing score as 0."""
    hit = F.coalesce(F.col(recovered).cast("boolean"), F.lit(False)).cast("long")
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("injected"), F.sum(hit).alias("recovered"), F.avg(hit.cast("double")).alias("fraction"), F.median(F.coalesce(F.col(score), F.lit(0.0))).alias("median_score"))


def reaggregated(partials: DataFrame, *keys: str, sums: Sequence[str] = (), medians: Sequence[str] = ()) -> DataFrame:
    """Groups of several runs' partial results: sums of sums, and medians of medians."""
    return partials.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.median(c).alias(f"median_of_{c}") for c in medians))


def recovery_totals(runs: DataFrame, *keys: str) -> DataFrame:
    """Totals over runs (injected, recovered, false_positives) with their ratios, null over 0; one
    row without keys, also for no runs."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    t = runs.groupBy(*keys).agg(total("injected"), total("recovered"), total("false_positives"))
    return t.withColumns({"missed": F.col("injected") - F.col("recovered"), "fraction": ratio(F.col("recovered"), F.col("injected")), "false_positives_per_injection": ratio(F.col("false_positives"), F.col("injected"))})


def campaign_metrics(rows: DataFrame, campaign: str, counters: dict[str, Column], totals: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """One row a campaign, folded in one pass: how many rows meet each condition, sums, and distinct
    counts."""
    return rows.groupBy(campaign).agg(
        F.count(F.lit(1)).alias("points"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counters.items()), *(F.sum(c).alias(n) for n, c in totals.items()), *(F.count_distinct(c).alias(n) for n, c in distinct.items())
    )


def truth_map(truth: DataFrame) -> DataFrame:
    """Median injected line by ``run::target``."""
    return truth.groupBy(example_key().alias("run_target")).agg(F.median("injected_line_nm").alias("line_nm"))


def probability_summary(scores: DataFrame, probability: Column, thresholds: dict[str, float]) -> DataFrame:
    """Mean, median and highest probability, and how many reach each threshold."""
    p = scores.select(probability.alias("p"))
    return p.agg(F.avg("p").alias("mean_p"), F.median("p").alias("median_p"), F.max("p").alias("max_p"), *(F.count_if(F.col("p") >= v).alias(n) for n, v in thresholds.items()))


def confusion(rows: DataFrame, predicted: Column, actual: Column, *keys: str) -> DataFrame:
    """Counts of the four outcomes, precision and recall (null over 0); rows where either is unknown
    don't count."""
    c = rows.withColumns({"_p": predicted, "_a": actual}).groupBy(*keys).agg(
        F.count_if(F.col("_p") & F.col("_a")).alias("tp"), F.count_if(F.col("_p") & ~F.col("_a")).alias("fp"), F.count_if(~F.col("_p") & ~F.col("_a")).alias("tn"), F.count_if(~F.col("_p") & F.col("_a")).alias("fn")
    )
    return c.withColumns({"precision_": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def selected_injection(family: Column, line_nm: Column, wanted_family: str, wanted_nm: float, tolerance_nm: float = 10.0) -> Column:
    """Whether a candidate is the selected injection: its family, and within the tolerance."""
    return F.coalesce((family == wanted_family) & (F.abs(line_nm - wanted_nm) <= tolerance_nm), F.lit(False))


def injection_table(recoveries: DataFrame, false_positives: DataFrame, candidates: DataFrame) -> DataFrame:
    """Truth and false positives in one table (columns that one side lacks are null), with the number
    of candidates of each target, 0 where it has none. Candidates are counted before the join."""
    both = recoveries.withColumn("kind", F.lit("truth")).unionByName(false_positives.withColumn("kind", F.lit("false_positive")), allowMissingColumns=True)
    counts = candidates.groupBy("target_id").agg(F.count(F.lit(1)).alias("candidates"))
    return both.join(counts, "target_id", "left").fillna(0, ["candidates"])


def recovered_or_missed(manifest: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    """Every injection of the manifest with its outcome; what the recovery table doesn't have counts
    as missed."""
    found = recovered.select(F.col(key).alias("_key"), "recovered")
    return manifest.join(found, manifest[key] == F.col("_key"), "left").drop("_key").withColumn("recovered", F.coalesce("recovered", F.lit(False)))


def run_pairs(injected: DataFrame, baselines: DataFrame, run: str = "run") -> DataFrame:
    """Injected runs and the baseline run of the same stem."""
    stem = lambda suffix: remove_suffixes(F.col(run), suffix)
    a = injected.where(F.col(run).endswith("_injected")).select(F.col(run).alias("run"), stem("_injected").alias("_stem")).distinct()
    b = baselines.where(F.col(run).endswith("_baseline")).select(F.col(run).alias("baseline"), stem("_baseline").alias("_stem")).distinct()
    return a.join(b, "_stem").drop("_stem")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of equal place in two orders; places are numbered range by range."""
    a, b = windows.ranked(left, left_order, "i"), windows.ranked(right, right_order, "_i")
    return a.join(b, a["i"] == b["_i"]).drop("_i").withColumn("i", F.col("i") - 1)
