"""Challenges for reviewers of spectra: known examples, paired decoys, clean targets, a truth ledger,
anonymous ids, and the scoring of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators import windows

#: Clean targets that a run may give.
CLEAN_A_RUN = 12


def signal_id(run: Column, target: Column) -> Column:
    """A name for a spectrum that says nothing of it."""
    return F.substring(F.sha1(F.concat_ws("::", run, target).cast("binary")), 1, 12)


def _drawn(rows: DataFrame, seed: int, n: int) -> DataFrame:
    """The first n rows in a seeded order, with their place from 0: the order is that of a hash, so it
    doesn't depend on how the rows lie."""
    order = F.sha1(F.concat(F.lit(f"{seed}:"), F.col("signal_id")).cast("binary"))
    top = rows.withColumn("_order", order).orderBy("_order", "signal_id").limit(n)
    # n rows at most
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("_order", "signal_id")) - 1).drop("_order")


def clean_targets(targets: DataFrame, injected: DataFrame, most: int = CLEAN_A_RUN) -> DataFrame:
    """Of every run the targets without injections that have the least share of flagged points, of
    equal ones those with more points; ``targets`` (run_name, target_id, flag_fraction, n_points)."""
    rest = targets.join(injected.select("target_id").distinct(), "target_id", "left_anti")
    return windows.top_n(rest, ["run_name"], [F.col("flag_fraction").asc_nulls_last(), F.col("n_points").desc_nulls_last(), F.col("target_id")], most, F.col("target_id"))


def compose(injected: DataFrame, clean: DataFrame, size: int, known_signals: int = 4, known_clean: int = 4, seed: int = 42) -> DataFrame:
    """A challenge of ``size`` spectra and its examples, one row each with its truth.

    ``injected`` (run_name, target_id, line_nm) of runs named ``_injected``, ``clean`` (run_name,
    target_id). The first known_signals injected ones are shown as examples and never asked; the
    next size // 2 are asked. One in ten of those asked, one at least, are decoys: the baseline
    spectra of the examples' own targets. The rest are clean ones, after known_clean that are shown.
    Asked spectra are shuffled again and named c0000 on; examples p000 and n000 on."""
    half, tenth = size // 2, max(1, size // 10)
    named = lambda df: df.withColumn("signal_id", signal_id(F.col("run_name"), F.col("target_id")))
    signals = _drawn(named(injected), seed, known_signals + half)
    shown = signals.where(F.col("place") < known_signals)
    decoys = shown.where(F.col("place") < tenth).select(
        F.regexp_replace("run_name", "_injected$", "_baseline").alias("run_name"), "target_id", F.lit(None).cast("double").alias("line_nm"), signal_id(F.regexp_replace("run_name", "_injected$", "_baseline"), F.col("target_id")).alias("signal_id"),
        F.col("signal_id").alias("decoy_of"),
    )
    rest = size - half - min(tenth, known_signals)
    quiet = _drawn(named(clean.select("run_name", "target_id")), seed, known_clean + rest).withColumn("line_nm", F.lit(None).cast("double"))
    none = F.lit(None).cast("string").alias("decoy_of")
    cols = ["run_name", "target_id", "line_nm", "signal_id"]
    asked = signals.where(F.col("place") >= known_signals).select(*cols, none).union(decoys.select(*cols, "decoy_of")).union(quiet.where(F.col("place") >= known_clean).select(*cols, none))
    examples = shown.select(*cols, none, F.format_string("p%03d", "place").alias("anon_id"), F.lit("known_signal").alias("role")).union(quiet.where(F.col("place") < known_clean).select(*cols, none, F.format_string("n%03d", "place").alias("anon_id"), F.lit("known_clean").alias("role")))
    order = F.sha1(F.concat(F.lit(f"{seed + 1}:"), F.col("signal_id")).cast("binary"))
    place = F.row_number().over(Window.partitionBy().orderBy(order, "signal_id")) - 1  # as many rows as were asked for
    out = asked.select(*cols, "decoy_of", F.format_string("c%04d", place).alias("anon_id"), F.lit("challenge").alias("role")).union(examples)
    return out.withColumn("is_injected", F.col("line_nm").isNotNull())


def outcomes(answers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Answers (anon_id, signal_like) beside the truth of the spectra asked; an answer to none of them is
    left out, one without a verdict counts as no signal."""
    truth = ledger.where(F.col("role") == "challenge").select("anon_id", "signal_id", "is_injected", "decoy_of", "line_nm")
    said = F.coalesce("signal_like", F.lit(False))
    name = F.when(said & F.col("is_injected"), "injected_correctly_found").when(said, "clean_incorrectly_flagged").when(F.col("is_injected"), "injected_missed").otherwise("clean_correctly_ignored")
    return answers.join(truth, "anon_id").withColumn("outcome", name)
