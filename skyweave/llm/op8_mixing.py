"""Mixing sources to target weights: entropy balancing.

Documents get rates r that stay as close as possible (relative entropy to rate 1) to the
corpus while every source's words meet its target: minimise ``sum r ln r - r`` subject to
``sum size * r = target`` for each source and ``r <= 3``. The convex dual has one multiplier a
source, and its solution is the exponentially tilted rate ``min(3, exp(lambda * size / mean
size))``. Newton steps on the dual run distributed: each is one aggregation over the
(source, size) histogram, kept inside a bracket that shrinks with every step. Rates are rounded
into whole copies by systematic sampling: within a source, documents stand in descending order
of size, and a document takes as many copies as the running total of rates passes whole numbers
in it. Running totals are exact integers, cell by cell and, in large cells, salt by salt, so no
source or size needs one task.

Only DataFrame functions run here. Sums are over integers, so reruns agree to the last copy.

Defined results: a null text has size 0; null is a source of its own, last in order; documents
of size 0 take nothing; rows of equal doc_id are documents of their own; an empty table gives
an empty result; a corpus without words has targets of 0. Other columns are kept by ``mix``,
whose own columns carry the given prefix.

What is gathered: one row per source is ordered in one task (to number the sources and share
the excess); sources are the constraints of a mix. Nothing comes to the driver but one
residual a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.llm.common import WORD_PATTERN, discard, fresh, store, table

#: No document, and so no source, is taken more often than this.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Unit of the fixed-point rates, Newton steps at most, and the residual that ends them.
ONE = 1 << 30
STEPS, RESIDUAL = 40, 1e-9
#: Documents of one (source, size) cell that one task orders, about.
CELL_ROWS = 500


def word_count(column):
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(column):
    """A key without nulls, so that null sources join and group like any other."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column))


def targets(histogram: DataFrame) -> DataFrame:
    """key, source_size, target for each source, from (key, source, size, n).

    With weights w and caps c = 3 * size, the level t solves ``sum min(c, t w) = total``; in
    order of c / w the capped sources come first."""
    per = histogram.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    per = per.withColumn("w", weight).withColumn("cap", MOST * F.col("source_size"))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("w_all", F.sum("w").over(everything))
    # level if this source and all before it are capped, against the next source's cap
    per = per.withColumn("c_before", F.sum("cap").over(filled) - F.col("cap")).withColumn("w_before", F.sum("w").over(filled) - F.col("w"))
    per = per.withColumn("level", (F.col("total") - F.col("c_before")).cast("double") / (F.col("w_all") - F.col("w_before")))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    per = per.withColumn("first_fit", F.min(F.when(fits, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything))
    level = F.col("first_fit.level")
    return per.select("key", "source", "source_size", "docs", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("w"), F.lit(0.0))).alias("target"))


def _rate(multiplier, x):
    return F.least(F.lit(float(MOST)), F.exp(multiplier * x))


def _fixed(value):
    return F.round(value * ONE).cast("long")


def solve(histogram: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """key, mean, multiplier for each source, as a stored table, and its path: Newton steps on the
    dual; a null multiplier means all rates at most."""
    spark = histogram.sparkSession
    mean = F.col("source_size").cast("double") / F.greatest(F.col("docs"), F.lit(1))
    full = (F.col("target") >= MOST * F.col("source_size")) | (F.col("source_size") == 0)
    start = F.when(full, None).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = wanted.select("key", "target", mean.alias("mean"), start.alias("multiplier"), F.lit(-200.0).alias("low"), F.lit(200.0).alias("high"), F.lit(1.0).alias("residual"))
    state, at = store(state, "mixing-state")
    for _ in range(STEPS):
        cells = histogram.where("size > 0").join(state.where("multiplier is not null"), "key")
        x = F.col("size") / F.col("mean")
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        rate = _rate(F.col("multiplier"), x)
        slope = F.when(rate < MOST, x * rate).otherwise(F.lit(0.0))
        # x grows without bound, so its part of the slope is rounded as a smaller unit
        sums = cells.groupBy("key").agg(F.sum(words * _fixed(rate)).alias("f"), F.sum(words * F.round(slope * 1024).cast("long")).alias("g"))
        step = state.join(sums, "key", "left")
        gap = F.col("f").cast("double") / ONE - F.col("target")
        slope_sum = F.col("g").cast("double") / 1024
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = step.select("key", "target", "mean", "multiplier", low.alias("low"), high.alias("high"), gap.alias("gap"), slope_sum.alias("slope"))
        newton = F.col("multiplier") - F.when(F.col("slope") > 0, F.col("gap") / F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        moved = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        relative = F.abs(F.col("gap")) / F.greatest(F.col("target"), F.lit(1.0))
        done = relative <= RESIDUAL
        following = step.select("key", "target", "mean", F.when(F.col("multiplier").isNull() | done, F.col("multiplier")).otherwise(moved).alias("multiplier"), "low", "high", F.coalesce(relative, F.lit(0.0)).alias("residual"))
        last = at
        state, at = store(following, "mixing-state")
        discard(spark, last)
        worst = state.agg(F.max("residual").alias("r")).first()["r"]
        if worst is None or worst <= RESIDUAL:
            break
    return state.select("key", "mean", "multiplier"), at


def mix(docs: DataFrame, prefix: str = "mix_", tie=None, size: Column | None = None) -> DataFrame:
    """``docs`` with its columns and ``<prefix>size, source_size, target, rate, copies``.

    ``tie`` orders rows of equal doc_id, for callers that need the very rows again; ``size`` gives
    the sizes of texts counted before. Where columns begin with the prefix, underscores are added
    to it. The result reads the last work table made here."""
    spark = docs.sparkSession
    p = prefix = fresh(docs, prefix)
    own_size = word_count(F.col("text")) if size is None else size
    order = F.xxhash64(F.col("doc_id"), F.lit("mix"))
    # what needs no text is decided on this slim table: its words are counted once
    slim, at = store(docs.select(source_key(F.col("source")).alias("key"), F.col("source").cast("string").alias("source"), own_size.alias("size"), order.alias("order")), "mixing-sizes")
    histogram, at_cells = store(slim.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-cells")
    wanted, at_targets = store(targets(histogram), "mixing-targets")
    solved, at_state = solve(histogram, wanted)
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("multiplier").isNull(), F.lit(float(MOST))).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("mean")))
    cells = histogram.drop("source").join(wanted.drop("source"), "key").join(solved, "key").withColumn("rate", _fixed(rate))
    before = Window.partitionBy("key").orderBy(F.col("size").desc())
    passed = (F.col("n") * F.col("rate")).cast("decimal(38,0)")
    cells = cells.select("key", "size", "source_size", "target", F.col("rate").alias("fixed"), (F.sum(passed).over(before) - passed).alias("passed"))
    # a cell's documents are ordered salt by salt; so many salts that the largest cell's are small
    salts = -(-(histogram.agg(F.max("n")).first()[0] or 1) // CELL_ROWS)
    parts = slim.groupBy("key", "size", F.pmod("order", F.lit(salts)).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("key", "size").orderBy("salt")) - F.col("n")
    parts = parts.select("key", "size", "salt", earlier.cast("decimal(20,0)").alias("earlier")).join(cells, ["key", "size"])
    parts = parts.select(*(F.col(c).alias(p + c) for c in ("key", "size", "salt", "source_size", "target", "fixed")), (F.col("passed") + F.col("earlier") * F.col("fixed")).alias(f"{p}passed"))
    parts, _ = store(parts, "mixing-parts")
    discard(spark, at, at_cells, at_targets, at_state)
    cell = [f"{p}key", f"{p}size", f"{p}salt"]
    rows = docs.withColumns({f"{p}size": own_size, f"{p}key": source_key(F.col("source")), f"{p}order": order, f"{p}salt": F.pmod(order, F.lit(salts))}).join(parts, cell)
    ties = [F.col(f"{p}order"), F.col("doc_id")] + ([tie] if tie is not None else [])
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(*ties)) - 1
    at = F.col(f"{p}passed") + place.cast("decimal(20,0)") * F.col(f"{p}fixed") + F.lit(ONE // 2)
    rows = rows.withColumn(f"{p}at", at)
    copies = F.floor((F.col(f"{p}at") + F.col(f"{p}fixed")) / ONE) - F.floor(F.col(f"{p}at") / ONE)
    rows = rows.withColumn(f"{p}rate", F.col(f"{p}fixed") / ONE).withColumn(f"{p}copies", copies.cast("long"))
    return rows.select(*docs.columns, *(f"{p}{c}" for c in ("size", "source_size", "target", "rate", "copies")))


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns it came with."""
    prefix = mixed.columns[-1].removesuffix("copies")
    own = [f"{prefix}{c}" for c in ("size", "source_size", "target", "rate", "copies")]
    kept = mixed.where(F.col(f"{prefix}copies") > 0)
    return kept.withColumn(f"{prefix}n", F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies").cast("int")))).drop(f"{prefix}n", *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = store(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")), "mixing-documents")
    mixed = mix(docs, size=F.col("words"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))
