"""Sequence operators along a series: gaps, peaks, crossings, greedy picks, samples."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import stored


def gap_clusters(df: DataFrame, keys: list[str], x: str, gap: float, score: str, *facts: Column) -> DataFrame:
    """Runs of rows whose neighbours along x are at most ``gap`` apart, with their best row;
    of equal scores the smallest x is best. ``facts`` are further aggregates of a run."""
    w = Window.partitionBy(*keys).orderBy(x)
    new = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(0))
    numbered = df.where(F.col(x).isNotNull() & F.col(score).isNotNull()).withColumn("_new", new).withColumn("cluster_index", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.col(x), F.struct(F.col(score), -F.col(x)))
    return numbered.groupBy(*keys, "cluster_index").agg(
        best.alias("peak_x"), F.max(score).alias("peak_score"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), (F.max(x) - F.min(x)).alias("width"), F.count(F.lit(1)).alias("score_count"), *facts
    )


def neighbour_residual(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``y - (previous + next) / 2`` of inner rows along x."""
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn("residual", F.col(y) - 0.5 * (F.lag(y).over(w) + F.lead(y).over(w))).where("residual is not null")


def up_crossings(df: DataFrame, keys: list[str], x: str, q: str, level: float) -> DataFrame:
    """How often q rises through a level along x, starting from 0; and its maximum."""
    w = Window.partitionBy(*keys).orderBy(x)
    before = F.lag(q, 1, 0.0).over(w)
    return df.withColumn("_up", ((before < level) & (F.col(q) >= level)).cast("long")).groupBy(*keys).agg(F.sum("_up").alias("crossings"), F.max(q).alias("max_q"))


def local_maxima(df: DataFrame, keys: list[str], x: str, q: str) -> DataFrame:
    """Rows not below either neighbour along x; the ends compare with -1."""
    w = Window.partitionBy(*keys).orderBy(x)
    peak = (F.col(q) >= F.lag(q, 1, -1.0).over(w)) & (F.col(q) >= F.lead(q, 1, -1.0).over(w))
    return df.withColumn("is_peak", peak).where("is_peak").drop("is_peak")


def nms_topk(df: DataFrame, keys: list[str], index: str, q: str, k: int, separation: int, least: float = 0.0) -> DataFrame:
    """Greedy picks of local maxima: the best first, of equal ones the later, none within
    ``separation`` of a pick. A fold over the sorted maxima of each series."""
    peaks = local_maxima(df, keys, index, q).where(F.col(q) >= least)
    ordered = peaks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(q).alias("q"), F.col(index).cast("long").alias("i"))), False).alias("_series"))
    picked = ordered.select(*keys, F.posexplode(_greedy(F.col("_series"), k, separation)).alias("_rank", "_pick"))
    return picked.select(*keys, (F.col("_rank") + 1).alias("pick"), F.col("_pick.i").alias(index), F.col("_pick.q").alias(q))


def _greedy(ordered: Column, k: int, separation: int) -> Column:
    """Up to k of a list of (q, i) that is sorted best first, none within ``separation`` of another."""
    none = F.array().cast("array<struct<q:double,i:bigint>>")

    def step(chosen: Column, p: Column) -> Column:
        near = F.exists(chosen, lambda c: F.abs(c["i"] - p["i"]) <= separation)
        return F.when((F.size(chosen) < k) & ~near, F.concat(chosen, F.array(F.struct(p["q"].cast("double").alias("q"), p["i"].alias("i"))))).otherwise(chosen)

    return F.aggregate(ordered, none, step)


# The same steps on whole series, as lists of structs (x, q, ...) in order of x: a target's cells are one
# row, so they are neither shuffled nor sorted one by one.
def list_crossings(cells: str, q: str, level: float) -> Column:
    """``up_crossings`` of a list."""
    rises = F.filter(F.col(cells), lambda c, i: (F.coalesce(F.get(F.col(cells), i - 1)[q], F.lit(0.0)) < level) & (c[q] >= level))
    return F.size(rises).cast("long")


def list_maxima(cells: str, q: str) -> Column:
    """``local_maxima`` of a list."""
    beside = lambda i: F.coalesce(F.get(F.col(cells), i)[q], F.lit(-1.0))
    return F.filter(F.col(cells), lambda c, i: (c[q] >= beside(i - 1)) & (c[q] >= beside(i + 1)))


def list_picks(maxima: str, index: Callable[[Column], Column], q: str, k: int, separation: int, least: float = 0.0) -> Column:
    """The picks of ``nms_topk`` from a list of maxima, as structs (q, i), the best first."""
    good = F.filter(F.col(maxima), lambda c: c[q] >= least)
    return _greedy(F.sort_array(F.transform(good, lambda c: F.struct(c[q].cast("double").alias("q"), index(c).cast("long").alias("i"))), False), k, separation)


def list_nearest(cells: str, x: str, q: str, place: Column, reach: float, most: int) -> Column:
    """Up to ``most`` cells (d, x, q) within ``reach`` of a place, the nearest first."""
    near = F.filter(F.col(cells), lambda c: F.abs(c[x] - place) <= reach)
    return F.slice(F.sort_array(F.transform(near, lambda c: F.struct(F.abs(c[x] - place).alias("d"), c[x].alias(x), c[q].alias(q)))), 1, most)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, salt: Column, salts: int = 64) -> DataFrame:
    """``first_n`` in two steps, first within pieces of each group by a hash of ``salt``: no task
    sees more of a large group than a piece of it, or ``salts`` times n rows."""
    pieces = first_n(df.withColumn("_piece", F.pmod(F.xxhash64(salt), F.lit(salts))), [*keys, "_piece"], order, n)
    return first_n(pieces.drop("_piece"), keys, order, n)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_n(df, keys, order, 1)


def capped(df: DataFrame, keys: list[str], always: Column, order: list[Column], n: int) -> DataFrame:
    """All rows of ``always`` and the best others, up to n a group."""
    w = Window.partitionBy(*keys).orderBy(always.desc(), *order)
    return df.withColumn("_n", F.row_number().over(w)).where(always | (F.col("_n") <= n)).drop("_n")


def point_index(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("point_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """About k rows of each series at even steps, both ends included."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.when(F.col("_n") > k, (F.col("_n") - 1) / (k - 1))
    # row i is taken if some j in 0..k-1 has round(j * step) = i
    taken = F.when(step.isNull(), F.lit(True)).otherwise(F.floor((F.col("_i") + 0.5) / step) != F.floor((F.col("_i") - 0.5) / step))
    return ranked.where(taken | (F.col("_i") == 0)).drop("_i", "_n")


def nearest_k(df: DataFrame, keys: list[str], distance: Column, order: list[Column], k: int) -> DataFrame:
    return first_n(df.withColumn("_d", distance), keys, [F.col("_d"), *order], k).drop("_d")


def tiled_sample(df: DataFrame, x: Column, y: Column, order: list[str], n: int, tiles: int = 4) -> DataFrame:
    """Spread sample: ``max(1, n / tiles^2)`` rows of each tile, the rest filled in global order."""
    box = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    tile = lambda c, a, b: F.least(F.lit(tiles - 1), F.coalesce(F.floor(F.try_divide(c - F.col(a), F.col(b) - F.col(a)) * tiles), F.lit(0)))
    placed = df.crossJoin(F.broadcast(box)).withColumn("tile", (tile(y, "y0", "y1") * tiles + tile(x, "x0", "x1")).cast("int")).drop("x0", "x1", "y0", "y1")
    quota = max(1, n // (tiles * tiles))
    ranked = placed.withColumn("_k", F.row_number().over(Window.partitionBy("tile").orderBy(*order)))
    # no tile can hold more than n of the result, so each keeps its first n before the fill
    ranked = ranked.where(F.col("_k") <= n).withColumn("_picked", F.col("_k") <= quota)
    picked = ranked.where("_picked").orderBy("tile", *order).limit(n)
    fill = ranked.where(~F.col("_picked")).orderBy(*order).limit(n)
    both = picked.withColumn("_o", F.lit(0)).union(fill.withColumn("_o", F.lit(1))).orderBy("_o", *order).limit(n)
    return both.drop("_k", "_picked", "_o")


def stratified_sample(df: DataFrame, value: str, order: list[str], n: int, bins: int = 10) -> DataFrame:
    """Equal bins of a value's range, the same number of each, the rest filled in order."""
    box = df.agg(F.min(value).alias("v0"), F.max(value).alias("v1"))
    stratum = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("v0"), F.col("v1") - F.col("v0")) * bins), F.lit(0)).cast("int"))
    placed = df.crossJoin(F.broadcast(box)).withColumn("stratum", stratum).drop("v0", "v1")
    ranked = placed.withColumn("_k", F.row_number().over(Window.partitionBy("stratum").orderBy(*order))).where(F.col("_k") <= n)
    quota = F.lit(n // bins) + (F.col("stratum") < n % bins).cast("int")
    return ranked.orderBy((F.col("_k") > quota).cast("int"), *order).limit(n).drop("_k")


def numbered_groups(df: DataFrame, keys: list[str], group: Column, order: list[Column], name: str) -> DataFrame:
    """Place from 0 of every row within ``keys``, in ``order``, which must sort by ``group`` first.
    Rows are numbered within (keys, group); a group begins where the counts of those before it end.
    So a key that holds a large part of the table is dealt over as many tasks as it has groups."""
    at = df.withColumn("_group", group)
    counts = at.groupBy(*keys, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_group").alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = at.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_group").orderBy(*order)) - 1)
    same = F.col("_group").eqNullSafe(F.col("_g"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return inside.join(starts, same).withColumn(name, (F.col("_start") + F.col("_i")).cast("long")).drop("_group", "_g", "_start", "_i", *(f"_k_{k}" for k in keys))


def numbered(df: DataFrame, keys: list[str], x: str, width: float, order: list[Column], name: str) -> DataFrame:
    """``numbered_groups`` along a number ``x``, which ``order`` begins with, in pieces of ``width``."""
    return numbered_groups(df, keys, F.floor(F.col(x) / width).cast("long"), order, name)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their place from 1 in a total order. A window without keys would put all
    rows in one task; here they are dealt by range, written once so that ranges stay as they are,
    numbered within each, and shifted by the counts of the ranges before (one row a range)."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_start") + F.col("_i")).cast("long").alias(name))


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100, most: int = 500, least: int = 25) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(least, min(most, limit)))


def groups_of_at_least(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups of at least so many rows, with their size; counted before anything is shuffled."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def with_group_size(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Every row with the size of its group. Sizes are counted apart and joined, so that a large
    group isn't held in one window."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).select(*(F.col(k).alias(f"_k_{k}") for k in keys), name)
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return df.join(sizes, same).drop(*(f"_k_{k}" for k in keys))
