"""Assembly of spectra, summaries and quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skyweave.functions.numeric import MAD_TO_SIGMA, clip01, ratio
from skyweave.functions.strings import reasons
from skyweave.schemas import present, require_columns


def target_summary(points: DataFrame) -> DataFrame:
    """One row a target; null keys are a group of their own."""
    snr = ratio(F.col("aperture_flux_uJy"), F.col("aperture_flux_unc_uJy"))
    return require_columns(points, "target_id", "cwave_um").groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_measurements"), F.min("cwave_um").alias("wavelength_min_um"), F.max("cwave_um").alias("wavelength_max_um"),
        F.median("aperture_flux_uJy").alias("median_flux_uJy"), F.median("psf_flux_uJy").alias("median_psf_flux_uJy"), F.max(snr).alias("max_snr"),
    )


def flag_summary(points: DataFrame) -> DataFrame:
    flag = F.coalesce("fatal_flag_present", F.lit(False)).cast("long")
    return points.groupBy("target_id").agg(F.sum(flag).alias("flagged"), F.count(F.lit(1)).alias("points"), (F.sum(flag) / F.count(F.lit(1))).alias("flag_fraction"))


def paired_delta(injected: DataFrame, baseline: DataFrame) -> DataFrame:
    """Flux differences of one measurement in two runs; each side is first reduced to its first
    row by (target, image)."""
    w = Window.partitionBy("target_id", "image_id").orderBy("cwave_um", "detector", "aperture_flux_uJy", "psf_flux_uJy")
    one = lambda df: df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    b = one(baseline).select("target_id", "image_id", F.col("aperture_flux_uJy").alias("flux_b"), F.col("aperture_flux_unc_uJy").alias("unc_b"), F.col("fatal_flag_present").alias("flag_b"))
    a = one(injected).select("target_id", "image_id", "cwave_um", "cband_um", F.col("aperture_flux_uJy").alias("flux_i"), F.col("aperture_flux_unc_uJy").alias("unc_i"), F.col("fatal_flag_present").alias("flag_i"))
    joined = a.join(b, ["target_id", "image_id"])
    return joined.select(
        "target_id", "image_id", "cwave_um", "cband_um", (F.col("flux_i") - F.col("flux_b")).alias("delta_flux"), F.sqrt(F.col("unc_i") * F.col("unc_i") + F.col("unc_b") * F.col("unc_b")).alias("delta_unc"),
        (F.coalesce("flag_i", F.lit(False)) | F.coalesce("flag_b", F.lit(False))).alias("fatal_flag_present"),
    )


#: What ``series_facts`` tells of a series.
FACTS = "n long, n_flagged long, usable long, span_nm double, median_snr double, n_snr long, _mad double, _sd double, jag double, n_both long, corr double, frac_delta double"


def series_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, medians and moments of every series of (keys, _x, _a, _p, _u, _flag, _good, _both) rows. One
    shuffle and one sort; a batch of many series is worked on at once, and the series at its end
    waits for its other rows."""
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(FACTS)])
    arrow = to_arrow_schema(schema)

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        """Rows, but the first, whose key isn't that of the row before."""
        new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for k in keys:
            one, two = batch.column(k)[:-1], batch.column(k)[1:]
            new |= pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False) | pc.xor(one.is_valid(), two.is_valid()).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new) + 1

    def facts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(held)
        first = np.concatenate([[0], starts(batch)])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in keys), *_facts(batch, group, len(first))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last row held goes before the batch, so that a series ending there is seen
            seen = starts(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch]) if held else batch) - bool(held)
            if len(seen):
                if held or seen[-1]:
                    yield facts([*held, batch.slice(0, seen[-1])])
                held = []
                batch = batch.slice(seen[-1])
            held.append(batch)
        if held:
            yield facts(held)

    # rows sort by a number before they sort by names
    dealt = rows.repartition(*keys).withColumn("_hash", F.xxhash64(*keys)).sortWithinPartitions("_hash", *keys).drop("_hash")
    return dealt.mapInArrow(run, schema)


def _middles(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(median of each group's values, how many they are); NaN counts as the largest number."""
    v, n = values[np.lexsort((values, group))], np.bincount(group, minlength=groups)
    at = np.cumsum(n) - n
    low, high = (np.where(n > 0, np.append(v, 0.0)[np.minimum(at + np.maximum(k, 0), len(v))], 0.0) for k in ((n - 1) // 2, n // 2))
    return 0.5 * low + 0.5 * high, n


def _facts(batch: pa.RecordBatch, group: np.ndarray, groups: int) -> list[pa.Array]:
    """The columns of FACTS for rows whose groups ascend."""
    plain = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    number = lambda c: pc.fill_null(batch.column(c), 0.0).to_numpy(zero_copy_only=False)
    known_p, known_u = (batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("_p", "_u"))
    x, a, p, u = (number(c) for c in ("_x", "_a", "_p", "_u"))
    # in the order of the wavelengths, so that sums don't depend on the order in which rows come
    order = np.lexsort((u, p, known_p, a, x, group))
    x, a, p, u, known_u, good, both, flag = (v[order] for v in (x, a, p, u, known_u, plain("_good"), plain("_both"), plain("_flag")))
    above = lambda v: (v > 0) | np.isnan(v)
    count = lambda m: np.bincount(group[m], minlength=groups)
    total = lambda v, g: np.bincount(g, weights=v, minlength=groups)
    real = lambda v, none: pa.array(v.astype(float), pa.float64(), mask=none)
    with np.errstate(all="ignore"):
        g, along, place = group[good], a[good], x[good]
        mid, n_good = _middles(along, g, groups)
        none, at = n_good == 0, np.cumsum(n_good) - n_good
        span = np.zeros(groups)
        if len(g):
            some = at[~none]
            span[~none] = (np.maximum.reduceat(place, some) - np.fmin.reduceat(place, some)) * 1000.0
        mad, _ = _middles(np.abs(along - mid[g]), g, groups)
        # moments about a value of the series, so that those of equal numbers are exactly 0
        off = along - mid[g]
        off = off - (total(off, g) / n_good)[g]
        sd = np.sqrt(total(off * off, g) / n_good)
        inner = np.flatnonzero(g[2:] == g[:-2]) + 1 if len(g) > 2 else np.zeros(0, dtype=np.int64)
        jag, n_jag = _middles(np.abs(along[inner] - 0.5 * (along[inner - 1] + along[inner + 1])), g[inner], groups)
        sure = good & known_u & above(u)
        snr, n_snr = _middles(np.abs(a[sure] / u[sure]), group[sure], groups)
        n_both, h = count(both), group[both]
        da, dp = (v[both] - v[both][np.searchsorted(h, h)] for v in (a, p))
        da, dp = (v - (total(v, h) / n_both)[h] for v in (da, dp))
        power = total(da * da, h) * total(dp * dp, h)
        corr = total(da * dp, h) / np.sqrt(power)
        larger = np.maximum(np.abs(a), np.abs(p))
        shared = both & above(larger)
        delta, n_delta = _middles(np.abs(a[shared] - p[shared]) / larger[shared], group[shared], groups)
    whole = lambda v: pa.array(v, pa.int64())
    return [
        whole(np.bincount(group, minlength=groups)), whole(count(flag)), whole(n_good), real(span, none), real(snr, n_snr == 0), whole(n_snr), real(mad, none), real(sd, none), real(jag, n_jag == 0), whole(n_both),
        real(corr, (n_both < 2) | (power == 0)), real(delta, n_delta == 0),
    ]


def spectrum_quality(points: DataFrame, *also: str) -> DataFrame:
    """Weighted quality score of each spectrum, its reasons and category. ``also`` names columns that
    tell spectra of one target apart."""
    keys = ["target_id", *also]
    a, p, u, x = (F.col(c) for c in ("aperture_flux_uJy", "psf_flux_uJy", "aperture_flux_unc_uJy", "cwave_um"))
    flag = F.coalesce("fatal_flag_present", F.lit(False))
    good = ~flag & x.isNotNull() & a.isNotNull()
    both = ~flag & a.isNotNull() & p.isNotNull()
    rows = points.select(*keys, *(c.cast("double").alias(n) for c, n in ((x, "_x"), (a, "_a"), (p, "_p"), (u, "_u"))), flag.alias("_flag"), good.alias("_good"), both.alias("_both"))
    q = series_facts(rows, keys)
    q = q.withColumn("scale", F.when(F.col("usable") >= 3, F.when(F.col("_mad") > 0, MAD_TO_SIGMA * F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd"))))
    fraction = F.col("n_flagged") / F.col("n")
    rough = F.col("jag") / F.col("scale")
    smooth = F.when(F.col("usable") < 8, 0.0).when(F.col("scale").isNull(), 0.5).otherwise(clip01(1.0 / (1.0 + F.greatest(rough, F.lit(0.0)))))
    enough = F.col("n_both") >= 8
    corr_score = F.when(F.col("corr").isNotNull(), clip01((F.col("corr") + 1.0) / 2.0)).otherwise(0.55)
    delta_score = F.when(F.col("frac_delta").isNotNull(), 1.0 / (1.0 + 2.0 * F.greatest("frac_delta", F.lit(0.0)))).otherwise(0.55)
    agreement = F.when(enough, clip01(0.65 * corr_score + 0.35 * delta_score)).otherwise(0.55)
    snr_score = F.when(F.col("n_snr") >= 5, clip01(F.log10(F.greatest("median_snr", F.lit(1.0))) / F.log10(F.lit(20.0)))).otherwise(0.0)
    q = q.withColumn("flag_fraction", fraction).withColumn("smoothness", smooth).withColumn("agreement", agreement).withColumn("snr_score", snr_score)
    total = 100.0 * (0.28 * clip01(1.0 - 2.0 * F.col("flag_fraction")) + 0.24 * F.col("smoothness") + 0.20 * clip01(F.col("usable") / 80.0) + 0.18 * F.col("agreement") + 0.10 * F.col("snr_score"))
    hard = [
        (F.col("usable") < 50, "too_few_usable_points"), (F.coalesce(F.col("span_nm") < 4000.0, F.lit(True)), "insufficient_wavelength_span"), (F.col("flag_fraction") > 0.25, "too_many_fatal_flags"),
        (F.col("smoothness") < 0.45, "jagged_or_noisy_continuum"), (enough & (F.col("corr") < 0.75), "low_aperture_psf_shape_agreement"), (enough & (F.col("frac_delta") > 1.0), "large_aperture_psf_flux_disagreement"),
    ]
    q = q.withColumn("score", total).withColumn("hard", reasons(*hard)).withColumn("reasons", reasons(*hard, ((F.col("n_snr") >= 5) & (F.col("median_snr") < 1.0), "low_median_snr")))
    category = F.when((F.col("score") >= 70) & (F.col("hard") == ""), "good").when((F.col("score") >= 45) & (F.col("flag_fraction") <= 0.35) & (F.col("usable") >= 25), "review").otherwise("bad")
    return q.select(*keys, F.col("n").alias("n_measurements"), F.col("usable").alias("n_usable"), "flag_fraction", "smoothness", "agreement", "snr_score", "corr", "frac_delta", "span_nm", "score", category.alias("category"), "reasons")


def quality_gate(points: DataFrame, quality: DataFrame) -> DataFrame:
    """Points of targets that may be searched; the table of targets is a semi-join. A test whose
    column the quality table doesn't have is skipped, and a missing agreement passes."""
    c = F.col
    tests = {
        "category": c("category") == "good", "n_usable": c("n_usable") >= 50, "span_nm": c("span_nm") >= 4000.0,
        "corr": c("corr").isNull() | (c("corr") >= 0.75), "frac_delta": c("frac_delta").isNull() | (c("frac_delta") <= 1.0),
    }
    fine = F.lit(True)
    for name in present(quality, *tests):
        fine = fine & tests[name]
    return points.join(quality.where(fine).select("target_id"), "target_id", "left_semi")


def pack_series(points: DataFrame, *columns: str) -> DataFrame:
    """One row a target with its points as an array sorted by wavelength."""
    return points.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("cwave_um", *columns))).alias("series")).withColumn("length", F.size("series").cast("long"))


def binned_median(points: DataFrame, width_um: float) -> DataFrame:
    """Median spectrum in equal wavelength bins: the middle of each bin's sorted fluxes. The bins are
    small and many, so they are sorted instead of kept as a table of values for each."""
    f = F.col("aperture_flux_uJy")
    rows = points.select("target_id", F.floor(F.col("cwave_um") / width_um).cast("long").alias("bin"), f)
    bins = Window.partitionBy("target_id", "bin")
    placed = rows.withColumns({"_i": F.row_number().over(bins.orderBy(f.asc_nulls_last())), "_n": F.count(f).over(bins)})
    middle = F.when(F.col("_i").between(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1) & f.isNotNull(), f)
    low, high = F.min(middle), F.max(middle)
    return placed.groupBy("target_id", "bin").agg((low + (high - low) * 0.5).alias("median_flux"), F.count(F.lit(1)).alias("n"))


def unflagged(points: DataFrame) -> DataFrame:
    """Points without a fatal flag; an unknown flag is none."""
    return points.where(~F.coalesce("fatal_flag_present", F.lit(False)))


def distinct_counts(points: DataFrame, **named: str) -> DataFrame:
    """Exact distinct counts of several columns, by the name each is to have."""
    return points.agg(*(F.count_distinct(c).alias(n) for n, c in named.items()))


def flags_of(points: DataFrame) -> DataFrame:
    """All pixel flags of each target's points together."""
    return points.groupBy("target_id").agg(F.bit_or(F.col("flags_summary").cast("long")).alias("flags"))


def evidence(points: DataFrame) -> DataFrame:
    """What a reviewer is told of a target: points, wavelength range, flagged points, detectors, median."""
    return points.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("cwave_um").alias("lo"), F.max("cwave_um").alias("hi"), F.count_if(F.coalesce("fatal_flag_present", F.lit(False))).alias("flagged"), F.count_distinct("detector").alias("detectors"), F.median("aperture_flux_uJy").alias("med")
    )


def background_selection(points: DataFrame, least: int, most: int) -> DataFrame:
    """The ``most`` targets with the most unflagged points, of those that have ``least``, with their
    median uncertainty; of equal ones the smaller id."""
    good = ~F.coalesce("fatal_flag_present", F.lit(False))
    counted = points.groupBy("target_id").agg(F.count_if(good).alias("n"), F.median("aperture_flux_unc_uJy").alias("median_unc"))
    return counted.where(F.col("n") >= least).orderBy(F.col("n").desc(), "target_id").limit(most)


def magnitude_report(targets: DataFrame, key: str, least_usable: int = 40, most_fatal: float = 0.6, least_snr: float = 2.0) -> DataFrame:
    """By magnitude bin: targets (usable, fatal, snr), how many of them may be used, and medians. An
    unknown share or snr isn't allowed."""
    allowed = F.coalesce((F.col("usable") >= least_usable) & (F.col("fatal") <= most_fatal) & (F.col("snr") >= least_snr), F.lit(False))
    return targets.groupBy(key).agg(F.count(F.lit(1)).alias("targets"), F.count_if(allowed).alias("allowed"), F.median("snr").alias("median_snr"), F.median("usable").alias("median_usable"))


def score_table(points: DataFrame, kind: str = "aperture") -> DataFrame:
    """Points with the flux that is scored (``aperture`` or ``psf``), numbers by force, mode raw; a table
    without that flux is an error."""
    flux, unc = f"{kind}_flux_uJy", f"{kind}_flux_unc_uJy"
    require_columns(points, "target_id", "image_id", "cwave_um", "cband_um", flux, unc)
    kept = present(points, "target_id", "image_id", "cwave_um", "cband_um", "fatal_flag_present", "detector", "observation_id", "input_file_path", "original_input_file_path", "path_override_applied")
    return points.select(*kept, F.col(flux).try_cast("double").alias("score_flux_uJy"), F.col(unc).try_cast("double").alias("score_flux_unc_uJy"), F.lit("raw_spectrum").alias("score_mode"))


def paired_score_table(injected: DataFrame, baseline: DataFrame) -> DataFrame:
    """The same for flux differences of two runs."""
    d = paired_delta(injected, baseline)
    return d.withColumnsRenamed({"delta_flux": "score_flux_uJy", "delta_unc": "score_flux_unc_uJy"}).withColumn("score_mode", F.lit("paired_delta"))
