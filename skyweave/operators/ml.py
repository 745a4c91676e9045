"""Features, splits, similarity and models for the machine-learning tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.numeric import MAD_TO_SIGMA, clip, log10_positive, ratio
from skyweave.functions.strings import data_split

FEATURES = ("wave", "band", "ap_norm", "psf_norm", "ap_snr", "psf_snr", "log_ap_unc", "log_psf_unc", "agreement", "flag", "detector", "wave_fraction", "delta_norm")


def point_features(points: DataFrame, *keep: str) -> DataFrame:
    """Thirteen features a point; fluxes are normalised by each series' median and robust scale.
    ``keep`` names further columns to pass through."""
    w = Window.partitionBy("target_id")
    m = points.withColumns({"_ma": F.median("aperture_flux_uJy").over(w), "_mp": F.median("psf_flux_uJy").over(w), "_w0": F.min("cwave_um").over(w), "_w1": F.max("cwave_um").over(w)})
    m = m.withColumns({"_sa": MAD_TO_SIGMA * F.median(F.abs(F.col("aperture_flux_uJy") - F.col("_ma"))).over(w), "_sp": MAD_TO_SIGMA * F.median(F.abs(F.col("psf_flux_uJy") - F.col("_mp"))).over(w)})
    norm = lambda c, mid, scale: F.coalesce(clip(ratio(F.col(c) - F.col(mid), F.col(scale)), -12.0, 12.0), F.lit(0.0))
    snr = lambda f, u: F.when(F.col(u) > 0, clip(ratio(F.col(f), F.col(u)), -50.0, 50.0) / 50.0).otherwise(0.0)
    values = [
        F.col("cwave_um"), F.col("cband_um"), norm("aperture_flux_uJy", "_ma", "_sa"), norm("psf_flux_uJy", "_mp", "_sp"), snr("aperture_flux_uJy", "aperture_flux_unc_uJy"), snr("psf_flux_uJy", "psf_flux_unc_uJy"),
        F.coalesce(log10_positive(F.col("aperture_flux_unc_uJy")), F.lit(0.0)), F.coalesce(log10_positive(F.col("psf_flux_unc_uJy")), F.lit(0.0)), F.coalesce(ratio(F.abs(F.col("aperture_flux_uJy") - F.col("psf_flux_uJy")), F.greatest(F.abs("aperture_flux_uJy"), F.abs("psf_flux_uJy"))), F.lit(0.0)),
        F.coalesce("fatal_flag_present", F.lit(False)).cast("double"), F.coalesce(F.col("detector").cast("double"), F.lit(0.0)), F.coalesce(ratio(F.col("cwave_um") - F.col("_w0"), F.col("_w1") - F.col("_w0")), F.lit(0.0)),
        norm("aperture_flux_uJy", "_ma", "_sa") - norm("psf_flux_uJy", "_mp", "_sp"),
    ]
    return m.select("target_id", "image_id", "cwave_um", *keep, F.array(*(v.cast("float") for v in values)).alias("features"))


def padded_series(features: DataFrame, most: int) -> DataFrame:
    """Series of fixed length with a mask; points in order of wavelength, the rest zeros."""
    width = len(FEATURES)
    s = features.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("cwave_um", "image_id", "features"))).alias("s"))
    taken = F.slice(F.col("s.features"), 1, most)
    missing = F.greatest(F.lit(most) - F.size("s"), F.lit(0))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), missing)
    return s.select("target_id", F.concat(taken, zeros).alias("x"), F.concat(F.array_repeat(F.lit(True), F.least(F.size("s"), F.lit(most))), F.array_repeat(F.lit(False), missing)).alias("mask"))


def split_targets(targets: DataFrame, source: str, target: str) -> DataFrame:
    """70/15/15 by source: all targets of one source fall on one side."""
    return targets.withColumn("split", data_split(F.coalesce(F.col(source).cast("string"), F.col(target).cast("string"))))


def scaled(c: Column, median: Column, sd: Column, bound: float = 6.0) -> Column:
    return clip(ratio(F.coalesce(c, median) - median, F.when(sd > 0, sd).otherwise(1.0)), -bound, bound)


def cosine_top_k(vectors: DataFrame, key: str, vector: str, wanted, k: int = 25) -> DataFrame:
    """The k vectors most similar to one of the table; ties by key."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = vectors.where(F.col(key) == wanted).limit(1).select(F.col(vector).alias("_q"))
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    scored = vectors.crossJoin(F.broadcast(q)).withColumn("similarity", dot(F.col(vector), F.col("_q")) / (norm(F.col(vector)) * norm(F.col("_q"))))
    return scored.select(key, "similarity").orderBy(F.col("similarity").desc(), key).limit(max(5, min(250, k)))


def cluster_and_project(vectors: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """K-means clusters and a two-dimensional principal-component projection."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n = k or max(2, min(64, rows.count() // 20))
    labelled = KMeans(k=n, seed=seed, maxIter=10, featuresCol="features", predictionCol="cluster_id").fit(rows).transform(rows)
    plane = PCA(k=2, inputCol="features", outputCol="xy").fit(rows).transform(labelled)
    xy = vector_to_array("xy")
    return plane.select(key, "cluster_id", xy[0].alias("x"), xy[1].alias("y"))


def metadata_stats(rows: DataFrame, column: str) -> DataFrame:
    """Median and sample deviation of a column, one row."""
    return rows.agg(F.median(column).alias("median"), F.stddev_samp(column).alias("sd"))


def cluster_statistics(rows: DataFrame, cluster: str, medians: dict[str, str]) -> DataFrame:
    """Members of each cluster and the medians of some columns, by the name each is to have."""
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *(F.median(c).alias(n) for n, c in medians.items()))


def dataset_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Examples of each combination of the keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def export_embeddings(vectors: DataFrame, key: str, vector: str, metadata: DataFrame, width: int, prefix: str = "shape_embedding_") -> DataFrame:
    """Embeddings as wide columns of unit length beside their targets' metadata; a vector without
    metadata stays, a missing component is null, a vector of no length stays zero."""
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0)))
    rows = vectors.withColumn("_norm", F.greatest(F.sqrt(square), F.lit(1e-12)))
    wide = [(F.get(vector, F.lit(k)).cast("double") / F.col("_norm")).alias(f"{prefix}{k:03d}") for k in range(width)]
    return rows.select(key, *wide).join(metadata, key, "left")


def projection_clusters(rows: DataFrame, medians: dict[str, str]) -> DataFrame:
    """Clusters of a projection, the largest first, with medians of the columns that are there."""
    return cluster_statistics(rows, "cluster_id", {n: c for n, c in medians.items() if c in rows.columns}).orderBy(F.col("n").desc(), "cluster_id")


def projection_points(rows: DataFrame, text: str = "", columns: tuple[str, ...] = (), cluster: int | None = None, limit: int = 30_000, key: str = "target_id") -> DataFrame:
    """Points of a projection: those that contain a text, of one cluster, and no more than ``limit``
    (1,000 to 50,000), then a seeded sample in the order of a hash, so that reruns agree."""
    from skyweave.functions.strings import matches_text

    found = rows.where(matches_text([F.col(c) for c in columns if c in rows.columns], text)) if text else rows
    found = found if cluster is None else found.where(F.col("cluster_id") == cluster)
    return found.orderBy(F.xxhash64(F.lit(42), key), key).limit(min(50_000, max(1_000, limit)))


def random_view(features: DataFrame, keep: float = 0.78, most: int = 384, noise: float = 0.01, seed: int = 5) -> DataFrame:
    """A view of each series of point features: ``keep`` of its points, two at least and ``most`` at
    most (a single point stays), chosen by a seeded hash, with Gaussian noise on the four flux
    features. Reruns agree, whatever the partitioning. Points are ranked by groups of equal first
    hash digits, so that a long series isn't one task."""
    from skyweave.operators import windows

    key = F.concat_ws("|", F.lit(str(seed)), "target_id", "image_id", F.col("cwave_um").cast("string"), F.to_json("features"))
    rows = windows.with_group_size(features.withColumn("_hash", F.sha1(key.cast("binary"))), ["target_id"], "_n")
    ranked = windows.numbered_groups(rows, ["target_id"], F.substring("_hash", 1, 2), [F.col("_hash")], "_rank")
    kept = F.least(F.greatest(F.bround(F.col("_n") * keep).cast("long"), F.lit(2)), F.col("_n"), F.lit(most))
    chosen = ranked.where((F.col("_n") <= 1) | (F.col("_rank") < kept))
    uniform = lambda k, i: (F.shiftrightunsigned(F.xxhash64("_hash", F.lit(k), i), 11) + 0.5) / float(1 << 53)
    normal = lambda i: F.sqrt(-2.0 * F.log(uniform(1, i))) * F.cos(2.0 * 3.141592653589793 * uniform(2, i))
    noisy = F.transform("features", lambda x, i: F.when((i >= 2) & (i < 6) & (F.col("_n") > 1), (x + noise * normal(i)).cast("float")).otherwise(x))
    return chosen.withColumn("features", noisy).drop("_hash", "_n", "_rank")
