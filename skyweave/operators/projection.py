"""Frame-first projection: all targets of many frames in one plan, with SIP distortion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import sky

WCS = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")


def sip_terms(order: int) -> list[tuple[int, int]]:
    """Exponents (p, q) of a SIP polynomial: degree 2 to ``order``."""
    return [(p, n - p) for n in range(2, order + 1) for p in range(n, -1, -1)]


def targets_of_frames(frames: DataFrame, sources: DataFrame, level: int = 4) -> DataFrame:
    """Pairs of a frame and a source inside its box: both sides name sky cells, an equi-join on the
    cell, then the exact box. A crowded cell is split by Spark's skew join."""
    cells = sky.cells_of_boxes(frames, level, "frame_id")
    placed = sources.withColumn("hpx", sky.nested_pixel(F.col("ra"), F.col("dec"), level).cast("int"))
    box = ("ra_low", "ra_high", "dec_low", "dec_high")
    wide = F.col("ra_high") - F.col("ra_low") >= 360.0
    inside = F.col("dec").between(F.col("dec_low"), F.col("dec_high")) & (wide | sky.in_ra_range(F.col("ra"), F.col("ra_low"), F.col("ra_high")))
    return placed.join(cells.join(frames, "frame_id"), "hpx").where(inside).drop("hpx", *box)


def project(pairs: DataFrame, order: int = 3, one_based: bool = True) -> DataFrame:
    """Adds x_pix, y_pix, edge_distance_pix and status to (frame, source) rows that carry the
    frame's WCS columns, its SIP coefficients a_pq and b_pq (those it has, up to ``order``) and its
    size naxis1 x naxis2. Status is ``in_frame``, ``outside``, ``behind`` (no tangent-plane place)
    or ``not_converged`` (the distortion has no inverse there)."""
    wcs = {k: F.col(k) for k in WCS}
    east, north = sky.tangent_plane(F.col("ra"), F.col("dec"), wcs["crval1"], wcs["crval2"])
    out = pairs.withColumns({"_e": east, "_n": north})
    det = wcs["cd11"] * wcs["cd22"] - wcs["cd12"] * wcs["cd21"]
    out = out.withColumns({"_u": F.try_divide(wcs["cd22"] * F.col("_e") - wcs["cd12"] * F.col("_n"), det), "_v": F.try_divide(wcs["cd11"] * F.col("_n") - wcs["cd21"] * F.col("_e"), det)})
    terms = lambda side: {t: F.col(f"{side}_{t[0]}{t[1]}") for t in sip_terms(order) if f"{side}_{t[0]}{t[1]}" in pairs.columns}
    a, b = terms("a"), terms("b")
    solved = sky.undistorted(out, "_u", "_v", a, b) if a or b else out.withColumn("sip_residual", F.lit(0.0))
    x, y = F.col("_u") + F.col("crpix1"), F.col("_v") + F.col("crpix2")
    placed = solved.withColumns({"x_pix": x, "y_pix": y})
    shift = 0.0 if one_based else 1.0
    x, y = F.col("x_pix"), F.col("y_pix")
    edge = F.least(x - 1.0, y - 1.0, F.col("naxis1") - x, F.col("naxis2") - y)
    converged = F.coalesce(F.col("sip_residual") < 1e-8, F.lit(False))
    status = F.when(F.col("_e").isNull(), "behind").when(~converged, "not_converged").when(sky.in_frame(x, y, F.col("naxis1"), F.col("naxis2")), "in_frame").otherwise("outside")
    known = status.isin("in_frame", "outside")
    done = placed.withColumns({"status": status, "edge_distance_pix": F.when(known, edge), "x_pix": F.when(known, x - shift), "y_pix": F.when(known, y - shift)})
    return done.drop("_e", "_n", "_u", "_v", "sip_residual", *WCS, *(f"{side}_{p}{q}" for side in "ab" for p, q in sip_terms(order)))
