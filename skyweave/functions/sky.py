"""Sky geometry as column expressions: boxes, polygons, nested pixels, proper motion, times."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MJD_UNIX_EPOCH = 40587.0
#: Bits of a catalog id below the level-12 pixel number.
ID_PIXEL_SHIFT = 35


def pixel_of_source(source_id: Column, level: int) -> Column:
    """Nested pixel of a level from a bit-packed source id."""
    return F.shiftright(source_id, ID_PIXEL_SHIFT + 2 * (12 - level))


def in_ra_range(ra: Column, low: Column, high: Column) -> Column:
    """Right ascension inside [low, high], which may run over 360."""
    r, lo, hi = F.pmod(ra, F.lit(360.0)), F.pmod(low, F.lit(360.0)), F.pmod(high, F.lit(360.0))
    return F.when(lo > hi, (r >= lo) | (r <= hi)).otherwise(r.between(lo, hi))


def in_box(ra: Column, dec: Column, ra_low: Column, ra_high: Column, dec_low: Column, dec_high: Column) -> Column:
    return dec.between(dec_low, dec_high) & in_ra_range(ra, ra_low, ra_high)


def polygon_vertices(region: Column) -> Column:
    """Vertices (ra, dec) in a polygon text; a repeated first vertex at the end is dropped."""
    number = F.transform(F.regexp_extract_all(F.regexp_replace(region, "J2000", ""), F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(number) / 2).cast("int") - 1), lambda i: F.struct(F.element_at(number, i * 2 + 1).alias("ra"), F.element_at(number, i * 2 + 2).alias("dec")))
    closed = (F.size(pairs) > 3) & (F.element_at(pairs, 1) == F.element_at(pairs, -1))
    return F.when(F.size(number) >= 6, F.when(closed, F.slice(pairs, 1, F.size(pairs) - 1)).otherwise(pairs))


def in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Even-odd rule over an array of (ra, dec) structs; flat edges are guarded."""
    n = F.size(vertices)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(vertices, i).alias("a"), F.element_at(vertices, F.when(i == n, 1).otherwise(i + 1)).alias("b")))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["ra"], e["a"]["dec"], e["b"]["ra"], e["b"]["dec"]
        rise = F.when(F.abs(by - ay) < 1e-300, F.lit(1e-300)).otherwise(by - ay)
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / rise + ax)

    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(e))


def separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def cone(df: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """Rows (ra, dec) within a radius, with ``separation_deg``: first by a box whose bounds are
    numbers, so that they reach the scan, then by the exact distance."""
    half = radius_deg / max(math.cos(math.radians(dec)), 1e-6)
    low, high = (ra - half) % 360.0, (ra + half) % 360.0
    box = F.col("dec").between(max(-90.0, dec - radius_deg), min(90.0, dec + radius_deg))
    if half < 180.0 and abs(dec) + radius_deg < 90.0:
        box = box & ((F.col("ra") >= low) | (F.col("ra") <= high) if low > high else F.col("ra").between(low, high))
    found = df.where(box).withColumn("separation_deg", separation_deg(F.lit(ra), F.lit(dec), F.col("ra"), F.col("dec")))
    return found.where(F.col("separation_deg") <= radius_deg)


def square_polygon(ra: Column, dec: Column, half_deg: float) -> Column:
    width = F.lit(half_deg) / F.greatest(F.cos(F.radians(dec)), F.lit(1e-6))
    f = "%.6f"
    return F.format_string("POLYGON ICRS " + " ".join([f] * 8), ra - width, dec - half_deg, ra + width, dec - half_deg, ra + width, dec + half_deg, ra - width, dec + half_deg)


def map_xy(ra: Column, dec: Column, width: float, height: float) -> tuple[Column, Column]:
    """Equirectangular map place, right ascension growing to the left."""
    return (1.0 - F.pmod(ra, F.lit(360.0)) / 360.0) * width, (90.0 - dec) / 180.0 * height


def julian_year_of_mjd(mjd: Column) -> Column:
    return 2000.0 + (mjd - 51544.5) / 365.25


def propagate(ra: Column, dec: Column, epoch: Column, pmra: Column, pmdec: Column, mjd: Column) -> dict[str, Column]:
    """Place at the time of observation by rigorous straight motion on the tangent plane.

    ``pmra`` holds the cos(dec) factor. Without epoch or motion the place stays, and ``moved``
    says so."""
    known = epoch.isNotNull() & pmra.isNotNull() & pmdec.isNotNull() & mjd.isNotNull()
    years = F.coalesce(julian_year_of_mjd(mjd) - epoch, F.lit(0.0))
    scale = math.pi / 180.0 / 3.6e6
    east, north = F.coalesce(pmra, F.lit(0.0)) * years * scale, F.coalesce(pmdec, F.lit(0.0)) * years * scale
    a, d = F.radians(ra), F.radians(dec)
    x = F.cos(d) * F.cos(a) - east * F.sin(a) - north * F.sin(d) * F.cos(a)
    y = F.cos(d) * F.sin(a) + east * F.cos(a) - north * F.sin(d) * F.sin(a)
    z = F.sin(d) + north * F.cos(d)
    return {
        "ra_obs_deg": F.when(known, F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))).otherwise(ra),
        "dec_obs_deg": F.when(known, F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).otherwise(dec),
        "moved": known,
    }


def tangent_plane(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Gnomonic offsets (east, north) in degrees; null behind the tangent point."""
    a, d, a0, d0 = F.radians(ra), F.radians(dec), F.radians(ra0), F.radians(dec0)
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a - a0)
    front = F.when(c > 0, c)
    east = F.cos(d) * F.sin(a - a0) / front
    north = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a - a0)) / front
    return F.degrees(east), F.degrees(north)


def world_to_pixel(ra: Column, dec: Column, wcs: dict[str, Column]) -> tuple[Column, Column]:
    """1-based pixel of a TAN projection with a CD matrix (keys crval1, crval2, crpix1, crpix2,
    cd11, cd12, cd21, cd22)."""
    east, north = tangent_plane(ra, dec, wcs["crval1"], wcs["crval2"])
    det = wcs["cd11"] * wcs["cd22"] - wcs["cd12"] * wcs["cd21"]
    x = (wcs["cd22"] * east - wcs["cd12"] * north) / det
    y = (wcs["cd11"] * north - wcs["cd21"] * east) / det
    return x + wcs["crpix1"], y + wcs["crpix2"]


def sip_polynomial(u: Column, v: Column, terms: dict[tuple[int, int], Column]) -> Column:
    """Sum of coefficient * u^p * v^q; ``terms`` by (p, q), a missing coefficient counts as 0."""
    out = F.lit(0.0)
    for (p, q), c in sorted(terms.items()):
        factor = F.coalesce(c, F.lit(0.0))
        for w, n in ((u, p), (v, q)):
            for _ in range(n):
                factor = factor * w
        out = out + factor
    return out


def _derivative(terms: dict[tuple[int, int], Column], by: int) -> dict[tuple[int, int], Column]:
    lower = lambda t: (t[0] - 1, t[1]) if by == 0 else (t[0], t[1] - 1)
    return {lower(t): c * float(t[by]) for t, c in terms.items() if t[by]}


def undistorted(df: DataFrame, u: str, v: str, a: dict[tuple[int, int], Column], b: dict[tuple[int, int], Column], steps: int = 6) -> DataFrame:
    """Replaces (u, v), offsets with distortion, by those without: solves u + A(u, v) = U and
    v + B(u, v) = V by Newton's method from (U, V). Adds ``sip_residual``, the largest difference
    that is left in pixels. Six steps as columns are more code than the JVM compiles, so batches are
    solved with NumPy; a place without a solution is null."""
    kinds = [(side, t) for side, terms in (("a", a), ("b", b)) for t in terms]

    @F.pandas_udf("u double, v double, residual double")
    def solve(goal_u: pd.Series, goal_v: pd.Series, *values: pd.Series) -> pd.DataFrame:
        gu, gv = goal_u.to_numpy(float), goal_v.to_numpy(float)
        of = {k: c.to_numpy(float) for k, c in zip(kinds, values, strict=True)}

        def poly(side: str, x: np.ndarray, y: np.ndarray, du: int = 0, dv: int = 0) -> np.ndarray:
            out = np.zeros_like(x)
            for (own, (p, q)), c in of.items():
                if own == side and p >= du and q >= dv:
                    out = out + c * ((p if du else 1) * (q if dv else 1)) * x ** (p - du) * y ** (q - dv)
            return out

        x, y = gu.copy(), gv.copy()
        with np.errstate(all="ignore"):
            for _ in range(steps):
                f, g = x + poly("a", x, y) - gu, y + poly("b", x, y) - gv
                fu, fv, gx, gy = 1.0 + poly("a", x, y, 1), poly("a", x, y, 0, 1), poly("b", x, y, 1), 1.0 + poly("b", x, y, 0, 1)
                det = fu * gy - fv * gx
                det[det == 0] = np.nan
                x, y = x - (f * gy - g * fv) / det, y - (g * fu - f * gx) / det
            left = np.maximum(np.abs(x + poly("a", x, y) - gu), np.abs(y + poly("b", x, y) - gv))
        return pd.DataFrame({"u": x, "v": y, "residual": left})

    terms = [F.coalesce(c.cast("double"), F.lit(0.0)) for side in (a, b) for c in side.values()]
    out = df.withColumn("_solved", solve(F.col(u).cast("double"), F.col(v).cast("double"), *terms))
    return out.withColumns({u: F.col("_solved")["u"], v: F.col("_solved")["v"], "sip_residual": F.col("_solved")["residual"]}).drop("_solved")


def pixel_to_world(x: Column, y: Column, wcs: dict[str, Column], a: dict[tuple[int, int], Column] | None = None, b: dict[tuple[int, int], Column] | None = None) -> tuple[Column, Column]:
    """(ra, dec) of a 1-based pixel: distortion, CD matrix, inverse tangent plane."""
    u0, v0 = x - wcs["crpix1"], y - wcs["crpix2"]
    u, v = u0 + sip_polynomial(u0, v0, a or {}), v0 + sip_polynomial(u0, v0, b or {})
    east, north = F.radians(wcs["cd11"] * u + wcs["cd12"] * v), F.radians(wcs["cd21"] * u + wcs["cd22"] * v)
    a0, d0 = F.radians(wcs["crval1"]), F.radians(wcs["crval2"])
    front = F.cos(d0) - north * F.sin(d0)
    ra = a0 + F.atan2(east, front)
    dec = F.atan2(north * F.cos(d0) + F.sin(d0), F.sqrt(east * east + front * front))
    return F.pmod(F.degrees(ra), F.lit(360.0)), F.degrees(dec)


def in_frame(x: Column, y: Column, width, height, one_based: bool = True) -> Column:
    """Inside the frame: 1-based and inclusive, or 0-based and half open."""
    if one_based:
        return x.between(1, width) & y.between(1, height)
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def edge_distance(x: Column, y: Column, width, height) -> Column:
    return F.least(x, y, F.lit(width) - x, F.lit(height) - y)


def mjd_to_iso(mjd: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.round((mjd - MJD_UNIX_EPOCH) * 86400e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS")


# ------------------------------------------------------------- nested pixels (HEALPix)


def _spread_bits(v: Column) -> Column:
    """A zero before each bit: the binary digits read in base 4."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def nested_pixel(ra: Column, dec: Column, level: int) -> Column:
    """HEALPix nested pixel number of a direction (Gorski et al. 2005), without Python."""
    nside = 1 << level
    z = F.sin(F.radians(dec))
    za = F.abs(z)
    tt = F.pmod(ra, F.lit(360.0)) / 90.0
    belt = za <= 2.0 / 3.0
    # equatorial belt: numbers of the ascending and descending edge lines
    up, down = nside * (0.5 + tt), nside * z * 0.75
    jp, jm = F.floor(up - down).cast("long"), F.floor(up + down).cast("long")
    fp, fm = F.shiftright(jp, level), F.shiftright(jm, level)
    face_belt = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)
    x_belt, y_belt = jm.bitwiseAND(F.lit(nside - 1)), nside - 1 - jp.bitwiseAND(F.lit(nside - 1))
    # polar caps
    quarter = F.least(F.floor(tt).cast("long"), F.lit(3))
    part = tt - quarter
    tmp = nside * F.sqrt(3.0 * (1.0 - za))
    jp2, jm2 = F.least(F.floor(part * tmp).cast("long"), F.lit(nside - 1)), F.least(F.floor((1.0 - part) * tmp).cast("long"), F.lit(nside - 1))
    north = z >= 0
    x_cap = F.when(north, nside - jm2 - 1).otherwise(jp2)
    y_cap = F.when(north, nside - jp2 - 1).otherwise(jm2)
    face_cap = F.when(north, quarter).otherwise(quarter + 8)
    face, x, y = F.when(belt, face_belt).otherwise(face_cap), F.when(belt, x_belt).otherwise(x_cap), F.when(belt, y_belt).otherwise(y_cap)
    inside = _spread_bits(x.cast("long")).bitwiseOR(F.shiftleft(_spread_bits(y.cast("long")), 1))
    return face.cast("long") * (nside * nside) + inside


def pixel_center(pixel: Column, level: int) -> tuple[Column, Column]:
    """(ra, dec) of the centre of a nested pixel."""
    x, y, face = _xy(pixel, level)
    return _direction(x + 0.5, y + 0.5, face, level)


def pixel_corners(pixel: Column, level: int) -> Column:
    """North, west, south and east corner of a nested pixel as an array of (ra, dec)."""
    x, y, face = _xy(pixel, level)
    out = []
    for dx, dy in ((1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (1.0, 0.0)):
        ra, dec = _direction(x + dx, y + dy, face, level)
        out.append(F.struct(ra.alias("ra"), dec.alias("dec")))
    return F.array(*out)


def _gather_bits(v: Column) -> Column:
    """Every second bit: the digits in base 4, read as binary ones."""
    return F.conv(F.conv(v.bitwiseAND(F.lit(0x5555555555555555)).cast("string"), 10, 4), 2, 10).cast("long")


def _xy(pixel: Column, level: int) -> tuple[Column, Column, Column]:
    size = 1 << (2 * level)
    p = pixel.cast("long")
    inner = p.bitwiseAND(F.lit(size - 1))
    return _gather_bits(inner).cast("double"), _gather_bits(F.shiftright(inner, 1)).cast("double"), F.shiftright(p, 2 * level).cast("int")


def _direction(x: Column, y: Column, face: Column, level: int) -> tuple[Column, Column]:
    """Direction of a place (x, y) on a base face, both in pixels."""
    nside = float(1 << level)
    # Fixed values of the projection: ring and longitude of each face's lowest corner.
    row = F.element_at(F.array(*(F.lit(v) for v in (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4))), face + 1).cast("double")
    column = F.element_at(F.array(*(F.lit(v) for v in (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7))), face + 1).cast("double")
    ring = row * nside - x - y
    north, south = ring < nside, ring > 3.0 * nside
    near = F.when(north, ring).when(south, 4.0 * nside - ring).otherwise(F.lit(nside))
    z = F.when(north, 1.0 - near * near / (3.0 * nside * nside)).when(south, near * near / (3.0 * nside * nside) - 1.0).otherwise((2.0 * nside - ring) * 2.0 / (3.0 * nside))
    longitude = column + F.coalesce(F.try_divide(x - y, near), F.lit(0.0))
    return F.pmod(longitude * 45.0, F.lit(360.0)), F.degrees(F.asin(z))


def cells_of_box(ra_low: float, ra_high: float, dec_low: float, dec_high: float, level: int, samples: int | None = None) -> list[int]:
    """Nested pixels that can meet a box; a static list for partition pruning."""
    side = math.degrees(math.sqrt(math.pi / 3) / (1 << level))
    n = samples or max(7, int(4 * max(abs(ra_high - ra_low), dec_high - dec_low) / side) + 2)
    pad = side
    decs = np.clip(np.linspace(dec_low - pad, dec_high + pad, n), -90, 90)
    ras = np.linspace(ra_low - pad / max(0.05, math.cos(math.radians(max(abs(dec_low), abs(dec_high))))), ra_high + pad / max(0.05, math.cos(math.radians(max(abs(dec_low), abs(dec_high))))), n)
    ra, dec = np.meshgrid(ras, decs)
    return sorted(set(pixels_of(ra.ravel(), dec.ravel(), level).tolist()))


def cells_of_boxes(boxes: DataFrame, level: int, *keep: str) -> DataFrame:
    """``keep`` and the nested pixels (hpx) that a box (ra_low, ra_high, dec_low, dec_high; ra may run
    over 360) can meet: every box is laid out in points closer than a third of a pixel, over its
    area and a pixel's width around it. Rows grow with the boxes' area, never with the catalog."""
    side = math.degrees(math.sqrt(math.pi / 3) / (1 << level))
    step = side / 3.0
    low, high = F.greatest(F.col("dec_low") - side, F.lit(-90.0)), F.least(F.col("dec_high") + side, F.lit(90.0))
    rows = boxes.select(*keep, "ra_low", "ra_high", F.explode(F.transform(F.sequence(F.lit(0), F.ceil((high - low) / step).cast("int")), lambda i: F.least(high, low + i * step))).alias("_dec"))
    shrink = F.greatest(F.cos(F.radians("_dec")), F.lit(0.02))
    first, last = F.col("ra_low") - side / shrink, F.col("ra_high") + side / shrink
    width = F.least(last - first, F.lit(360.0))
    n = F.ceil(width * shrink / step).cast("int")
    places = rows.select(*keep, "_dec", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: first + width * i / F.greatest(n, F.lit(1)))).alias("_ra"))
    return places.select(*keep, nested_pixel(F.col("_ra"), F.col("_dec"), level).cast("int").alias("hpx")).distinct()


def pixels_of(ra: np.ndarray, dec: np.ndarray, level: int) -> np.ndarray:
    """``nested_pixel`` in NumPy, for small driver-side lists."""
    nside = 1 << level
    z = np.sin(np.radians(dec))
    za = np.abs(z)
    tt = np.mod(ra, 360.0) / 90.0
    up, down = nside * (0.5 + tt), nside * z * 0.75
    jp, jm = np.floor(up - down).astype(np.int64), np.floor(up + down).astype(np.int64)
    fp, fm = jp >> level, jm >> level
    face = np.where(fp == fm, fp % 4 + 4, np.where(fp < fm, fp % 4, fm % 4 + 8))
    x, y = jm & (nside - 1), nside - 1 - (jp & (nside - 1))
    quarter = np.minimum(np.floor(tt).astype(np.int64), 3)
    tmp = nside * np.sqrt(3.0 * (1.0 - za))
    a = np.minimum(np.floor((tt - quarter) * tmp).astype(np.int64), nside - 1)
    b = np.minimum(np.floor((1.0 - tt + quarter) * tmp).astype(np.int64), nside - 1)
    cap = za > 2.0 / 3.0
    north = z >= 0
    x = np.where(cap, np.where(north, nside - b - 1, a), x)
    y = np.where(cap, np.where(north, nside - a - 1, b), y)
    face = np.where(cap, np.where(north, quarter, quarter + 8), face)

    def spread(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for k in range(level):
            out |= ((v >> k) & 1) << (2 * k)
        return out

    return face * nside * nside + (spread(x) | spread(y) << 1)


def sky_prefilter(df: DataFrame, ra: str, dec: str, polygon: list[tuple[float, float]], cell: str | None = None, level: int | None = None) -> DataFrame:
    """Rows inside a static polygon, cheap tests first: cells (prunes partitions), box, polygon."""
    ras, decs = [p[0] for p in polygon], [p[1] for p in polygon]
    if max(ras) - min(ras) > 180.0:  # over 360: unwrap
        ras = [r if r >= 180.0 else r + 360.0 for r in ras]
    if cell is not None and level is not None:
        df = df.where(F.col(cell).isin(cells_of_box(min(ras), max(ras), min(decs), max(decs), level)))
    r = F.pmod(F.col(ra), F.lit(360.0))
    r = F.when(r < min(ras), r + 360.0).otherwise(r) if max(ras) > 360.0 else r
    corners = F.array(*(F.struct(F.lit(float(a)).alias("ra"), F.lit(float(b)).alias("dec")) for a, b in zip(ras, decs)))
    return df.where(F.col(dec).between(min(decs), max(decs)) & r.between(min(ras), max(ras)) & in_polygon(r, F.col(dec), corners))


def flat_distance(ra: Column, dec: Column, ra0: float, dec0: float) -> Column:
    """Distance in degrees as on a plane, right ascension shrunk by the cosine of the declination."""
    return F.sqrt(F.pow((ra - ra0) * F.cos(F.radians(dec)), 2) + F.pow(dec - dec0, 2))


def ra_clause(column: str, low: float, high: float) -> str:
    """A right ascension range as SQL text; one that runs over 360 becomes two sides."""
    if high - low >= 360.0:
        return "true"
    a, b = low % 360.0, high % 360.0
    return f"({column} >= {a!r}D or {column} <= {b!r}D)" if a > b else f"({column} >= {a!r}D and {column} <= {b!r}D)"
