"""Photometry of frames whose pixels come from a table, PSF kernels by zone, injected lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators import bands, pixels, windows
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query
from skyweave.session import stored

SIZE = (24, 24)
FATAL = 64
RADIUS, INNER, OUTER = 2.5, 4.0, 7.0


def _targets(t: Tables) -> DataFrame:
    return t.view("pixel_targets")


def _frames(t: Tables) -> DataFrame:
    return pixels.pack_frames(t.view("pixel_values"))


def psf_tables(t: Tables, side: int = 41, oversample: int = 5) -> tuple[DataFrame, DataFrame]:
    """PSF planes on a 3 x 3 grid, of widths that grow over the image, one cube for each nation; and
    which frames, those of its suppliers, have it."""
    c = side // 2
    square = lambda v: v * v

    def plane(zone):
        wide = (1.1 + 0.02 * F.col("n_nationkey") + 0.05 * zone) * oversample
        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.exp(-0.5 * (square((i % side - c) / wide) + square((F.floor(i / side) - c) / wide))))

    cubes = t.table("nation").select("n_nationkey", F.transform(F.sequence(F.lit(0), F.lit(8)), plane).alias("planes"), F.lit(side).alias("side"), F.lit(oversample).alias("oversample"))
    of = t.table("supplier").select(F.concat(F.lit("pix_"), F.col("s_suppkey").cast("string")).alias("frame_id"), F.col("s_nationkey").alias("n_nationkey"))
    return of, cubes


def psf_cubes(t: Tables, side: int = 41, oversample: int = 5) -> DataFrame:
    """The cube of each frame."""
    of, cubes = psf_tables(t, side, oversample)
    return of.join(cubes, "n_nationkey").drop("n_nationkey")


def _overlap(r: float) -> tuple[str, str]:
    """DuckDB macros as text: the area of a circle of radius r left of x and below y."""
    arc = lambda x: f"(0.5e0*(({x})*sqrt(greatest({r * r}e0 - ({x})*({x}), 0e0)) + {r * r}e0*asin(({x})/{r}e0)) + {math.pi * r * r / 4})"
    c = f"sqrt(greatest({r * r}e0 - y*y, 0e0))"
    middle = f"least(greatest(x, -{c}), {c})"
    between = f"y*({middle} + {c}) + {arc(middle)} - {arc('-' + c)}"
    caps = f"2e0*({arc(f'least(x, -{c})')} + {arc(f'greatest(x, {c})')} - {arc(c)})"
    return f"({between}) + case when y > 0e0 then {caps} else 0e0 end", f"least(greatest({{}}, -{r}e0), {r}e0)"


def _corner(name: str, dx: float, dy: float) -> str:
    area, clip = _overlap(RADIUS)
    return f"{name} as (select frame_id, target_id, py, px, {area} as a from (select *, {clip.format(f'px - tx + {dx}e0')} as x, {clip.format(f'py - ty + {dy}e0')} as y from near))"


EXACT_WEIGHTS = [
    _corner("q1", 0.5, 0.5), _corner("q2", -0.5, 0.5), _corner("q3", 0.5, -0.5), _corner("q4", -0.5, -0.5),
    "w as (select n.*, q1.a - q2.a - q3.a + q4.a as w from near n join q1 using (frame_id, target_id, py, px) join q2 using (frame_id, target_id, py, px) join q3 using (frame_id, target_id, py, px) join q4 using (frame_id, target_id, py, px))",
]
SUBPIXEL_WEIGHTS = [
    f"hits as (select frame_id, target_id, py, px, count(case when pow(px + (i % 5 + 0.5e0)/5e0 - 0.5e0 - tx, 2) + pow(py + (i // 5 + 0.5e0)/5e0 - 0.5e0 - ty, 2) <= {RADIUS * RADIUS}e0 then 1 end)/25e0 as w from near, range(25) r(i) group by 1, 2, 3, 4)",
    "w as (select n.*, h.w from near n join hits h using (frame_id, target_id, py, px))",
]


def _aperture_sql(fault: str, weights: list[str], ring: str, met: str, background_pixels: str) -> str:
    """Photometry of every target over its pixels' rows, the five rounds of clipping unrolled."""
    steps = [
        f"tg as (select frame_id, target_id, x as tx, y as ty, case when x is null or y is null then 'bad_position' {fault} when x < 0e0 or y < 0e0 or x >= 24e0 or y >= 24e0 then 'outside_image' end as fault from pixel_targets)",
        f"near as (select t.frame_id, target_id, tx, ty, p.y as py, p.x as px, value, variance, flags, (flags & {FATAL}) = 0 as good, (p.x - tx)*(p.x - tx) + (p.y - ty)*(p.y - ty) as d2 from tg t join pixel_values p on t.frame_id = p.frame_id where fault is null and abs(p.x - tx) <= {OUTER + 1}e0 and abs(p.y - ty) <= {OUTER + 1}e0)",
        f"ring as (select frame_id, target_id, value from near where good and {ring})",
        "c0 as (select * from ring)",
    ]
    for k in range(5):
        steps.append(f"m{k} as (select frame_id, target_id, median(value) as m, stddev_pop(value) as s from c{k} group by 1, 2)")
        steps.append(f"c{k + 1} as (select c.* from c{k} c join m{k} m on c.frame_id = m.frame_id and c.target_id = m.target_id where s <= 0e0 or abs(value - m) <= 3e0*s)")
    steps += [
        "bg as (select frame_id, target_id, median(value) as level, stddev_pop(value) as spread from c5 group by 1, 2)",
        f"nb as (select frame_id, target_id, count(*) as n from {background_pixels} group by 1, 2)",
        *weights,
        f"s as (select frame_id, target_id, sum(case when good then w else 0e0 end) as area, sum(case when good then w*value else 0e0 end) as total, sum(case when good then w*variance else 0e0 end) as noise, count(case when {met} and (flags & {FATAL}) <> 0 then 1 end) as n_bad, cast(coalesce(bit_or(case when {met} then flags end), 0) as bigint) as flags from w group by 1, 2)",
        "f as (select t.frame_id, t.target_id, coalesce(fault, case when level is null then 'bad_background' when area <= 0e0 then 'no_good_aperture_area' else 'ok' end) as status, s.*, level, spread, n from (select frame_id, target_id, fault from tg) t left join (select frame_id as f2, target_id as t2, area, total, noise, n_bad, flags from s) s on t.frame_id = s.f2 and t.target_id = s.t2 left join bg on t.frame_id = bg.frame_id and t.target_id = bg.target_id left join nb on t.frame_id = nb.frame_id and t.target_id = nb.target_id)",
    ]
    ok = lambda sql, name: f"case when status = 'ok' then {sql} end as {name}"
    return "with " + ", ".join(steps) + f" select frame_id, target_id, {ok('round(total - level*area, 5)', 'flux')}, {ok('round(sqrt(noise + area*area*spread*spread/n), 5)', 'flux_unc')}, {ok('round(area, 7)', 'area')}, {ok('round(level, 6)', 'background')}, {ok('round(spread, 6)', 'background_unc')}, {ok('n_bad', 'n_bad')}, {ok('flags', 'flags')}, status from f"


def _rounded(got: DataFrame) -> DataFrame:
    return got.withColumns({c: F.round(c, d) for c, d in (("flux", 5), ("flux_unc", 5), ("area", 7), ("background", 6), ("background_unc", 6))})


@query("g2_exact_aperture", _aperture_sql("", EXACT_WEIGHTS, f"d2 >= {INNER * INNER}e0 and d2 < {OUTER * OUTER}e0", f"d2 < {RADIUS * RADIUS}e0", "ring"))
def exact_aperture(t: Tables) -> DataFrame:
    """Exact-overlap aperture photometry of all targets of all frames."""
    return _rounded(pixels.aperture(_frames(t), _targets(t), SIZE, RADIUS, INNER, OUTER, FATAL))


@query("g4_aperture_photometry", _aperture_sql("when least(x, y, 23e0 - x, 23e0 - y) < 6e0 then 'outside_edge_margin'", SUBPIXEL_WEIGHTS, f"d2 > {INNER * INNER}e0 and d2 <= {OUTER * OUTER}e0", "w > 0e0", "c5"))
def subpixel_aperture(t: Tables) -> DataFrame:
    """Apertures by 5 x 5 points a pixel; targets nearer than 6 pixels to the border are left out."""
    return _rounded(pixels.aperture(_frames(t), _targets(t), SIZE, RADIUS, INNER, OUTER, FATAL, subpixels=5, edge=6.0))


@query("g6_zone_kernels", "select frame_id, target_id, cast(least(2, floor(y/24e0*3e0))*3 + least(2, floor(x/24e0*3e0)) as int) as sector, 8 as size, 1e0 as kernel_sum from pixel_targets where x is not null and x < 24e0")
def zone_kernels(t: Tables) -> DataFrame:
    """The zone and the kernel of every target inside its frame; every kernel sums to one."""
    made = pixels.kernels(_frames(t), _targets(t), SIZE, radius=4, cubes=psf_tables(t))
    return made.select("frame_id", "target_id", "sector", "size", F.round(F.aggregate("kernel", F.lit(0.0), lambda s, v: s + v), 9).alias("kernel_sum"))


@query("g7_psf_photometry")
def zone_psf(t: Tables) -> DataFrame:
    """PSF photometry at the targets' places with the kernels of their zones."""
    return pixels.zone_psf_photometry(_frames(t), _targets(t), SIZE, radius=4, cubes=psf_tables(t), fatal_mask=FATAL)


@query("g8_centroid_grid")
def centroid_grid(t: Tables) -> DataFrame:
    """The same with the centre searched over 25 offsets, best by signal to noise."""
    return pixels.zone_psf_photometry(_frames(t), _targets(t), SIZE, radius=4, cubes=psf_tables(t), fatal_mask=FATAL, reach=1.0, step=0.5)


#: The five frames of a target that respond most to its injected line.
INJECTION_FRAMES_SQL = """
select injection_id, target_id, image_id, round(line_response, 9) as line_response, round(line_flux*line_response, 6) as frame_flux, cast(k as int) as place from (
 select injection_id, t.target_id, image_id, strength*100e0 as line_flux, r as line_response, row_number() over (partition by injection_id order by round(r, 12) desc, image_id) as k from injection_truth t join (
  select target_id, image_id, cwave_um, cband_um, row_number() over (partition by target_id, image_id order by cwave_um, detector, aperture_flux_uJy) as one from spectra_points) p on t.target_id = p.target_id and p.one = 1,
  lateral (select exp(-0.5e0*pow((cwave_um - injected_line_nm/1000e0)/(sqrt(pow(greatest(cband_um, 0e0), 2) + 1e-6)/2.354820045e0), 2)) as r) where r >= 1e-3) where k <= 5
"""


def injection_frames(points: DataFrame, truth: DataFrame, most: int = 5, least: float = 1e-3, width_nm: float = 1.0) -> DataFrame:
    """For each injection the ``most`` frames of its target that respond most to its line, one row a
    frame, and the flux that falls into each."""
    same = Window.partitionBy("target_id", "image_id").orderBy("cwave_um", "detector", "aperture_flux_uJy")
    one = points.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("target_id", "image_id", "cwave_um", "cband_um")
    response = bands.response(F.col("cwave_um"), F.col("cband_um"), F.col("injected_line_nm") / 1000.0, width_nm / 1000.0)
    pairs = one.join(truth, "target_id").withColumn("line_response", response).where(F.col("line_response") >= least)
    best = [F.round("line_response", 12).desc(), F.col("image_id")]
    top = windows.top_n(pairs, ["injection_id"], best, most, F.col("image_id"))
    place = F.row_number().over(Window.partitionBy("injection_id").orderBy(*best))
    return top.withColumns({"frame_flux": F.col("line_flux") * F.col("line_response"), "place": place})


@query("v16_injection_frames", INJECTION_FRAMES_SQL)
def injected_frames_of_targets(t: Tables) -> DataFrame:
    """Injection driver for all targets at once."""
    got = injection_frames(t.points, t.truth.withColumn("line_flux", F.col("strength") * 100.0))
    return got.select("injection_id", "target_id", "image_id", F.round("line_response", 9).alias("line_response"), F.round("frame_flux", 6).alias("frame_flux"), "place")


@query("g11_injected_pixels", f"with v as ({INJECTION_FRAMES_SQL.strip()}) select 'pix_' || substr(v.target_id, 5) as frame_id, injection_id, round(frame_flux, 3) as injected, round(frame_flux, 3) as recovered, 64 as pixels from v join pixel_targets p on p.frame_id = 'pix_' || substr(v.target_id, 5) and p.target_id = 't5' where place = 1")
def injected_line_round_trip(t: Tables) -> DataFrame:
    """A line into the pixels of every frame and out again: each injection's best frame flux is
    spread over the pixels at the frame's fifth target; the PSF flux there grows by as much."""
    planned = injection_frames(t.points, t.truth.withColumn("line_flux", F.col("strength") * 100.0)).where("place = 1").withColumn("frame_flux", F.round("frame_flux", 6))
    at = _targets(t).where("target_id = 't5'").select("frame_id", "x", "y")
    injections = planned.withColumn("frame_id", F.concat(F.lit("pix_"), F.substr("target_id", F.lit(5)))).join(at, "frame_id").select("frame_id", "injection_id", "x", "y", "frame_flux")
    injections, cubes = stored(injections, "injections"), psf_tables(t)
    table = t.view("pixel_values")
    after, provenance = pixels.injected_pixels(table, cubes, injections, SIZE, radius=4)
    places = injections.select("frame_id", F.col("injection_id").alias("target_id"), "x", "y")
    flux = lambda p, name: pixels.zone_psf_photometry(pixels.pack_frames(p), places, SIZE, radius=4, cubes=cubes).select("frame_id", "target_id", F.col("flux").alias(name))
    found = flux(after, "after").join(flux(table, "before"), ["frame_id", "target_id"]).withColumnRenamed("target_id", "injection_id")
    wanted = injections.select("injection_id", F.round("frame_flux", 3).alias("injected"))
    return found.join(wanted, "injection_id").join(provenance.select("injection_id", F.col("pixels").cast("int").alias("pixels")), "injection_id").select("frame_id", "injection_id", "injected", F.round(F.round(F.col("after") - F.col("before"), 6), 3).alias("recovered"), "pixels")
