"""Frames: projection with distortion, written catalogs with partition pruning."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions import sky
from skyweave.operators import projection
from skyweave.plans.fixtures import Tables
from skyweave.plans.registry import query
from skyweave.session import fresh_folder, stored
from skyweave.sources import tables

TERMS = projection.sip_terms(3)


def _poly(side: str, du: int = 0, dv: int = 0) -> str:
    """The polynomial, or a derivative of it, written out."""
    out = []
    for p, q in TERMS:
        if (du and not p) or (dv and not q):
            continue
        factor = p if du else q if dv else 1
        out.append(f"{side}_{p}{q}*{factor}e0" + "*u" * (p - du) + "*v" * (q - dv))
    return "(" + " + ".join(out) + ")"


def _projection_sql() -> str:
    near = "c.dec between f.dec_low and f.dec_high and case when f.ra_high - f.ra_low >= 360e0 then true when f.ra_low < 0e0 then (c.ra >= f.ra_low + 360e0 or c.ra <= f.ra_high) when f.ra_high >= 360e0 then (c.ra >= f.ra_low or c.ra <= f.ra_high - 360e0) else c.ra between f.ra_low and f.ra_high end"
    steps = [
        f"j as (select f.*, c.source_id, radians(c.ra - crval1) as da, radians(c.dec) as d, radians(crval2) as d0 from sip_frames f join catalog_sources c on {near})",
        "t as (select *, sin(d0)*sin(d) + cos(d0)*cos(d)*cos(da) as front from j)",
        "p as (select *, degrees(cos(d)*sin(da)/front) as e, degrees((cos(d0)*sin(d) - sin(d0)*cos(d)*cos(da))/front) as n from t where front > 0e0)",
        "s0 as (select *, (cd22*e - cd12*n)/(cd11*cd22 - cd12*cd21) as uu, (cd11*n - cd21*e)/(cd11*cd22 - cd12*cd21) as vv, (cd22*e - cd12*n)/(cd11*cd22 - cd12*cd21) as u, (cd11*n - cd21*e)/(cd11*cd22 - cd12*cd21) as v from p)",
    ]
    for k in range(6):
        steps.append(f"n{k} as (select *, u + {_poly('a')} - uu as f, v + {_poly('b')} - vv as g, 1e0 + {_poly('a', du=1)} as fu, {_poly('a', dv=1)} as fv, {_poly('b', du=1)} as gu, 1e0 + {_poly('b', dv=1)} as gv from s{k})")
        steps.append(f"s{k + 1} as (select * exclude (u, v, f, g, fu, fv, gu, gv), u - (f*gv - g*fv)/(fu*gv - fv*gu) as u, v - (g*fu - f*gu)/(fu*gv - fv*gu) as v from n{k})")
    steps.append("x as (select frame_id, source_id, u + crpix1 as x, v + crpix2 as y, naxis1, naxis2 from s6)")
    body = "select frame_id, source_id, round(x, 6) as x_pix, round(y, 6) as y_pix, round(least(x - 1e0, y - 1e0, naxis1 - x, naxis2 - y), 6) as edge_distance_pix, case when x between 1 and naxis1 and y between 1 and naxis2 then 'in_frame' else 'outside' end as status from x"
    return "with " + ", ".join(steps) + " " + body


@query("p13_frame_projection", _projection_sql())
def frame_projection(t: Tables) -> DataFrame:
    """Every catalog source in the box of every frame, projected with the frame's distortion."""
    pairs = projection.targets_of_frames(t.view("sip_frames"), t.catalog.select("source_id", "ra", "dec"))
    return projection.project(pairs).select("frame_id", "source_id", *(F.round(c, 6).alias(c) for c in ("x_pix", "y_pix", "edge_distance_pix")), "status")


#: Level of the cells that the written catalog is partitioned by: 192 of them.
LEVEL = 2
#: Level of the cells that an unplaced catalog is joined by: 3,072 of them, near the size of a frame.
FINE = 4


def write_sky_catalog(t: Tables) -> DataFrame:
    """The catalog by cells in a new folder, read back with its declared partition columns."""
    path = fresh_folder(t.spark, "catalog")
    rows = t.catalog.withColumn("hpx", sky.nested_pixel(F.col("ra"), F.col("dec"), LEVEL).cast("int"))
    tables.write_catalog(rows, path, LEVEL)
    return t.spark.read.option("basePath", path).parquet(f"{path}/hpx_level={LEVEL}")


FOOTPRINTS_SQL = "with m as (select f.frame_id, c.source_id, c.phot_g_mean_mag as mag, row_number() over (partition by f.frame_id order by c.phot_g_mean_mag, c.source_id) as k from sip_frames f join catalog_sources c on c.dec between f.dec_low and f.dec_high and case when f.ra_high - f.ra_low >= 360e0 then true when f.ra_low < 0e0 then (c.ra >= f.ra_low + 360e0 or c.ra <= f.ra_high) when f.ra_high >= 360e0 then (c.ra >= f.ra_low or c.ra <= f.ra_high - 360e0) else c.ra between f.ra_low and f.ra_high end where f.dec_low > 10e0 and c.phot_g_mean_mag between 8e0 and 19e0) select frame_id, source_id, round(mag, 9) as mag, cast(k as bigint) as place from m where k <= 500"


#: Pairs of a frame and a source that one task of an unplaced catalog is to make.
TASK_PAIRS = 1 << 20


def expected_pairs(catalog: DataFrame, frames: DataFrame) -> tuple[int, float]:
    """How many frames there are, and how many sources one holds if the sky is evenly filled."""
    area = F.least(F.col("ra_high") - F.col("ra_low"), F.lit(360.0)) * (F.sin(F.radians("dec_high")) - F.sin(F.radians("dec_low"))) / 720.0
    n, share = frames.agg(F.count(F.lit(1)), F.avg(area)).first()
    return n, catalog.count() * (share or 0.0)


def footprints(catalog: DataFrame, frames: DataFrame, most: int = 500, low: float = 8.0, high: float = 19.0, level: int = LEVEL) -> DataFrame:
    """Brightest sources of each frame; frames' cells prune the catalog's partitions at run time.

    Where frames hold far more than ``most`` sources they first meet the brightest of the catalog alone,
    as many as should fill them twice. A frame that these fill is done: no other source is as bright.
    The others meet four times as many, and so on up to the whole catalog, so pairs grow with the
    frames and not with frames times sources."""
    catalog = catalog.where(F.col("phot_g_mean_mag").between(low, high))
    _, each = expected_pairs(catalog, frames)
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("phot_g_mean_mag", "source_id"))
    brightest = lambda sources, left: tables.sources_of_footprints(sources, left, level).withColumn("place", place.cast("long")).where(F.col("place") <= most)
    done, left, share = [], frames, 2 * most / each if each > 4 * most else 1.0
    while share < 1:
        faintest = catalog.agg(F.percentile_approx("phot_g_mean_mag", F.lit(share), F.lit(10_000))).first()[0]
        top = stored(brightest(catalog.where(F.col("phot_g_mean_mag") <= faintest), left), "brightest")
        full = top.where(F.col("place") == most).select("frame_id").distinct()
        done.append(top.join(full, "frame_id", "left_semi"))
        left, share = stored(left.join(full, "frame_id", "left_anti"), "frames"), share * 4
        if left.isEmpty():
            break
    else:
        done.append(brightest(catalog, left))
    return functools.reduce(DataFrame.unionByName, done).select("frame_id", "source_id", F.round("phot_g_mean_mag", 9).alias("mag"), "place")


def _northern(t: Tables) -> DataFrame:
    return t.view("sip_frames").select("frame_id", "ra_low", "ra_high", "dec_low", "dec_high").where("dec_low > 10e0")


@query("s22_pruned_footprints", FOOTPRINTS_SQL)
def pruned_footprints(t: Tables) -> DataFrame:
    """The written catalog under the footprints of all northern frames, only their cells read."""
    return footprints(write_sky_catalog(t), _northern(t))


@query("s2_full_scan", FOOTPRINTS_SQL)
def full_scan(t: Tables) -> DataFrame:
    """The same from the catalog as it is, without cells on disk: every row is read and placed."""
    unplaced = write_sky_catalog(t).drop("hpx", "hpx_level")
    placed = unplaced.withColumn("hpx", sky.nested_pixel(F.col("ra"), F.col("dec"), FINE).cast("int"))
    # the catalog is small beside its pairs, so tasks are dealt by pairs and not by bytes
    n, each = expected_pairs(unplaced, _northern(t))
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), min(4096, int(n * each / TASK_PAIRS)))
    return footprints(placed.repartition(tasks, "hpx"), _northern(t), level=FINE)


@query("p22_pruned_shards", "select campaign, source, count(*) as n, round(max(rank_score), 6) as best from review_candidates where campaign like 'camp1%' and (source = 'science' or source like 'inj%') group by 1, 2")
def pruned_shards(t: Tables) -> DataFrame:
    """Index shards by campaign and source: prefixes of both become partition filters."""
    path = fresh_folder(t.spark, "shards")
    t.view("review_candidates").write.partitionBy("campaign", "source").parquet(path)
    shards = tables.shards_named(t.spark.read.parquet(path), "camp1", "science", "inj")
    return shards.groupBy("campaign", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("rank_score"), 6).alias("best"))
