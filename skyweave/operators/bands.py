"""Band joins and the matched-filter kernels on wavelength bands."""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.numeric import FWHM_TO_SIGMA, MAD_TO_SIGMA


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Rows with equal keys and ``abs(left.x - right.y) <= tolerance``.

    A bare distance predicate would be a nested-loop join. Here both sides get a bucket of the
    tolerance's width and the right side is copied to the two neighbouring buckets, so Spark
    plans an equi-join on (keys, bucket), whatever the sizes, and splits skewed buckets."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    l = left.withColumn("_bucket", bucket(x))  # noqa: E741
    r = right.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(y) + d)))
    names = [k for k in keys]
    r = r.select(*(F.col(k).alias(f"_r_{k}") for k in names), F.col("_bucket").alias("_r_bucket"), *(c for c in r.columns if c not in (*names, "_bucket")))
    on = F.col("_bucket") == F.col("_r_bucket")
    for k in names:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return l.join(r, on & (F.abs(F.col(x) - F.col(y)) <= tolerance), how).drop("_bucket", "_r_bucket", *(f"_r_{k}" for k in names))


def best_match(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, tolerance: float, left_id: str, order: list[Column]) -> DataFrame:
    """Every left row with its best partner in the band (first by ``order``), or none."""
    w = Window.partitionBy(left_id).orderBy(*order)
    return band_join(left, right, keys, x, y, tolerance, "left").withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def line_grid(spark, low_nm: float, high_nm: float, step_nm: float) -> DataFrame:
    n = int(round((high_nm - low_nm) / step_nm)) + 1
    return spark.range(n).select((F.lit(float(low_nm)) + F.col("id") * float(step_nm)).alias("line_nm"))


def response(wave_um: Column, band_um: Column, line_um: Column, width_um: float = 0.001) -> Column:
    """Gaussian response of a measurement to a line; 0 without width."""
    sigma = F.sqrt(F.pow(F.greatest(band_um, F.lit(0.0)), 2) + F.lit(max(width_um, 0.0) ** 2)) / FWHM_TO_SIGMA
    return F.when(sigma > 0, F.exp(-0.5 * F.pow((wave_um - line_um) / F.when(sigma > 0, sigma), 2))).otherwise(0.0)


def windowed_points(points: DataFrame, grid: DataFrame, window_um: float) -> DataFrame:
    """Points of each line's window. The grid is an equidistant list, so every point names its
    lines: the grid is joined on a bucket of one window's width instead of by distance."""
    bucket = lambda c: F.floor(c / window_um).cast("long")
    lines = grid.select("line_nm", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(F.col("line_nm") / 1000.0) + d)).alias("_bucket"))
    placed = points.withColumn("_bucket", bucket(F.col("cwave_um")))
    return placed.join(lines, "_bucket").where(F.abs(F.col("cwave_um") - F.col("line_nm") / 1000.0) <= window_um).drop("_bucket")


def line_response(wave_um: Column, band_um: Column, line_um: Column) -> Column:
    """Response to a line without width, by the rounded constant of the frame inspector; a missing
    band is 0.04 um."""
    sigma = F.coalesce(band_um, F.lit(0.04)) / 2.355
    return F.when(sigma > 0, F.exp(-0.5 * F.pow((wave_um - line_um) / F.when(sigma > 0, sigma), 2))).otherwise(0.0)


#: Lines that go to the executors with one scan, (line, point) pairs that are held at once, and bytes of
#: input for one partition of a scan.
GRID_LINES, HELD_PAIRS, PART_BYTES = 1 << 20, 1 << 15, 16 << 20
#: A target of more points than this is dealt by segments, as are the largest of them up to so many.
HOT_POINTS, HOT_TARGETS = 1 << 16, 1 << 10
_EDGE = 1e-9


def _parts(points: DataFrame) -> int:
    """Partitions for a scan's shuffles: they grow with the files that are read, so that a task's
    memory does not."""
    spark = points.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = [unquote(f) for f in points.inputFiles()]
    try:
        size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    except AnalysisException:  # a file's name is a pattern
        size = 0
    return max(least, -(-(size or 0) // PART_BYTES))


def _line_blocks(grid: DataFrame) -> Iterator[np.ndarray]:
    """The distinct lines in ascending order, in blocks of bounded size; one block at least."""
    held: list[float] = []
    for row in grid.select(F.col("line_nm").cast("double").alias("line_nm")).where("line_nm is not null").distinct().orderBy("line_nm").toLocalIterator():
        held.append(row[0])
        if len(held) == GRID_LINES:
            yield np.array(held)
            held = []
    yield np.array(held)


def dealt(df: DataFrame, points: DataFrame) -> DataFrame:
    """What a scan of ``points`` gave, by target, in as many partitions as the scan had."""
    parts = _parts(points)
    return df.repartition(parts, "target_id") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _by_segment(points: DataFrame, window_um: float, parts: int | None = None) -> DataFrame:
    """Points of each target by segments of two windows: every segment has all points within one
    window of its lines, so it is folded over its lines alone. One shuffle, by target and segment,
    so a target with very many points is dealt over as many tasks as it has segments; a task
    holds one segment at a time."""
    wide = 2 * window_um
    segment = lambda x: F.floor(x / wide).cast("int")
    dealt = points.withColumn("_segment", F.explode(F.sequence(segment(F.col("cwave_um") - window_um - _EDGE), segment(F.col("cwave_um") + window_um + _EDGE))))
    keys = ("target_id", "_segment")
    return (dealt.repartition(parts, *keys) if parts else dealt.repartition(*keys)).sortWithinPartitions("target_id", "_segment", "cwave_um")


def _by_target(points: DataFrame, parts: int) -> DataFrame:
    """Points by target, each once; a task holds one target at a time."""
    return points.repartition(parts, "target_id").sortWithinPartitions("target_id", "cwave_um")


def _hot(points: DataFrame) -> list:
    """Targets of more than HOT_POINTS points; beyond HOT_TARGETS of them the largest."""
    sizes = points.where("target_id is not null").groupBy("target_id").count().where(F.col("count") > HOT_POINTS)
    return [r[0] for r in sizes.orderBy(F.col("count").desc()).limit(HOT_TARGETS).collect()]


def _fold(lines_nm: np.ndarray, window_um: float, width_um: float, off_line: float, least_response: float, fold, schema: pa.Schema):
    """A map over batches sorted by (target_id, _segment, cwave_um) or (target_id, cwave_um): ``fold`` gets the columns of a
    tile's points, the place of each of its cells' group in the whole batch, which points lie in the
    window of each cell, which of those barely respond (points by cells), the pairs (point, cell) that do
    respond with their response, and the columns of the whole batch, and returns (which cells, their columns). With list columns in
    ``schema`` a segment is one row, and so is a whole target with its cells as a list of structs.
    A column of strings goes in as places in its sorted names, and lists of them come out as (their lengths, their places)."""
    # beyond so many widths from its line no point reaches a response that is asked for
    lowest = min(off_line, least_response)
    reach = np.sqrt(-2.0 * np.log(lowest)) + 1e-6 if 0 < lowest < 1 else (np.inf if lowest <= 0 else 1e-6)
    lines_um = lines_nm / 1000.0
    of_line = np.floor(lines_um / (2 * window_um)).astype(np.int64)
    bound = np.append(np.flatnonzero(np.diff(of_line, prepend=of_line[:1] - 1)), len(lines_um))
    packed = pa.types.is_list(schema.types[-1])
    structs = packed and pa.types.is_struct(schema.types[-1].value_type)

    def whole(table: pa.Table, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        column, names = {}, {}
        for c in table.column_names:
            if c in ("target_id", "_segment"):
                continue
            if pa.types.is_string(table.schema.field(c).type):
                coded = table.column(c).combine_chunks().dictionary_encode()
                order = pc.array_sort_indices(coded.dictionary)
                names[c], place = coded.dictionary.take(order), np.empty(len(order), np.int64)
                place[order.to_numpy()] = np.arange(len(order))
                column[c] = place[coded.indices.to_numpy()]
            else:
                column[c] = table.column(c).to_numpy(zero_copy_only=False)
        segment = table.column("_segment").to_numpy()[begin] if "_segment" in table.column_names else None
        x = column["cwave_um"]
        sigma = np.sqrt(np.maximum(column["cband_um"], 0.0) ** 2 + width_um**2) / FWHM_TO_SIGMA
        # a tile is some lines of one segment with their points, or several small pieces side by side
        cuts: list[tuple] = []
        for g in range(len(begin)):
            own = x[begin[g] : end[g]]
            edges = bound if segment is None else np.searchsorted(of_line, (segment[g], segment[g] + 1))
            if edges[0] == edges[-1]:
                continue
            low, high = np.searchsorted(own, lines_um[edges[:-1]] - window_um - 1e-6), np.searchsorted(own, lines_um[edges[1:] - 1] + window_um + 1e-6)
            for k in np.flatnonzero(low < high):
                step = max(1, HELD_PAIRS // int(high[k] - low[k]))
                for at in range(edges[k], edges[k + 1], step):
                    upto = min(at + step, edges[k + 1])
                    within = (low[k], high[k]) if upto - at == edges[k + 1] - edges[k] else np.searchsorted(own, (lines_um[at] - window_um - 1e-6, lines_um[upto - 1] + window_um + 1e-6))
                    if within[0] < within[1]:
                        cuts.append((g, at, upto, begin[g] + within[0], begin[g] + within[1]))
        found: list[tuple] = []
        apart = 4.0 * (np.abs(x).max() + np.abs(lines_um).max(initial=0.0) + window_um + 1.0)
        k = 0
        while k < len(cuts):
            tile, n_points, n_lines = [], 0, 0
            while k < len(cuts) and (not tile or (n_points + cuts[k][4] - cuts[k][3]) * (n_lines + cuts[k][2] - cuts[k][1]) <= HELD_PAIRS):
                tile.append(cuts[k])
                n_points, n_lines, k = n_points + cuts[k][4] - cuts[k][3], n_lines + cuts[k][2] - cuts[k][1], k + 1
            several = len(tile) > 1
            at_line = np.concatenate([np.arange(c[1], c[2]) for c in tile])
            at_point = np.concatenate([np.arange(c[3], c[4]) for c in tile]) if several else slice(tile[0][3], tile[0][4])
            part = {c: v[at_point] for c, v in column.items()}
            own, lines, wide = part["cwave_um"], lines_um[at_line], sigma[at_point]
            of_cell = np.repeat([c[0] for c in tile], [c[2] - c[1] for c in tile])
            # pieces of one target share points: each piece's lines meet its own points only
            of_line_piece = np.repeat(np.arange(len(tile)), [c[2] - c[1] for c in tile])
            near = np.abs(own[:, None] - lines) <= window_um
            side = np.minimum(wide * reach, window_um) + _EDGE if np.isfinite(reach) else np.full(len(own), window_um + _EDGE)
            key, line_key = own, lines
            if several:
                of_point = np.repeat(np.arange(len(tile)), [c[4] - c[3] for c in tile])
                near &= of_point[:, None] == of_line_piece
                key, line_key = own + apart * of_point, lines + apart * of_line_piece
            first = np.searchsorted(line_key, key - side)
            size = np.searchsorted(line_key, key + side, side="right") - first
            point = np.repeat(np.arange(len(own)), size)
            line = np.arange(len(point)) - np.repeat(np.cumsum(size) - size - first, size)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                off = (own[point] - lines[line]) / wide[point]
                square = np.square(off)
                # a line of one point: the library's power and exponential, as in SQL, whose last digits may not be those of the arrays'
                alone = np.bincount(line, minlength=len(lines))[line] == 1
                square[alone] = np.float_power(off[alone], 2.0)
                t = np.exp(-0.5 * square)
                t[alone] = [math.exp(v) for v in (-0.5 * square[alone]).tolist()]
                if not wide.all():
                    t[wide[point] == 0] = 0.0
                quiet = near.copy()
                loud = t > off_line
                quiet[point[loud], line[loud]] = False
                used = (t >= least_response) & near[point, line]
                kept, out = fold(part, begin[of_cell], near, quiet, point[used], line[used], t[used], column)
            if len(kept):
                found.append((of_cell[kept], at_line[kept], *out))
        if not found:
            return
        joined = lambda v: tuple(map(np.concatenate, zip(*v, strict=True))) if isinstance(v[0], tuple) else np.concatenate(v)
        group, line, *values = (joined(v) for v in zip(*found, strict=True))
        values = [lines_nm[line], *values]
        if packed:
            rows, first = np.unique(group, return_index=True)
            offsets = pa.array(np.append(first, len(group)).astype(np.int32))
        if structs:
            kind = schema.types[-1]
            cells = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, kind.value_type, strict=True)], fields=list(kind.value_type))
            arrays = [pa.ListArray.from_arrays(offsets, cells, type=kind)]
        elif packed:
            arrays = [pa.array(segment[rows], pa.int32()), *(pa.ListArray.from_arrays(offsets, pa.array(v, t.value_type), type=t) for v, t in zip(values, schema.types[2:], strict=True))]
        else:
            rows = group
            listed = lambda v, n: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(v[0])).astype(np.int32)), names[n].take(pa.array(v[1])))
            arrays = [listed(v, f.name) if isinstance(v, tuple) else pa.array(v, f.type) for v, f in zip(values, list(schema)[1:], strict=True)]
        names = table.column("target_id").take(pa.array(begin[rows]))
        yield pa.RecordBatch.from_arrays([names.combine_chunks().cast(schema.types[0]), *arrays], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def closed(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
            """Whole groups are folded; the last one may go on in the next batch and is kept."""
            nonlocal held
            code = table.column("target_id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            fresh = code[1:] != code[:-1]
            if "_segment" in table.column_names:
                segment = table.column("_segment").to_numpy()
                fresh |= segment[1:] != segment[:-1]
            cut = np.flatnonzero(fresh) + 1
            begin, end = np.concatenate(([0], cut)), np.append(cut, len(code))
            held = None if final else table.slice(begin[-1])
            if not final:
                begin, end = begin[:-1], end[:-1]
            if len(begin):
                yield from whole(table.slice(0, end[-1]), begin, end)

        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                yield from closed(new if held is None else pa.concat_tables([held, new]), False)
        if held is not None and held.num_rows:
            yield from closed(held.combine_chunks(), True)

    return run


def _sum(chosen: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of ``value`` over the ``chosen`` points of every line, in the order they are given."""
    if np.isfinite(value).all():
        return np.einsum("ij,i->j", chosen.astype(np.float64), value)
    return np.where(chosen, value[:, None], 0.0).sum(0)


def _middle(value: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The median over the ``chosen`` points of every line, NaN without one; ``value`` ascends."""
    seen = np.cumsum(chosen, axis=0, dtype=np.int32)
    count = seen[-1]
    place = lambda k: value[np.minimum((seen <= k).sum(0), len(value) - 1)]
    low, high = place((count - 1) // 2), place(count // 2)
    return np.where(count > 0, low + (high - low) * 0.5, np.nan)


def scan(
    points: DataFrame,
    grid: DataFrame,
    flux: str = "flux",
    unc: str = "unc",
    window_um: float = 0.18,
    width_nm: float = 1.0,
    continuum: str = "median",
    off_line: float = 0.25,
    least_continuum: int = 3,
    least_response: float = 1e-3,
    least_support: int = 2,
    least_points: int = 8,
    keep_flagged: bool = False,
    least_snr: float | None = None,
    sources: tuple[str, str] | None = None,
    deal: str = "segments",
) -> DataFrame:
    """Matched filter of every target at every line of ``grid``.

    The continuum is the median (or mean) of the points of the window that barely respond to
    the line; below ``least_continuum`` of them all points of the window serve, and below that
    all points of the target, whose level is a window over it. Points are then dealt by target and
    segment, and every segment of a target's sorted series is folded over its lines with arrays.
    With ``sources``, columns of a detector and an image, a line also has the ``detectors`` of all points that
    support it and the ``best_frame_ids`` of the five that respond most, as lists. Points are dealt by
    ``segments``, which doubles them, by ``targets``, or by ``either``: by targets but for those of very many points, which are
    counted for it."""
    given = {k: v for k, v in locals().items() if k not in ("points", "deal")}
    if deal == "either":
        return _apart(points, lambda part, whole: scan(part, **given, deal="targets" if whole else "segments"))
    whole, parts = deal == "targets", _parts(points)
    base = points.where(F.col("cwave_um").isNotNull() & F.col("cband_um").isNotNull() & F.col(flux).isNotNull())
    if not keep_flagged and "fatal_flag_present" in points.columns:
        base = base.where(~F.coalesce("fatal_flag_present", F.lit(False)))
    double = lambda c, n: F.col(c).cast("double").alias(n)
    base = base.select("target_id", double("cwave_um", "cwave_um"), double("cband_um", "cband_um"), double(flux, "f"), F.coalesce(F.col(unc).cast("double"), F.lit(0.0)).alias("u"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(sources or (), ("detectors", "best_frame_ids"))))
    level = F.median if continuum == "median" else F.avg
    target = Window.partitionBy("target_id")
    base = base.repartition(parts, "target_id") if whole else dealt(base, points)
    base = base.withColumns({"c_target": level("f").over(target), "n_valid": F.count_if(F.col("u") > 0).over(target)}).where(F.col("n_valid") >= least_points).drop("n_valid")

    def fold(column, of_cell, near, quiet, point, line, t, every):
        f, u, n = column["f"], column["u"], near.shape[1]
        sure = u[point] > 0
        if not sure.all():
            point, line, t = point[sure], line[sure], t[sure]
        n_window, n_off, support = np.count_nonzero(near, axis=0), np.count_nonzero(quiet, axis=0), np.bincount(line, minlength=n)
        few = (n_off < least_continuum).any()
        if continuum == "median":
            rank = np.argsort(f, kind="stable")
            c_off = _middle(f[rank], quiet[rank])
            c_window = _middle(f[rank], near[rank]) if few else c_off
        else:
            c_off = _sum(quiet, f) / n_off
            c_window = _sum(near, f) / n_window if few else c_off
        chosen = np.where(n_off >= least_continuum, c_off, np.where(n_window >= least_continuum, c_window, every["c_target"][of_cell]))
        weight = t / np.square(np.maximum(u, 1e-9))[point]
        s, norm = np.bincount(line, weight * (f[point] - chosen[line]), n), np.bincount(line, weight * t, n)
        kept = np.flatnonzero((support >= least_support) & (norm > 0))
        if least_snr is not None:
            kept = kept[s[kept] / np.sqrt(norm[kept]) >= least_snr]
        s, norm = s[kept], norm[kept]
        found = (s / norm, 1.0 / np.sqrt(norm), s / np.sqrt(norm), chosen[kept])
        return kept, (*found, *(_sources(kept, line, point, t, column) if sources else ()), support[kept])

    named = ["detectors strings", "best_frame_ids strings"] if sources else []
    return _scanned(base, grid, window_um, width_nm, off_line, least_response, fold, ["amp double", "amp_unc double", "snr double", "continuum double", *named, "support long"], parts, whole=whole, placed=whole)


def _sources(kept: np.ndarray, line: np.ndarray, point: np.ndarray, t: np.ndarray, column: dict[str, np.ndarray], most: int = 5) -> tuple[tuple, tuple]:
    """Detectors of the points that support each line, and images of those that respond most, equal ones by name."""
    cell = np.full(line.max(initial=-1) + 2, -1)
    cell[kept] = np.arange(len(kept))
    own = cell[line] >= 0
    cell, point, t = cell[line[own]], point[own], t[own]
    detector, image = column["detectors"][point], column["best_frame_ids"][point]
    many = detector.max(initial=0) + 1
    pairs = np.unique(cell * many + detector)
    order = np.lexsort((image, -t, cell))
    cell, image = cell[order], image[order]
    near = np.arange(len(cell)) - np.searchsorted(cell, cell) < most
    count = lambda cells: np.bincount(cells, minlength=len(kept))
    return (count(pairs // many), pairs % many), (count(cell[near]), image[near])


def _scanned(base: DataFrame, grid: DataFrame, window_um: float, width_nm: float, off_line: float, least_response: float, fold, columns: list[str], parts: int, packed: bool = False, whole: bool = False, placed: bool = False) -> DataFrame:
    kinds = {"double": pa.float64(), "long": pa.int64(), "strings": pa.list_(pa.string())}
    fields = [("line_nm", "double"), *(c.split() for c in columns)]
    if packed and whole:
        schema = pa.schema([("target_id", pa.string()), ("cells", pa.list_(pa.struct([(n, kinds[k]) for n, k in fields])))])
        declared = f"target_id string, cells array<struct<{', '.join(f'{n}: {k}' for n, k in fields)}>>".replace(": long", ": bigint")
    elif packed:
        schema = pa.schema([("target_id", pa.string()), ("segment", pa.int32()), *((n, pa.list_(kinds[k])) for n, k in fields)])
        declared = ", ".join(["target_id string", "segment int", *(f"{n} array<{k}>" for n, k in fields)])
    else:
        schema = pa.schema([("target_id", pa.string()), *((n, kinds[k]) for n, k in fields)])
        declared = ", ".join(["target_id string", *(f"{n} {k}" for n, k in fields)]).replace(" strings", " array<string>")
    named = base.withColumn("target_id", F.col("target_id").cast("string")) if dict(base.dtypes)["target_id"] != "string" else base
    if placed:  # the base lies by target
        dealt = named.sortWithinPartitions("target_id", "cwave_um")
    else:
        dealt = _by_target(named, parts) if whole else _by_segment(named, window_um, parts)
    found = [dealt.mapInArrow(_fold(lines, window_um, width_nm / 1000.0, off_line, least_response, fold, schema), declared) for lines in _line_blocks(grid)]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    if packed and whole and len(found) > 1:
        out = out.groupBy("target_id").agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
    return out


_DUAL = {"support": "long", "aperture_amp": "double", "psf_amp": "double", "aperture_snr": "double", "psf_snr": "double", "joint_rho": "double", "q": "double"}


def _dual(points: DataFrame, grid: DataFrame, window_um: float, width_nm: float, off_line: float, least_response: float, wanted: tuple[str, ...], packed: bool, whole: bool, parts: int) -> DataFrame:
    ok = ~F.coalesce("fatal_flag_present", F.lit(False)) & (F.col("aperture_flux_unc_uJy") > 0) & (F.col("psf_flux_unc_uJy") > 0)
    named = {"cwave_um": "cwave_um", "cband_um": "cband_um", "aperture_flux_uJy": "fa", "aperture_flux_unc_uJy": "ua", "psf_flux_uJy": "fp", "psf_flux_unc_uJy": "up"}
    base = points.where(ok).select("target_id", *(F.col(c).cast("double").alias(n) for c, n in named.items())).dropna().withColumn("row", F.monotonically_increasing_id())

    def fold(column, of_cell, near, quiet, point, line, t, every):
        n = near.shape[1]
        n_off, support = np.count_nonzero(quiet, axis=0), np.bincount(line, minlength=n)
        square, read = t * t, np.argsort(column["row"])
        sums, calm = [], quiet[read]
        for f, u in (("fa", "ua"), ("fp", "up")):
            value, variance = column[f], np.square(column[u])[point]
            level = np.where(n_off > 0, _sum(calm, value[read]) / np.maximum(n_off, 1), 0.0)
            sums += [np.bincount(line, t * (value[point] - level[line]) / variance, n), np.bincount(line, square / variance, n)]
        kept = np.flatnonzero((support > 0) & (sums[1] > 0) & (sums[3] > 0))
        sa, na, sp, n_p = (v[kept] for v in sums)
        both, norm = sa + sp, na + n_p
        out = {"q": np.where(both > 0, both * both / norm, 0.0)}
        if wanted != ("q",):
            out |= {"support": support[kept], "aperture_amp": sa / na, "psf_amp": sp / n_p, "aperture_snr": sa / np.sqrt(na), "psf_snr": sp / np.sqrt(n_p), "joint_rho": both / np.sqrt(norm)}
        return kept, tuple(out[c] for c in wanted)

    return _scanned(base, grid, window_um, width_nm, off_line, least_response, fold, [f"{c} {_DUAL[c]}" for c in wanted], parts, packed, whole)


def _apart(points: DataFrame, scanned) -> DataFrame:
    """``scanned(points, whole)`` of targets that one task can hold and, by segments, of very large ones."""
    hot = _hot(points)
    if not hot:
        return scanned(points, True)
    large = F.coalesce(F.col("target_id").isin(hot), F.lit(False))
    return scanned(points.where(~large), True).unionByName(scanned(points.where(large), False))


def dual_scan(points: DataFrame, grid: DataFrame, window_um: float = 0.18, width_nm: float = 1.0, off_line: float = 0.25, least_response: float = 1e-3, packed: tuple[str, ...] = ()) -> DataFrame:
    """Aperture and fitted fluxes together: mean continuum over points with both, the combined
    score ``rho`` and ``q = rho^2`` where rho is positive. One shuffle of every point, by target;
    targets of very many points are dealt by segments too, which doubles their points.
    With ``packed`` a row is a segment of a target, with its lines and those columns as lists.
    The continuum adds its points in the order they are read: where one point serves two lines of
    one continuum their q are equal but for rounding, and the sums' last digits order them."""
    given, parts = (window_um, width_nm, off_line, least_response), _parts(points)
    if packed:
        return _dual(points, grid, *given, packed, True, False, parts)
    return _apart(points, lambda part, whole: _dual(part, grid, *given, tuple(_DUAL), False, whole, parts))


def dual_series(points: DataFrame, grid: DataFrame, columns: tuple[str, ...] = ("q",), window_um: float = 0.18, width_nm: float = 1.0, off_line: float = 0.25, least_response: float = 1e-3) -> DataFrame:
    """``dual_scan`` with one row a target, its cells in order of their lines as a list ``cells`` of
    structs. Only the cells of very large targets are shuffled."""
    given, parts = (window_um, width_nm, off_line, least_response), _parts(points)

    def scanned(part: DataFrame, whole: bool) -> DataFrame:
        found = _dual(part, grid, *given, columns, True, whole, parts)
        return found if whole else series_of(found)

    return _apart(points, scanned)


def series_of(scores: DataFrame) -> DataFrame:
    """Segments of a packed scan by target: one row with the target's cells in order of their lines,
    as a list ``cells`` of structs."""
    columns = [c for c in scores.columns if c not in ("target_id", "segment")]
    whole = scores.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("segment", *columns))).alias("_s"))
    return whole.select("target_id", F.arrays_zip(*(F.flatten(F.col(f"_s.{c}")).alias(c) for c in columns)).alias("cells"))


def residual_rms(points: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Robust scale of a value by group: 1.4826 MAD, population deviation where that is 0, null
    below 3 values."""
    centre = points.where(F.col(value).isNotNull()).withColumn("_m", F.median(value).over(Window.partitionBy(*keys)))
    got = centre.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_mad"), F.stddev_pop(value).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    scale = F.when(F.col("_mad") > 0, MAD_TO_SIGMA * F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd"))
    return got.select(*keys, F.when(F.col("_n") >= 3, scale).alias("scale"))
