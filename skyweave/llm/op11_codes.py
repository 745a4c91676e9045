"""Vector code compression: product codebooks by Lloyd rounds with Elkan's triangle-inequality bounds.

Every kept vector becomes integers floor(4096 * x), cut into equal consecutive parts; each part
position has a codebook of at most ``ENTRIES`` integer entries. The state of a round is a table in
the shared folder: for each vector its integers, its entry in each part, one upper bound a part on
the distance to that entry, and one lower bound a part for every entry. A round reads that table
once: it shifts the bounds by how far the entries moved, skips every entry that a bound shows to
be strictly farther, computes the rest as exact integers, ties to the lower index, and writes the
next state and each task's sums of the parts by entry. Only those sums (entries x dimension
numbers a task, summed before and after the shuffle) decide the next codebooks.

Bounds are stored rounded outwards (upper bounds as 32-bit floats, lower bounds as the upper half
of one), so they may prune less but never wrongly. The triangle inequality is used on distances,
the result on squared integers.

Defined results. Vectors that are null or hold null or non-finite components are dropped. Kept
vectors of unequal length, or of a length that is no multiple of the parts, count as padded with
zeros at the end. The first entries are the vectors of smallest id (null last; equal ids by their
components); fewer vectors give fewer entries, none an empty result. Repeated rows are vectors of
their own. Components too large for 64-bit squares are handled as exact Python integers; errors
beyond the largest long are that long. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import discard, store, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = (1 << 63) - 1
#: Sums travel in signed digits of so many bits, so that no sum of them leaves a long.
DIGIT = 24
#: A label with at least a thousandth of the rows is hot: there are at most so many of them.
HOT_LABELS = 1000
#: Bytes up to which a hot label's name is broadcast (1000 of them: 1 MB at most).
LABEL_BYTES = 1000

_OUT, _IN = 1.0 + 2.0**-40, 1.0 - 2.0**-40


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _integers(components: list[float]) -> list[int]:
    """floor(SCALE * x), exact for every finite double."""
    return [math.floor(x * SCALE) if abs(x) < 2.0**60 else int(x) * SCALE for x in components]


def _narrow(width: int) -> int:
    """Integers below this have squared distances of ``width`` components within 64 bits."""
    return min((1 << 31) - 1, math.isqrt((1 << 62) // max(width, 1)) // 2)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = x - c
    return (diff * diff).sum(axis=-1)


def _roots(squares: np.ndarray, outwards: bool) -> np.ndarray:
    """Square roots that are surely not below (``outwards``) or not above the true ones."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64)) * (_OUT if outwards else _IN)
    limit = 10**300
    found = [math.inf if v > limit and outwards else math.sqrt(float(min(v, limit))) for v in squares.ravel().tolist()]
    return np.asarray(found, dtype=np.float64).reshape(squares.shape) * (_OUT if outwards else _IN)


class Codebooks:
    """Integer entries of every part, and what Elkan's tests need of them."""

    def __init__(self, entries: list[list[list[int]]], before: Codebooks | None = None):
        self.entries = entries
        self.width = len(entries[0][0]) if entries and entries[0] else 0
        limit = _narrow(self.width)
        self.arrays = [np.array(part, dtype=np.int64 if all(abs(v) < limit for e in part for v in e) else object).reshape(len(part), self.width) for part in entries]
        self.half, self.near, self.moved = [], [], []
        for p, a in enumerate(self.arrays):
            between = 0.5 * _roots(np.stack([_squared(a, row) for row in a]), outwards=False)
            self.half.append(between)
            others = between + np.where(np.eye(len(a), dtype=bool), np.inf, 0.0)
            self.near.append(others.min(axis=1))
            self.moved.append(_roots(_squared(a, before.arrays[p]), outwards=True) if before else np.zeros(len(a)))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()


def assign_part(x: np.ndarray, books: Codebooks, p: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Nearest entries of one part, ties to the lower index. ``code``, ``upper`` and ``lower``
    hold those of the round before, and are changed in place to this round's; returns how many
    distances were computed."""
    entries, half, moved = books.arrays[p], books.half[p], books.moved[p]
    upper += moved[code]
    np.maximum(lower - moved, 0.0, out=lower)
    rows = np.flatnonzero(~(upper < books.near[p][code]))  # the others keep an entry that is strictly nearest
    if not len(rows):
        return 0
    own, best_code = x[rows], code[rows]
    best = _squared(own, entries[best_code])
    bounds = lower[rows]
    bounds[np.arange(len(rows)), best_code] = _roots(best, outwards=False)
    reach = _roots(best, outwards=True)
    first, computed = best_code.copy(), len(rows)
    for c in range(len(entries)):
        open_ = np.flatnonzero((first != c) & ~(bounds[:, c] > reach) & ~(half[best_code, c] > reach))
        if not len(open_):
            continue
        computed += len(open_)
        found = _squared(own[open_], entries[c])
        bounds[open_, c] = _roots(found, outwards=False)
        better = np.asarray((found < best[open_]) | ((found == best[open_]) & (c < best_code[open_])), dtype=bool)
        won = open_[better]
        best[won], best_code[won] = found[better], c
        reach[won] = _roots(best[won], outwards=True)
    code[rows], upper[rows], lower[rows] = best_code, reach, bounds
    return computed


def _pack_upper(upper: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(upper.astype(np.float32), np.float32(np.inf))


def _pack_lower(lower: np.ndarray) -> np.ndarray:
    """The upper half of a 32-bit float, cut towards zero."""
    most = float(np.finfo(np.float32).max)
    down = np.nextafter(np.minimum(lower, most).astype(np.float32), np.float32(0))
    return (down.view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def _unpack_lower(stored: np.ndarray) -> np.ndarray:
    return (stored.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Rows of a binary column in which every value holds ``width`` numbers."""
    n = len(column)
    if not n or not width:
        return np.zeros((n, width), dtype=dtype)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(n, width) if offsets[0] % np.dtype(dtype).itemsize == 0 else np.frombuffer(data.tobytes(), dtype=dtype).reshape(n, width)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


class _Round:
    """One pass over the vectors of a task: new assignments, and the sums of parts by entry."""

    def __init__(self, books: Codebooks):
        self.books = books
        m, w = len(books.arrays[0]), books.width
        self.sums = np.zeros((PARTS, m, w), dtype=np.int64)
        self.more: dict[tuple[int, int], list[int]] = {}
        self.counts = np.zeros((PARTS, m), dtype=np.int64)
        self.computed = self.possible = 0

    def assign(self, whole: np.ndarray, wide: list[list[int] | None], code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """``wide`` has the integers of those rows that ``whole`` can't hold."""
        large = np.array([w is not None for w in wide], dtype=bool)
        for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
            if not len(rows):
                continue
            x = np.array([wide[i] for i in rows], dtype=object) if large[rows[0]] else whole[rows].astype(np.int64)
            for p in range(PARTS):
                part = x[:, p * self.books.width : (p + 1) * self.books.width]
                a, u, b = code[rows, p].astype(np.int64), upper[rows, p], lower[rows, p]
                self.computed += assign_part(part, self.books, p, a, u, b)
                self.possible += len(rows) * len(self.books.arrays[p])
                code[rows, p], upper[rows, p], lower[rows, p] = a, u, b
                self._add(part, p, a)

    def _add(self, part: np.ndarray, p: int, code: np.ndarray) -> None:
        self.counts[p] += np.bincount(code, minlength=self.counts.shape[1])
        if part.dtype == object:
            for values, c in zip(part.tolist(), code.tolist(), strict=True):
                held = self.more.setdefault((p, c), [0] * self.books.width)
                self.more[p, c] = [a + b for a, b in zip(held, values, strict=True)]
        else:
            np.add.at(self.sums[p], code, part)

    def totals(self) -> Iterator[tuple[int, int, list[int]]]:
        """(part, entry, digits): the count, then every sum in digits of DIGIT bits, lowest first."""
        w = self.books.width
        for p, c in zip(*np.nonzero(self.counts), strict=True):
            sums = [int(a) + b for a, b in zip(self.sums[p, c].tolist(), self.more.get((int(p), int(c)), [0] * w), strict=True)]
            digits = [int(self.counts[p, c])]
            while any(sums):
                digits += [(-1 if s < 0 else 1) * (abs(s) & ((1 << DIGIT) - 1)) for s in sums]
                sums = [(-1 if s < 0 else 1) * (abs(s) >> DIGIT) for s in sums]
            yield int(p), int(c), digits
        yield -1, -1, [self.computed, self.possible]


def _state_schema(id_field: T.StructField, label_field: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField("vec_id", id_field.dataType), T.StructField("label", label_field.dataType), T.StructField("whole", T.BinaryType()), T.StructField("wide", T.StringType()),
            T.StructField("code", T.BinaryType()), T.StructField("upper", T.BinaryType()), T.StructField("lower", T.BinaryType()),
            T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType())),
        ]
    )


def _first_batch(batch: pa.RecordBatch, books: Codebooks) -> tuple:
    """State of new vectors: entry 0, no upper bound, lower bounds of zero."""
    n, d, limit = batch.num_rows, books.width * PARTS, _narrow(books.width)
    whole, wide = np.zeros((n, d), dtype=np.int32), [None] * n
    for i, components in enumerate(batch.column(2).to_pylist()):
        values = _integers(components) + [0] * (d - len(components))
        if all(abs(v) < limit for v in values):
            whole[i] = values
        else:
            wide[i] = values
    return whole, wide, np.zeros((n, PARTS), dtype=np.uint8), np.full((n, PARTS), np.inf), np.zeros((n, PARTS, len(books.arrays[0])))


def _next_batch(batch: pa.RecordBatch, books: Codebooks) -> tuple:
    m = len(books.arrays[0])
    whole = _matrix(batch.column(2), "<i4", books.width * PARTS)
    wide = [None if v is None else [int(x) for x in v.split(",")] for v in batch.column(3).to_pylist()]
    code = _matrix(batch.column(4), "u1", PARTS).copy()
    upper = _matrix(batch.column(5), "<f4", PARTS).astype(np.float64)
    return whole, wide, code, upper, _unpack_lower(_matrix(batch.column(6), "<u2", PARTS * m)).reshape(-1, PARTS, m)


def _round_step(books: Codebooks, first: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Round(books)
        like = None
        for batch in batches:
            like = batch.schema
            whole, wide, code, upper, lower = (_first_batch if first else _next_batch)(batch, books)
            work.assign(whole, wide, code, upper, lower)
            n = batch.num_rows
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
            texts = pa.array([None if v is None else ",".join(map(str, v)) for v in wide], pa.string())
            packed = [_binary(code), _binary(_pack_upper(upper)), _binary(_pack_lower(lower).reshape(n, -1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(whole), texts, *packed, *none], names=_NAMES)
        if like is not None:
            part, entry, sums = zip(*work.totals(), strict=True)
            n = len(part)
            blank = [pa.nulls(n, like.field(0).type), pa.nulls(n, like.field(1).type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string()), *[pa.nulls(n, pa.binary())] * 3]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], names=_NAMES)

    return step


_NAMES = ["vec_id", "label", "whole", "wide", "code", "upper", "lower", "part", "entry", "sums"]


def _final_step(books: Codebooks):
    """The last assignment: code and exact error of every vector."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Round(books)
        w = books.width
        for batch in batches:
            whole, wide, code, upper, lower = _next_batch(batch, books)
            work.assign(whole, wide, code, upper, lower)
            errors = [0] * batch.num_rows
            large = np.array([v is not None for v in wide], dtype=bool)
            for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
                if not len(rows):
                    continue
                x = np.array([wide[i] for i in rows], dtype=object) if large[rows[0]] else whole[rows].astype(np.int64)
                for p in range(PARTS):
                    for i, e in zip(rows.tolist(), _squared(x[:, p * w : (p + 1) * w], books.arrays[p][code[rows, p]]).tolist(), strict=True):
                        errors[i] += e
            texts = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, pa.array([min(e, LARGEST) for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    return step


def _moved(books: Codebooks, sums: DataFrame) -> tuple[Codebooks, tuple[int, int]]:
    """The next codebooks from the tasks' sums, and (computed, possible) distances. What comes to
    the driver are the sums of entries x dimension numbers in their digits."""
    found = sums.select("part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    digits: dict[tuple[int, int], dict[int, int]] = {}
    for r in found:
        digits.setdefault((r["part"], r["entry"]), {})[r["at"]] = int(r["s"])
    work = digits.pop((-1, -1), {0: 0, 1: 0})
    entries = [[list(e) for e in part] for part in books.entries]
    w = books.width
    for (p, c), values in digits.items():
        count = values[0]
        total = [0] * w
        for at, s in values.items():
            if at:
                total[(at - 1) % w] += s << (DIGIT * ((at - 1) // w))
        entries[p][c] = [t // count for t in total]
    return Codebooks(entries, books), (work[0], work[1])


def _label_key(label: Column) -> Column:
    """A text for every label, null included, equal only for equal labels."""
    return F.when(label.isNull(), "n").otherwise(F.concat(F.lit("v"), label.cast("string")))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error. Totals are summed before the shuffle; rows of hot labels (at most
    HOT_LABELS, by arithmetic) take theirs from a broadcast table and are spread in the join."""
    rows = coded.withColumn("_key", _label_key(F.col("label")))
    totals = rows.groupBy("_key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("_total"), F.count(F.lit(1)).alias("_n"))
    least = F.lit(max(1, -(-coded.count() // HOT_LABELS)))
    hot = totals.where((F.col("_n") >= least) & (F.octet_length("_key") <= LABEL_BYTES)).select("_key", F.col("_total").alias("_hot"))
    spread = rows.join(F.broadcast(hot), "_key", "left").withColumn("_at", F.when(F.col("_hot").isNull(), F.col("_key")).otherwise(F.concat(F.lit("h"), F.xxhash64("vec_id", "code", "error").cast("string"))))
    return spread.join(totals.select(F.col("_key").alias("_at"), "_total"), "_at", "left").withColumn("label_error", F.coalesce("_hot", "_total")).drop("_key", "_at", "_hot", "_total")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None, list[tuple[int, int]]]:
    """(rows, codebooks, work): rows are a stored table of vec_id, label, code and error; work has
    for each round how many distances were computed of how many."""
    spark = vectors.sparkSession
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = read.where(_finite(F.col("vector")))
    result = T.StructType([read.schema["vec_id"], read.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    longest = kept.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    if longest is None:
        return spark.createDataFrame([], result), None, []
    width = max(1, -(-longest // PARTS))
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    firsts = [v + [0] * (width * PARTS - len(v)) for v in (_integers(r["vector"]) for r in seeds)]
    books = Codebooks([[v[p * width : (p + 1) * width] for v in firsts] for p in range(PARTS)])
    schema = _state_schema(read.schema["vec_id"], read.schema["label"])
    state, path, work = kept, None, []
    for number in range(ROUNDS):
        now, at = store(state.mapInArrow(_round_step(books, first=number == 0), schema), "codes")
        if path:
            discard(spark, path)
        state, path = now.where(F.col("part").isNull()), at
        books, done = _moved(books, now.where(F.col("part").isNotNull()).select("part", "entry", "sums"))
        work.append(done)
    coded, _ = store(state.mapInArrow(_final_step(books), result), "coded")
    discard(spark, path)
    return coded, books, work


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(table(spark, sf_dir, "embeddings"))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rounds without bounds, unrolled in DuckDB SQL: every distance of every round."""
    steps = [
        "raw as (select row_number() over (order by vec_id nulls last, embedding) - 1 as rid, vec_id, label, embedding::double[] as e from embeddings where embedding is not null "
        "and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"wide as (select (max(len(e)) + {PARTS - 1}) // {PARTS} as w from raw)",
        f"cells as (select rid, i // w as part, i % w as pos, cast(floor({SCALE} * coalesce(e[i + 1], 0)) as bigint) as v from raw, wide, unnest(range({PARTS} * w)) as u(i))",
        f"book0 as (select part, rid as entry, pos, v from cells where rid < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"far{k} as (select rid, c.part, entry, sum((c.v - b.v) * (c.v - b.v)) as d from cells c join book{k} b on c.part = b.part and c.pos = b.pos group by all)")
        steps.append(f"near{k} as (select rid, part, arg_min(entry, d * {ENTRIES} + entry) as entry, min(d) as d from far{k} group by all)")
        if k < ROUNDS:
            steps.append(f"sums{k} as (select c.part, entry, pos, sum(v) as s, count(*) as n from cells c join near{k} a on c.rid = a.rid and c.part = a.part group by all)")
            steps.append(f"book{k + 1} as (select b.part, b.entry, b.pos, coalesce((s - ((s % n + n) % n)) // n, b.v) as v from book{k} b left join sums{k} s on b.part = s.part and b.entry = s.entry and b.pos = s.pos)")
    last = f"near{ROUNDS}"
    steps.append(f"coded as (select rid, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from {last} group by rid)")
    steps.append(f"digest as (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from book{ROUNDS})")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from raw join coded using (rid), digest"
