"""Embedding near-duplicates: spherical-cap filters with structured random product codes.

Vectors are normalised in double precision and turned by random signs and a Hadamard
transform. Filter directions are a product code: ``M`` blocks of coordinates with ``C`` random
unit codewords each, and every tuple of codewords is one direction. A vector is list-decoded to
all directions whose inner product exceeds a threshold, and to its ``LEAST`` best ones where
fewer do: partial sums over the first blocks are merged block by block and only those that can
still matter are kept. Vectors of equal label that share a direction meet in a bucket, where
blocked matrix products find all pairs with the wanted cosine.

A pair is counted only in the first bucket that both vectors share, so link counts need no list
of pairs; each bucket hands on one tree edge for every vector that it connects. Equal vectors
of a label are one class with a multiplicity. Buckets above ``BLOCK`` members are dealt into
blocks, and each pair of blocks is a group of its own. The number of directions grows with the largest
label, so that buckets stay near ``BUCKET`` members.

A pair at the threshold misses all common directions with a probability below 1e-4 (measured
against brute force in the tests); closer pairs far less.

Defined results: a null label, and a vector that is null, empty, all zero or has null or
non-finite components, link with nothing and get 0 links and their own id as component; vectors
of different lengths do not link; rows with equal vec_id are one node for components, each
counted as a vector; a null vec_id keeps null component and kept. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import store, table
from skyweave.llm.components import components

COSINE = 0.98
#: Directions that a vector exceeds on average, and at least; members of a bucket on average.
EXPECTED, LEAST, BUCKET = 24, 16, 64
#: Members of a bucket that one task compares at once.
BLOCK = 2000
SEED = 977


class ProductCode:
    """Structured random directions for vectors of one length."""

    def __init__(self, dim: int, directions: int):
        self.size = 1 << max(2, (dim - 1).bit_length())
        self.blocks = max(2, math.ceil(math.log(max(2, directions)) / math.log(256)))
        self.blocks = min(self.blocks, self.size)
        self.words = max(4, math.ceil(directions ** (1 / self.blocks)))
        rng = np.random.default_rng([SEED, dim, self.words])
        self.dim = dim
        self.signs = rng.choice([-1.0, 1.0], self.size)
        edges = np.linspace(0, self.size, self.blocks + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        self.codes = []
        for part in self.parts:
            code = rng.standard_normal((part.stop - part.start, self.words))
            self.codes.append(code / np.linalg.norm(code, axis=0) / math.sqrt(self.blocks))
        share = min(0.5, EXPECTED / self.words**self.blocks)
        self.threshold = NormalDist().inv_cdf(1 - share) / math.sqrt(self.size)

    def turn(self, unit: np.ndarray) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : self.dim] = unit
        x *= self.signs
        step = 1
        while step < self.size:
            y = x.reshape(len(x), -1, 2, step)
            x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(unit), self.size)
            step *= 2
        return x / math.sqrt(self.size)

    def decode(self, unit: np.ndarray, width: int = 96) -> list[np.ndarray]:
        """For each vector the sorted numbers of its directions. The ``width`` best sums over
        the first blocks hold the ``width`` best directions; a vector with more is redone."""
        turned = self.turn(unit)
        sums = names = None
        for part, code in zip(self.parts, self.codes):
            score = turned[:, part] @ code
            if sums is None:
                sums, names = score, np.broadcast_to(np.arange(self.words), score.shape)
            else:
                sums = (sums[:, :, None] + score[:, None, :]).reshape(len(unit), -1)
                names = (names[:, :, None] * self.words + np.arange(self.words)).reshape(len(unit), -1)
            if sums.shape[1] > width:
                best = np.argpartition(-sums, width - 1, axis=1)[:, :width]
                sums, names = np.take_along_axis(sums, best, 1), np.take_along_axis(names, best, 1)
        order = np.argsort(-sums, axis=1, kind="stable")
        sums, names = np.take_along_axis(sums, order, 1), np.take_along_axis(names, order, 1)
        count = np.maximum((sums >= self.threshold).sum(axis=1), min(LEAST, sums.shape[1]))
        out = [np.sort(names[k, :n]) for k, n in enumerate(count)]
        for k in np.flatnonzero(count == width) if self.words**self.blocks > width else ():
            out[k] = self.decode(unit[k : k + 1], width * 4)[0]
        return out


def _units(column: pa.Array) -> tuple[list[int], np.ndarray]:
    raw = [np.array(v, dtype=np.float64) for v in column.to_pylist()]
    unit = np.stack(raw) if raw else np.zeros((0, 1))
    return unit / np.linalg.norm(unit / np.abs(unit).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(unit).max(axis=1, keepdims=True)


def _filters(directions: int):
    kind = pa.schema([("cid", pa.int64()), ("unit", pa.binary()), ("filters", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                dims = np.array([len(v) for v in batch.column(1)])
                for dim in np.unique(dims):
                    if dim not in codes:
                        codes[dim] = ProductCode(int(dim), directions)
                    own = batch.filter(pa.array(dims == dim))
                    unit = _units(own.column(1))
                    found = codes[dim].decode(unit)
                    yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], schema=kind)

    return run


def _first_shared(filters: np.ndarray, a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether ``here`` is the smallest direction that the vectors a and b share; rows of
    ``filters`` are sorted and padded with -1."""
    out = np.ones(len(a), dtype=bool)
    for k in range(0, len(a), 20_000):
        x, y = filters[a[k : k + 20_000]], filters[b[k : k + 20_000]]
        for c in range(filters.shape[1]):
            v = x[:, c]
            early = (v >= 0) & (v < here)
            if not early.any():
                break
            out[k : k + 20_000] &= ~(early & (y == v[:, None]).any(axis=1))
    return out


def _pairs_in(unit: np.ndarray, block: np.ndarray, filters: np.ndarray, here: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    crossing = block.min() != block.max()
    for k in range(0, len(unit), 256):
        cos = unit[k : k + 256] @ unit[k:].T
        a, b = np.nonzero(cos >= COSINE)
        keep = a < b
        a, b = a[keep] + k, b[keep] + k
        if crossing:
            keep = block[a] != block[b]
            a, b = a[keep], b[keep]
        if len(a):
            yield a, b, _first_shared(filters, a, b, here)


def _bucket_links():
    """Links inside each bucket block; rows come sorted by (bucket, i, j).

    Emits (a, b, links): with a = b the number of vectors that a links with here, else an edge
    of a forest that connects what this bucket links."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def bucket(part: pa.Table) -> pa.RecordBatch | None:
        cid, many = part.column("cid").to_numpy(), part.column("many").to_numpy()
        unit = np.frombuffer(b"".join(part.column("unit").to_pylist()), dtype=np.float64).reshape(len(cid), -1)
        lists = part.column("filters").to_pylist()
        filters = np.full((len(cid), max(map(len, lists))), -1, dtype=np.int64)
        for k, f in enumerate(lists):
            filters[k, : len(f)] = f
        links = np.zeros(len(cid), dtype=np.int64)
        root = np.arange(len(cid))
        for a, b, first in _pairs_in(unit, part.column("block").to_numpy(), filters, part.column("filter")[0].as_py()):
            links += np.bincount(a[first], weights=many[b[first]], minlength=len(cid)).astype(np.int64)
            links += np.bincount(b[first], weights=many[a[first]], minlength=len(cid)).astype(np.int64)
            while True:  # hook the roots of linked vectors to the smaller one, then flatten
                x, y = root[a], root[b]
                open_ = x != y
                if not open_.any():
                    break
                low, high = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
        linked = np.flatnonzero(links)
        hung = np.flatnonzero(root != np.arange(len(cid)))
        if not len(linked) and not len(hung):
            return None
        columns = (np.concatenate((cid[linked], cid[hung])), np.concatenate((cid[linked], cid[root[hung]])), np.concatenate((links[linked], np.zeros(len(hung), dtype=np.int64))))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def closed(data: pa.Table, final: bool) -> tuple[pa.Table, list[pa.RecordBatch]]:
            marks = np.stack([data.column(c).to_numpy() for c in ("group", "filter", "i", "j")])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), data.num_rows]
            upto = len(edges) - 1 if final else len(edges) - 2
            found = [bucket(data.slice(edges[k], edges[k + 1] - edges[k])) for k in range(upto) if edges[k + 1] - edges[k] > 1]
            return data.slice(edges[upto]), [x for x in found if x is not None]

        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                held, found = closed(new if held is None else pa.concat_tables([held, new]), False)
                yield from found
        if held is not None and held.num_rows:
            yield from closed(held, True)[1]

    return run


def link(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    fit = rows.where(valid & F.col("vec_id").isNotNull())
    # equal vectors of a label are one class, named by a 64-bit hash; its node in the graph is its
    # smallest vec_id
    classes = fit.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("many"))
    classes, p1 = store(classes.withColumn("cid", F.xxhash64("label", "v")), "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0
    directions = max(64, largest * EXPECTED // BUCKET)
    group = F.xxhash64("label", F.size("v"))
    described, p2 = store(classes.select("cid", "v").mapInArrow(_filters(directions), "cid long, unit binary, filters array<long>").join(classes.select("cid", "node", "many", group.alias("group")), "cid"), "filters")
    light = described.select("group", F.explode("filters").alias("filter"), "cid")
    counts = light.groupBy("group", "filter").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = light.join(counts, ["group", "filter"]).withColumn("n", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("group", "filter", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "cid")
    full = dealt.join(described.select("cid", "unit", "filters", "many"), "cid").select("group", "filter", "i", "j", "block", "cid", "unit", "filters", "many")
    full = full.repartition("group", "filter", "i", "j").sortWithinPartitions("group", "filter", "i", "j", "cid")
    found, p3 = store(full.mapInArrow(_bucket_links(), "a long, b long, links long"), "links")
    links = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    names = described.select("cid", "node")
    edges = found.where("a != b").select("a", "b").distinct()
    edges = edges.join(names.select(F.col("cid").alias("a"), F.col("node").alias("x")), "a").join(names.select(F.col("cid").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = fit.select("vec_id", F.xxhash64("label", "v").alias("cid")).join(described.select("cid", "node", "many"), "cid")
    repeated = fit.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("vec_id")
    same = members.join(repeated, "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    comp, p4 = components(edges.union(same).where("a != b").distinct())
    per_class = described.select("cid", "node", "many").join(links, "cid", "left").join(comp.withColumnRenamed("component", "c"), "node", "left")
    per_class = per_class.select("cid", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("c", "node").alias("c"))
    key = F.when(valid & F.col("vec_id").isNotNull(), F.xxhash64("label", "v"))
    out = rows.select("vec_id", key.alias("cid")).join(per_class, "cid", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
