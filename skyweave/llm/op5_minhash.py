"""MinHash near-duplicates: universal hash minima, banding, verification, components.

A document's set holds its distinct word shingles. ``BANDS * ROWS`` universal hashes give the
minima of each set; equal minima in all rows of a band put documents in one bucket. Documents
of equal sets (by their size and two 64-bit fingerprints) are one class and take part once. Pairs of a bucket are first compared by their
signatures, and what may reach the similarity is confirmed on the full sets. Components are
built by alternating large-star and small-star steps.

No bucket is expanded into pairs: first every member is compared with the bucket's smallest
member; then the members of buckets that still hold several components meet with their sets in
one task (in blocks, if the bucket is large), which compares signatures, confirms what they
allow on the full sets, each pair in the first bucket that it shares, and emits no more than
one edge for each member. So every pair of a bucket whose signatures allow the similarity is
confirmed or already connected. A pair at the threshold shares no bucket with probability
``(1 - 0.8^ROWS)^BANDS`` = 3e-5, and its signatures miss the screen (five deviations) less often.

Defined results: null and empty texts and texts without words have empty sets and link with
nothing; rows with equal doc_id are one node with the links of all of them; a null doc_id
links with nothing and has null component and kept; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import discard, shingle_sets, store, table
from skyweave.llm.components import components

BANDS, ROWS = 26, 5
#: Similarity as a fraction, and the share of equal minima below which a pair is not confirmed.
SIMILAR = (80, 100)
SCREEN = 0.62
#: Members of a bucket, and shingles of all of them, that make up a block.
BLOCK, BLOCK_SHINGLES = 400, 1_500_000

_RNG = np.random.default_rng(20240501)
_A = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).reshape(-1, 1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32).reshape(-1, 1)
_SALT = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(out, (_A * x[k : k + 1024] + _B).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = _SALT.copy()
        for column in least.reshape(BANDS, ROWS).T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _text_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _describe(width: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = shingle_sets(_text_bytes(batch.column(1)), width)
                rows = []
                for s in sets:
                    if not len(s):
                        rows.append((0, 0, 0, [], b""))
                        continue
                    least = minima(s)
                    with np.errstate(over="ignore"):
                        f1 = int(np.bitwise_xor.reduce(s * np.uint64(0x9FB21C651E98DF25))) ^ len(s)
                        f2 = int(np.add.reduce(s ^ (s >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)))
                    rows.append((len(s), f1 - (1 << 64) if f1 >> 63 else f1, f2 - (1 << 64) if f2 >> 63 else f2, band_keys(least).tolist(), least.astype(np.uint16).tobytes()))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())] + [pa.array(list(c), t) for c, t in zip(columns, kind.types[1:])], schema=kind)

    return run


def _sets(width: int):
    kind = pa.schema([("node", pa.int64()), ("set", pa.binary()), ("sig", pa.binary()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = shingle_sets(_text_bytes(batch.column(1)), width)
                least = [minima(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([m.astype(np.uint16).tobytes() for m in least], pa.binary()), pa.array([band_keys(m).tobytes() for m in least], pa.binary())], schema=kind)

    return run


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal minima of two signatures."""
    if not len(a):
        return pd.Series([], dtype="float64")
    left = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), -1)
    right = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), -1)
    return pd.Series((left == right).mean(axis=1))


@F.pandas_udf(T.BooleanType())
def _confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two full sets reach the similarity."""
    out = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(a, b)):
        u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = np.concatenate((u, v))
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        out[k] = SIMILAR[1] * shared >= SIMILAR[0] * (len(both) - shared)
    return pd.Series(out)


def _candidates(comp: np.ndarray, size: np.ndarray, block: np.ndarray, sig: np.ndarray, keys: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that the signatures allow and that share no earlier bucket."""
    crossing = block.min() != block.max()  # two blocks of a large bucket: only pairs across them
    left, right = [], []
    for k in range(0, len(comp), 64):
        part = slice(k, k + 64)
        fit = comp[part][:, None] != comp[None, k:]
        if crossing:
            fit &= block[part][:, None] != block[None, k:]
        small, large = np.minimum(size[part][:, None], size[None, k:]), np.maximum(size[part][:, None], size[None, k:])
        fit &= SIMILAR[1] * small >= SIMILAR[0] * large
        a, b = np.nonzero(fit)
        keep = a < b
        a, b = a[keep] + k, b[keep] + k
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            keep = (sig[x] == sig[y]).sum(axis=1) >= SCREEN * sig.shape[1]
            x, y = x[keep], y[keep]
            shared = keys[x] == keys[y]
            first = shared.argmax(axis=1)
            keep = shared.any(axis=1) & (keys[x, first] == here)
            left.append(x[keep])
            right.append(y[keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


def _linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs reach the similarity on their full sets."""
    size = np.array([len(s) for s in sets])
    if len(a) <= 4000:
        shared = np.empty(len(a), dtype=np.int64)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            both = np.concatenate((sets[x], sets[y]))
            both.sort(kind="stable")
            shared[k] = (both[1:] == both[:-1]).sum()
    else:  # sizes of all intersections at once, some shingles at a time
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        _, code, count = np.unique(flat[order], return_inverse=True, return_counts=True)
        owner = owner[order]
        twice = count[code] > 1
        code, owner = (np.cumsum(count > 1) - 1)[code[twice]], owner[twice]
        inter = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            x, y = np.searchsorted(code, (low, low + 4096))
            has = np.zeros((len(sets), 4096), dtype=np.float32)
            has[owner[x:y], code[x:y] - low] = 1
            inter += has @ has.T
        shared = inter[a, b].astype(np.int64)
    return SIMILAR[1] * shared >= SIMILAR[0] * (size[a] + size[b] - shared)


def _bucket_edges():
    """Links inside each bucket block; rows come sorted by (key, i, j)."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bucket(part: pa.Table) -> pa.RecordBatch | None:
        comp = part.column("comp").to_numpy()
        if comp.min() == comp.max():
            return None
        numbers = lambda c, t: np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=t).reshape(len(comp), -1)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in part.column("set").to_pylist()]
        size = np.array([len(s) for s in sets])
        a, b = _candidates(comp, size, part.column("block").to_numpy(), numbers("sig", np.uint16), numbers("keys", np.int64), part.column("key")[0].as_py())
        if not len(a):
            return None
        good = _linked(sets, a, b)
        a, b = a[good], b[good]
        _, group = np.unique(comp, return_inverse=True)
        root = np.arange(group.max() + 1)
        while True:  # hook the larger of two linked roots to the smaller, then flatten
            x, y = root[group[a]], root[group[b]]
            open_ = x != y
            if not open_.any():
                break
            np.minimum.at(root, np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_]))
            while (root[root] != root).any():
                root = root[root]
        moved = np.flatnonzero(root != np.arange(len(root)))
        if not len(moved):
            return None
        node = np.zeros(len(root), dtype=np.int64)
        node[group] = part.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def closed(data: pa.Table, final: bool) -> tuple[pa.Table, list[pa.RecordBatch]]:
            marks = np.stack([data.column(c).to_numpy() for c in ("key", "i", "j")])
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


def _spread(placed: DataFrame) -> DataFrame:
    """Deal the members of buckets that hold several components into pairs of blocks.

    ``placed`` has key, node, n_shingles, comp. Members of one component need no comparison, so
    in a bucket beyond one block those of its largest component meet only the others: a large
    component with few others goes out about once, and the others once for each of its blocks."""
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
    per = per.groupBy("key").agg(F.max(F.struct("c", "comp", "w")).alias("hub"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("c"), F.sum("w").alias("w")).where("comps > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    per = per.select("key", F.col("hub.comp").alias("hub"), (blocks(F.col("c"), F.col("w")) == 1).alias("whole"), blocks(F.col("hub.c"), F.col("hub.w")).alias("nh"), blocks(F.col("c") - F.col("hub.c"), F.col("w") - F.col("hub.w")).alias("nr"))
    rows = placed.join(per, "key")
    in_hub = F.col("comp") == F.col("hub")
    dealt = F.xxhash64("node", F.lit("block"))
    block = F.when(F.col("whole"), 0).when(in_hub, F.pmod(dealt, F.col("nh"))).otherwise(F.col("nh") + F.pmod(dealt, F.col("nr"))).cast("int")
    rows = rows.withColumn("block", block)
    pair = lambda i, j: F.struct(F.least(i, j).cast("int").alias("i"), F.greatest(i, j).cast("int").alias("j"))
    me, others = F.col("block"), F.sequence(F.col("nh"), F.col("nh") + F.col("nr") - 1)
    to_others = F.transform(others, lambda o: pair(me, o))
    to_hub = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda o: pair(me, o))
    groups = F.when(F.col("whole"), F.array(pair(F.lit(0), F.lit(0)))).when(in_hub, to_others).otherwise(F.concat(to_hub, to_others))
    return rows.withColumn("_g", F.explode(groups)).select("key", "_g.i", "_g.j", "block", "node", "comp")


def link(docs: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_shingles, component_id, kept) of every row, and the work tables that it reads.

    If ``docs`` is stored dealt by doc_id (``store_dealt``), no step shuffles texts; else one
    does, for the sets of documents that share a bucket."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    described, p1 = store(rows.mapInArrow(_describe(width), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sig binary"), "minhash")
    known = described.where("n_shingles > 0 and doc_id is not null")
    classes, p2 = store(known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"), F.any_value("sig").alias("sig")), "classes")
    buckets = classes.select("node", "n_shingles", F.explode("keys").alias("key"))
    multi = buckets.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("_m")).where("center < _m").drop("_m")
    members, p3 = store(buckets.join(multi, "key"), "buckets")
    need = members.select("node").distinct().withColumnRenamed("node", "doc_id").hint("shuffle_hash")
    sets, p4 = store(rows.join(need, "doc_id", "left_semi").mapInArrow(_sets(width), "node long, set binary, sig binary, keys binary"), "sets")
    signatures = classes.select("node", F.col("n_shingles").alias("n"), "sig")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        return pairs.join(left, "a").join(right, "b").where(_confirmed("sa", "sb")).select("a", "b").distinct()

    stars = members.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    left = signatures.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    right = signatures.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"))
    sized = stars.join(left, "a").join(right, "b").where(SIMILAR[1] * F.least("na", "nb") >= SIMILAR[0] * F.greatest("na", "nb"))
    screened = sized.where(_agreement("ga", "gb") >= SCREEN).select("a", "b").distinct()
    links, p5 = store(confirm(screened), "links")
    # rows of one doc_id with different sets are one node
    repeated = known.select("doc_id", "f1", "f2", "n_shingles").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    same = known.select("doc_id", "f1", "f2", "n_shingles").join(repeated, "doc_id").join(classes.select("f1", "f2", "n_shingles", "node"), ["f1", "f2", "n_shingles"])
    same, p6 = store(same.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a != b").distinct(), "same")
    comp, p7 = components(links.union(same))
    placed = members.join(comp, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("comp"))
    active = _spread(placed).join(sets, "node").select("key", "i", "j", "block", "node", "comp", "set", "sig", "keys")
    dealt = active.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    more, p8 = store(dealt.mapInArrow(_bucket_edges(), "a long, b long").distinct(), "links")
    discard(spark, p3, p4, p7)
    comp, p9 = components(links.union(more).union(same))
    discard(spark, p5, p6, p8)
    node = classes.select("f1", "f2", "n_shingles", "node").join(comp, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "node").alias("c"))
    node, p10 = store(node, "class-components")
    discard(spark, p2, p9)
    result = described.select("doc_id", "n_shingles", "f1", "f2").join(node, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    result = result.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return result, [p1, p10]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), 2)[0]
