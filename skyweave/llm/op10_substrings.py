"""Suffix-array dedup: remove every byte covered by a string of ``LENGTH`` bytes that also starts
anywhere else, in another document or in the same one.

1. Anchors. The k-gram of least hash in a string of LENGTH bytes (the first of them) is its
   anchor; equal strings have equal anchors at equal places. So only strings whose anchor's hash
   occurs twice can repeat. An anchor's context covers the strings that it is the anchor of;
   each string is in one context.
2. Contexts that occur twice as a whole (by 64-bit hashes of the context and of its anchor, length
   and place of the anchor) are repeated in all their strings.
3. The rest, different contexts of one anchor hash, go to shards by anchor hash; all
   occurrences of a string that may repeat meet there. A shard builds the suffix array of its
   contexts by Larsson-Sadakane refinement (only groups that are still tied are sorted again,
   by the ranks h further on, h doubling), and Kasai's scan gives the common prefixes of
   neighbours; runs of prefixes of LENGTH and more are equal strings. Starts of one string in
   overlapping contexts of one document count once.
4. An anchor hash with more than ``BLOCK`` contexts is dealt to several shards, and each pair of
   them is merged: the sorted strings of one are looked up in those of the other by binary
   search.

Nothing is capped: the number of contexts of an anchor only decides how many shards it has.

Defined results: a null text is empty; texts below LENGTH bytes lose nothing; rows with
equal text remove each other wholly; rows with null or equal doc_id are documents of their own;
an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import _BASE, _INVERSE, _powers, discard, mix, store, table

LENGTH, K = 200, 32
SPAN = LENGTH - K  # an anchor's string begins at most so many bytes before it
#: Contexts of one anchor hash in a shard, and bytes of contexts at which a suffix array closes.
BLOCK, SHARD_BYTES = 4000, 900_000


# ---------------------------------------------------------------- anchors


def _windows(x: np.ndarray, w: int, fold, neutral) -> np.ndarray:
    """fold over every window of w values, by running folds from both ends of blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, neutral, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = fold.accumulate(grid, axis=1).reshape(-1)
    behind = fold.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return fold(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, begin of the context, its length, place of the anchor in it, anchor hash,
    context hash) of all anchors of some texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 6
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE), out=total[1:])
        back = _powers(n + 1, _INVERSE)
        h = (total[K:] - total[:-K]) * back[: n - K + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h |= np.uint64(1)
        least = _windows(h, SPAN + 1, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
        # strings that run from one text into the next choose nothing
        ends = np.repeat(first + sizes, sizes)[: len(least)]
        least[np.arange(len(least)) + LENGTH > ends] = 0
        # an anchor is the least of some string that contains it
        reach = _windows(np.concatenate((np.zeros(SPAN, dtype=np.uint64), least, np.zeros(SPAN, dtype=np.uint64))), SPAN + 1, np.maximum, np.uint64(0))
        place = np.flatnonzero(reach == h)
        value = h[place]
        text = np.searchsorted(first, place, side="right") - 1
        # its strings hold no smaller hash, and no equal one before it
        low = np.maximum(place - SPAN, _nearest(place, value, -1) + 1)
        high = np.minimum(place, _nearest(place, value, 1) - SPAN - 1)
        low, high = np.maximum(low, first[text]), np.minimum(high, first[text] + sizes[text] - LENGTH)
        some = low <= high
        place, value, text, begin, end = place[some], value[some], text[some], low[some], high[some] + LENGTH
        context = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (place - begin).astype(np.uint64))
    return text, begin - first[text], end - begin, place - begin, value.view(np.int64), context.view(np.int64)


def _nearest(place: np.ndarray, value: np.ndarray, side: int) -> np.ndarray:
    """Place of the nearest anchor before (side -1: of equal or smaller value) or after (side 1:
    of smaller value) each anchor; far outside if there is none within a string's reach."""
    n = len(place)
    at = np.arange(n) + side
    far = -(1 << 40) * -side
    out = np.full(n, far, dtype=np.int64)
    open_ = np.arange(n)
    while len(open_):
        j = at[open_]
        inside = (j >= 0) & (j < n)
        open_, j = open_[inside], j[inside]
        near = np.abs(place[j] - place[open_]) <= SPAN
        open_, j = open_[near], j[near]
        stop = value[j] <= value[open_] if side < 0 else value[j] < value[open_]
        out[open_[stop]] = place[j[stop]]
        open_ = open_[~stop]
        at[open_] += side
    return out


def _anchor_rows():
    kind = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("len", pa.int16()), ("off", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            k = 0
            while k < len(texts):
                upto, held = k, 0
                while upto < len(texts) and (upto == k or held + len(texts[upto]) <= 1 << 20):
                    held += len(texts[upto])
                    upto += 1
                text, at, size, off, h, context = anchors(texts[k:upto])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(context), pa.array(ids[k:upto][text]), pa.array(at), pa.array(size.astype(np.int16)), pa.array(off.astype(np.int16))], schema=kind)
                k = upto

    return run


# ---------------------------------------------------------------- suffix arrays


class SuffixArray:
    """Ordered suffixes of several byte strings, each closed by a mark of its own."""

    def __init__(self, contexts: list[bytes]):
        sizes = np.array([len(c) for c in contexts], dtype=np.int64)
        self.text = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        self.first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(contexts)), sizes)
        n = len(self.text)
        self.left = (self.first + sizes)[self.owner] - np.arange(n)  # bytes to the context's end
        self._refine()

    def _refine(self) -> None:
        """Larsson-Sadakane: start from the order of 7-byte prefixes, then sort each group that
        is still tied by the ranks h further on, h growing with what is known. Each context ends
        with a mark of its own, below all bytes, so every order is decided within the contexts.
        In small arrays three ranks fit one sort key, so h grows threefold; else it doubles."""
        n = len(self.text)
        padded = np.zeros(n + 7, dtype=np.uint64)
        padded[:n] = self.text
        key = np.zeros(n, dtype=np.uint64)
        for k in range(7):
            key = (key << np.uint64(9)) | np.where(self.left > k, padded[k : k + n] + np.uint64(1), np.uint64(0))
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        # rank of a group: the place of its first member
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = start
        triple = n <= 1 << 20
        h = 7
        while True:
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(tied):
                break
            at = order[tied]
            key = rank[at]
            for step in (h, 2 * h) if triple else (h,):
                ahead = np.where(self.left[at] > step, rank[np.minimum(at + step, n - 1)] + n, self.owner[at])
                key = key * (2 * n) + ahead
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[tied] = at
            split = np.concatenate(([True], key[1:] != key[:-1]))
            new[tied] |= split
            start = np.maximum.accumulate(np.where(split, tied, 0))
            rank[at] = start
            h *= 3 if triple else 2
        self.order, self.rank = order, rank

    def common_prefixes(self) -> np.ndarray:
        """Kasai's scan, all contexts side by side: for each suffix in text order its common
        prefix with the one before it in suffix order, capped at LENGTH; a suffix's value is
        at least that of the one before it in its context less one."""
        n = len(self.text)
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        before = np.where(place > 0, self.order[place - 1], -1)
        sizes = np.diff(np.append(self.first, n))
        lcp = np.zeros(n, dtype=np.int64)
        carry = np.zeros(len(sizes), dtype=np.int64)
        for step in range(int(sizes.max()) - LENGTH + 1):
            lanes = np.flatnonzero(sizes - step >= LENGTH)
            i = self.first[lanes] + step
            j = before[i]
            length = np.maximum(carry[lanes] - 1, 0)
            limit = np.where(j >= 0, np.minimum(LENGTH, self.left[j]), 0)
            length = np.minimum(length, limit)
            open_ = np.flatnonzero(length < limit)
            while len(open_):
                same = self.text[i[open_] + length[open_]] == self.text[j[open_] + length[open_]]
                open_ = open_[same]
                length[open_] += 1
                open_ = open_[length[open_] < limit[open_]]
            lcp[i] = length
            carry[lanes] = length
        return lcp

    def starts(self) -> np.ndarray:
        """Starts of whole strings of LENGTH bytes, in suffix order."""
        return self.order[self.left[self.order] >= LENGTH]

    def strings(self, at: np.ndarray) -> np.ndarray:
        grid = np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[at]
        return np.ascontiguousarray(grid).view(f"S{LENGTH}").reshape(-1)


def repeated_in(array: SuffixArray, where: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which starts begin a string that starts at two places at least. ``where`` numbers the
    true place of each byte of the contexts; ``often`` says that a byte's context repeats."""
    lcp = array.common_prefixes()
    at = array.starts()
    out = np.zeros(len(array.text), dtype=bool)
    if not len(at):
        return out
    # neighbours in suffix order among whole strings are neighbours among all suffixes, for a
    # suffix between two equal strings has the same first LENGTH bytes and so is whole
    group = np.cumsum(np.concatenate(([True], lcp[at[1:]] < LENGTH))) - 1
    low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, where[at])
    np.maximum.at(high, group, where[at])
    many = np.bincount(group, weights=often[at]) > 0
    out[at] = ((low != high) | many)[group]
    return out


def _runs(flags: np.ndarray, array: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of the bytes covered by flagged strings, in each context."""
    at = np.flatnonzero(flags)
    owner = array.owner[at]
    new = np.concatenate(([True], (np.diff(at) > 1) | (owner[1:] != owner[:-1])))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    begin, end, own = at[new], at[last] + LENGTH, owner[new]
    return own, begin - array.first[own], end - array.first[own]


STEP = 8


def may_repeat(h: np.ndarray, off: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Which contexts share ``LENGTH - STEP`` bytes with another one of their anchor hash, at one
    of the places that are a multiple of STEP from the anchor; a shared string holds such a
    piece. Others need no suffix array."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    raw = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    piece = LENGTH - STEP
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), _BASE), out=total[1:])
        back = _powers(len(raw) + 1, _INVERSE)
        skip = off % STEP
        count = np.maximum((sizes - piece - skip) // STEP + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = first[owner] + skip[owner] + inner * STEP
        mark = mix((total[at + piece] - total[at]) * back[at] + h.view(np.uint64)[owner])
    order = np.argsort(mark)
    mark = mark[order]
    same = mark[1:] == mark[:-1]
    out = np.zeros(len(sizes), dtype=bool)
    out[owner[order[1:][same]]] = True
    out[owner[order[:-1][same]]] = True
    return out


def _shards():
    """Contexts, sorted by (h, i, j), to covered runs (rid, begin, end)."""
    kind = pa.schema([("rid", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def places(part: dict, array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        _, number = np.unique(part["rid"], return_inverse=True)
        inside = np.arange(len(array.text)) - array.first[array.owner]
        return (number.astype(np.int64) << 40)[array.owner] + part["at"][array.owner] + inside, (part["c"] > 1)[array.owner]

    def emit(part: dict, array: SuffixArray, flags: np.ndarray) -> pa.RecordBatch | None:
        flags &= (part["c"] == 1)[array.owner]  # contexts that repeat as a whole are known
        if not flags.any():
            return None
        own, begin, end = _runs(flags, array)
        return pa.RecordBatch.from_arrays([pa.array(part["rid"][own]), pa.array(part["at"][own] + begin), pa.array(part["at"][own] + end)], schema=kind)

    def columns(data: pa.Table, keep: np.ndarray | None = None) -> dict:
        if keep is not None:
            data = data.filter(pa.array(keep))
        return {k: data.column(k).to_numpy() for k in ("rid", "at", "c")} | {"bytes": data.column("bytes").to_pylist()}

    def solve(data: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = may_repeat(data.column("h").to_numpy(), data.column("off").to_numpy().astype(np.int64), data.column("bytes").to_pylist())
        if not keep.any():
            return
        part = columns(data, keep)
        array = SuffixArray(part["bytes"])
        where, often = places(part, array)
        found = emit(part, array, repeated_in(array, where, often))
        if found is not None:
            yield found

    def merge(data: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Two blocks of one large anchor: look up the strings of one in those of the other."""
        if block.min() == block.max():  # the other block of this pair has no context
            return
        parts = [columns(data, block == b) for b in np.unique(block)]
        arrays = [SuffixArray(p["bytes"]) for p in parts]
        starts = [a.starts() for a in arrays]
        text = [a.strings(s) for a, s in zip(arrays, starts)]
        for one, other in ((0, 1), (1, 0)):
            at = np.searchsorted(text[other], text[one])
            at[at == len(text[other])] = 0
            same = text[other][at] == text[one] if len(text[other]) else np.zeros(len(text[one]), dtype=bool)
            flags = np.zeros(len(arrays[one].text), dtype=bool)
            # equal strings of one document can be one place in two contexts; all equal ones of
            # the other block are looked at
            if same.any():
                hit = np.flatnonzero(same)
                upto = np.searchsorted(text[other], text[one][hit], side="right")
                rid_one, rid_other = parts[one]["rid"], parts[other]["rid"]
                place_one = parts[one]["at"][arrays[one].owner[starts[one]]] + starts[one] - arrays[one].first[arrays[one].owner[starts[one]]]
                place_other = parts[other]["at"][arrays[other].owner[starts[other]]] + starts[other] - arrays[other].first[arrays[other].owner[starts[other]]]
                own_one, own_other = rid_one[arrays[one].owner[starts[one]]], rid_other[arrays[other].owner[starts[other]]]
                many = (parts[other]["c"] > 1)[arrays[other].owner[starts[other]]]
                for k, a, b in zip(hit.tolist(), at[hit].tolist(), upto.tolist()):
                    while a < b and not many[a] and own_other[a] == own_one[k] and place_other[a] == place_one[k]:
                        a += 1
                    flags[starts[one][k]] = a < b
            found = emit(parts[one], arrays[one], flags)
            if found is not None:
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def closed(data: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
            """Whole groups go; the last one may go on in the next batch and is kept."""
            nonlocal held
            marks = np.stack([data.column(c).to_numpy() for c in ("h", "i", "j")])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), data.num_rows]
            upto = len(edges) - 1 if final else len(edges) - 2
            size = np.cumsum([0, *(len(b) for b in data.column("bytes").to_pylist())])
            # small groups share a suffix array: its strings are real ones whatever their anchor
            begin = 0
            for k in range(upto):
                a, b = edges[k], edges[k + 1]
                paired = marks[1, a] != marks[2, a]
                if paired:
                    if a > begin:
                        yield from solve(data.slice(begin, a - begin))
                    yield from merge(data.slice(a, b - a), data.column("block").to_numpy()[a:b])
                    begin = b
                elif size[b] - size[begin] >= SHARD_BYTES or k == upto - 1:
                    yield from solve(data.slice(begin, b - begin))
                    begin = b
            if begin < edges[upto]:
                yield from solve(data.slice(begin, edges[upto] - begin))
            held = data.slice(edges[upto])

        for batch in batches:
            if batch.num_rows:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if held.nbytes >= 4 * SHARD_BYTES:
                    yield from closed(held, False)
        if held is not None and held.num_rows:
            yield from closed(held, True)

    return run


def _cut_contexts():
    kind = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("c", pa.int64()), ("m", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("off", pa.int16()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            lists = batch.column(2)
            rows, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
            own = np.repeat(np.arange(len(texts)), count)
            at, size = rows.field("at").to_numpy(), rows.field("len").to_numpy().astype(np.int64)
            cut = [(texts[k] or b"")[a:b] for k, a, b in zip(own.tolist(), at.tolist(), (at + size).tolist())]
            yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in ("h", "ctx", "c", "m")), batch.column(0).take(pa.array(own)), rows.field("at"), rows.field("off"), pa.array(cut, pa.binary())], schema=kind)

    return run


def _finish():
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                text = text or b""
                kept, at, removed, spans, reach = [], 0, 0, 0, -1
                for run_ in sorted((r["begin"], r["end"]) for r in runs or ()):
                    begin, end = run_[0], min(run_[1], len(text))
                    if begin > reach:  # a run of its own
                        spans += 1
                        kept.append(text[at:begin])
                        removed += end - begin
                        at = reach = end
                    elif end > reach:
                        removed += end - reach
                        at = reach = end
                kept.append(text[at:])
                rows.append((doc_id, len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kind.types)] if rows else [pa.array([], t) for t in kind.types], schema=kind)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text) with a number of its own for each row: doc_id where it serves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    if (found["most"] or 1) == 1 and not found["none"]:
        return rows.withColumn("rid", F.col("doc_id"))
    return store(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered")[0]


def covered_runs(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """(rid, begin, end): runs of bytes to remove, overlapping ones not yet joined."""
    spark = rows.sparkSession
    all_anchors, p1 = store(rows.select("rid", "text").mapInArrow(_anchor_rows(), "h long, ctx long, rid long, at long, len short, off short"), "anchors")
    # counts are tables of their own: the joins with them have plain sides, whose hot keys are split
    twice, p_twice = store(all_anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    shared, p2 = store(all_anchors.join(twice, "h"), "shared-anchors")
    discard(spark, p1, p_twice)
    own = ["h", "ctx", "len", "off"]
    contexts, p3 = store(shared.groupBy(*own).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "at")).alias("r")), "contexts")
    repeated, p_repeated = store(contexts.where("c > 1").select(*own), "repeated")
    several, p_several = store(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    whole, p5 = store(shared.join(repeated, own).select("rid", F.col("at").alias("begin"), (F.col("at") + F.col("len")).alias("end")), "whole")
    discard(spark, p2, p_repeated)
    open_ = contexts.join(several, "h").select("h", "ctx", "c", "m", "r.rid", "r.at", "len", "off")
    per_row = open_.groupBy("rid").agg(F.collect_list(F.struct("h", "ctx", "c", "m", "at", "len", "off")).alias("rows"))  # anchors of one text
    cut = rows.select("rid", "text").join(per_row, "rid").select("rid", "text", "rows").mapInArrow(_cut_contexts(), "h long, ctx long, c long, m long, rid long, at long, off short, bytes binary")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = cut.withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64("ctx", F.lit("block")), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("h", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rid", "at", "off", "c", "bytes")
    dealt = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    partly, p4 = store(dealt.mapInArrow(_shards(), "rid long, begin long, end long"), "runs")
    discard(spark, p3, p_several)
    return whole.union(partly), [p4, p5]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    rows = _numbered(docs)
    runs, _ = covered_runs(rows)
    per_row = runs.groupBy("rid").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))  # runs of one text
    return rows.join(per_row, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_finish(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
