"""Benchmark decontamination: q-gram lemma filter and banded alignment.

Texts and benchmark items are normalised (lower case; runs of white space and ASCII punctuation
become one space); characters are the bytes of what that leaves. A document leaks an item if some
``w = min(length of the item, WINDOW)`` consecutive characters of the item align with a region of
the text with at most ``w / PER_EDIT`` edits. By the q-gram lemma such a region shares at least
``w + 1 - q (k + 1)`` q-grams with those characters along diagonals that differ by at most k. So
the shared q-grams of a text and all items are counted in diagonal bands of width 2k that overlap
by k, windows of the item that meet the bound in a band are kept, and a banded edit-distance
alignment of each of them, all windows of a band at once, decides.

Counting is exact for every q-gram, however frequent. To keep it cheap, hits are first summed
by (text block, item): a region lies in two neighbouring blocks, so hits of an item that has
fewer than the bound there cannot matter. Repetition costs nothing more: windows of an item that
are equal count once, by their first place, so an item of one repeated line is as small as the
line; a text is searched in segments that overlap by more than a window, so the hits held at once
are bounded by a segment; equal pieces of a text are aligned once; and a band whose hits lie inside
a region that is found already isn't aligned. Regions of an item that meet are one leak.

The lemma gives no bound for items below ``SHORTEST`` characters. They match without edits and
between word borders, and are found by an automaton over all of them.

The items' q-gram index goes to the executors in parts of at most ``PART_CHARS`` characters of
items (or one longer item). A larger benchmark takes several passes over the documents, each with
one part: the rows are then numbered and stored once, of a pass only the numbers of leaking rows
and their leaks are stored, and its index is released before the next.

Defined results: null and empty texts and items match nothing; equal items report all their ids,
also null ones; rows of documents stay as they are, repeated or not; an empty benchmark leaves all
documents clean. A region's begin is exact to the edits of its window. The result is the last
column; where documents have a column of that name, underscores are added to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import _powers, discard, fresh, store, store_dealt, table

#: q-gram length in bytes, window of the edit budget, characters for each edit, items that may have
#: edits.
Q, WINDOW, PER_EDIT, SHORTEST = 8, 100, 10, 40
#: Characters of items in the index of one pass.
PART_CHARS = 4_000_000
#: Windows of an item that are aligned at once.
_GROUP = 2000
#: Bytes of a text that are searched at once, and by how much such segments overlap: more than a
#: window with its edits.
SEGMENT, OVERLAP = 1 << 15, 256
_BITS = 22
_BREAK = re.compile(r"[\s!-/:-@\[-`{-~]+")


def normalise(text: str | None) -> bytes:
    return _BREAK.sub(" ", (text or "").lower()).strip().encode("utf-8", "surrogatepass")


def grams(data: bytes) -> np.ndarray:
    """The 8-byte grams at every place, as numbers."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    padded = data + b"\0" * Q
    for k in range(Q):
        out[k::Q] = np.frombuffer(padded, dtype="<u8", count=(n - k + Q - 1) // Q, offset=k)
    return out


def _cell(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).view(np.int64)


def first_windows(text: bytes, w: int) -> np.ndarray:
    """For each window of ``w`` bytes whether no earlier one is equal. Windows are told apart by a
    hash; those that seem to repeat are compared."""
    n = len(text) - w + 1
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(raw * _powers(len(raw), base))))
        value = (total[w:] - total[:-w]) * _powers(n, pow(base, -1, 1 << 64))
    keep = np.ones(n, dtype=bool)
    _, first, code = np.unique(value, return_index=True, return_inverse=True)
    for s in np.flatnonzero(first[code] != np.arange(n)).tolist():
        f = int(first[code[s]])
        keep[s] = text[s : s + w] != text[f : f + w]
    return keep


@dataclass
class Index:
    """q-grams of the items of one part."""

    ids: list[int | None]  # item id; the short items stand last
    texts: list[bytes]
    window: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray  # distinct grams, sorted
    first: np.ndarray  # postings of each gram: places[first[g]:first[g + 1]]
    items: np.ndarray
    places: np.ndarray
    sieve: np.ndarray  # which hash cells have a gram
    band: int
    block: int
    starts: list[np.ndarray | None]  # places of an item's windows that repeat no earlier one; None: all
    short: dict[str, list[int]]  # items without edits, between blanks

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]]) -> "Index | None":
        known = [(i, t) for i, t in ((i, normalise(t)) for i, t in rows) if t]
        if not known:
            return None
        known.sort(key=lambda x: len(x[1]) < SHORTEST)
        long = sum(len(t) >= SHORTEST for _, t in known)
        short: dict[str, list[int]] = {}
        for k in range(long, len(known)):
            short.setdefault(f" {known[k][1].decode('utf-8', 'surrogatepass')} ", []).append(k)
        size = np.array([len(t) for _, t in known[:long]], dtype=np.int64)
        window = np.minimum(size, WINDOW)
        budget = window // PER_EDIT
        flats, spots, starts = [], [], []
        for (_, t), w in zip(known[:long], window.tolist(), strict=True):
            own, keep = grams(t), first_windows(t, w)
            starts.append(None if keep.all() else np.flatnonzero(keep))
            # places of q-grams in windows that are kept
            edge = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(edge, np.flatnonzero(keep), 1)
            np.add.at(edge, np.minimum(np.flatnonzero(keep) + w - Q + 1, len(own)), -1)
            used = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            flats.append(own[used])
            spots.append(used.astype(np.int32))
        flat = np.concatenate([*flats, np.zeros(0, dtype=np.uint64)])
        items = np.repeat(np.arange(long, dtype=np.int32), [len(g) for g in flats])
        places = np.concatenate([*spots, np.zeros(0, dtype=np.int32)])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        sieve = np.zeros(1 << _BITS, dtype=bool)
        sieve[_cell(keys)] = True
        most = int(budget.max(initial=1))
        block = int(2 ** np.ceil(np.log2(window.max(initial=1) + 2 * most + Q)))
        return Index([i for i, _ in known], [t for _, t in known], window, budget, window + 1 - Q * (budget + 1), keys, np.append(first, len(flat)), items[order], places[order], sieve, most, block, starts, short)

    def find_short(self, data: bytes) -> list[tuple[int, int, int]]:
        """Items without edits, wherever they stand between word borders."""
        if not self.short or not data:
            return []
        if not hasattr(self, "automaton"):
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for text in self.short:
                self.automaton.add_word(text, text)
            self.automaton.make_automaton()
        text = f" {data.decode('utf-8', 'surrogatepass')} "
        wide = len(text) != len(data) + 2
        found = []
        for last, word in self.automaton.iter(text):
            begin = last - len(word) + 1
            at = len(text[1 : begin + 1].encode("utf-8", "surrogatepass")) if wide else begin
            found += [(k, at, at + len(self.texts[k])) for k in self.short[word]]
        return found

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """Leaks as (item number, begin, end) in bytes of the normalised text."""
        return self.find_long(data) + self.find_short(data)

    def find_long(self, data: bytes) -> list[tuple[int, int, int]]:
        """Leaks of items with edits, segment by segment of the text."""
        g = grams(data)
        if not len(g) or not len(self.bound):
            return []
        at = np.flatnonzero(self.sieve[_cell(g)])
        key = np.searchsorted(self.keys, g[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == g[at]
        at, key = at[same], key[same]
        regions: dict[int, list[tuple[int, int]]] = {}
        known: dict[tuple, tuple[int, int] | None] = {}
        for low in range(0, len(g), SEGMENT):
            a, b = np.searchsorted(at, (low, low + SEGMENT + OVERLAP))
            if b - a >= self.bound.min():
                self._segment(data, at[a:b], key[a:b], regions, known)
        found = []
        for number, own in sorted(regions.items()):
            begin, end = min(own)
            for a, b in sorted(own):
                if a > end:
                    found.append((number, begin, end))
                    begin, end = a, b
                end = max(end, b)
            found.append((number, begin, end))
        return found

    def _segment(self, data: bytes, at: np.ndarray, key: np.ndarray, regions: dict, known: dict) -> None:
        """Add to ``regions`` of each item what the hits ``at`` of the grams ``key`` show. ``known``
        holds the outcome of alignments by what was aligned."""
        # all postings of every hit
        count = self.first[key + 1] - self.first[key]
        total = np.cumsum(count)
        posting = np.arange(total[-1]) + np.repeat(self.first[key] - (total - count), count)
        item, place, where = self.items[posting].astype(np.int64), self.places[posting].astype(np.int64), np.repeat(at, count)
        # sums by (block, item); a region lies in two neighbouring blocks
        start = int(at[0])
        n_items, blocks = len(self.bound), (int(at[-1]) - start) // self.block + 2
        cell = (where - start) // self.block * n_items + item
        if blocks * n_items <= max(1 << 22, 8 * len(cell)):
            sums = np.bincount(cell, minlength=(blocks + 1) * n_items).reshape(-1, n_items)
            pair = sums[:-1] + sums[1:]
            enough = pair >= self.bound
            live = enough.copy()
            live[1:] |= enough[:-1]
            alive = live.reshape(-1)[cell]
        else:
            name, code = np.unique(cell, return_inverse=True)
            sums = np.bincount(code)
            near = np.zeros((2, len(name)), dtype=np.int64)
            for s, shift in enumerate((n_items, -n_items)):
                j = np.searchsorted(name, name + shift)
                j[j == len(name)] = 0
                near[s] = np.where(name[j] == name + shift, sums[j], 0)
            alive = (sums + near.max(axis=0) >= self.bound[name % n_items])[code]
        if not alive.any():
            return
        item, place, where = item[alive], place[alive], where[alive]
        longest = len(max(self.texts, key=len))
        diagonal = where - place + longest
        # overlapping bands: each hit counts in the band it begins and in the one before
        band = diagonal // self.band
        wide = int(band.max()) + 2
        of_band = np.concatenate((item * wide + band, item * wide + band - 1))
        # q-grams of the item that are left, each place once, within a window of the edit budget
        mark = np.unique(of_band * longest + np.concatenate((place, place)))
        name, spot = mark // longest, mark % longest
        bound = self.bound[name // wide]
        last = np.arange(len(mark)) + bound - 1
        inside = last < len(mark)
        last[~inside] = 0
        inside &= (name[last] == name) & (spot[last] - spot <= self.window[name // wide] - Q)
        for n in np.unique(name[inside]).tolist():
            number, low = n // wide, n % wide * self.band - longest
            spots = spot[np.searchsorted(name, n) : np.searchsorted(name, n, side="right")]
            own = regions.setdefault(number, [])
            first, last = low + int(spots[0]), low + int(spots[-1]) + Q  # of the text, along the band's first diagonal
            if any(a - self.band <= first and last <= b + self.band for a, b in own[-4:]):
                continue
            region = self._verify(data, number, low, 2 * self.band, spots, known)
            if region is not None:
                own.append(region)
            elif not own:
                del regions[number]

    def _verify(self, data: bytes, number: int, low: int, width: int, spots: np.ndarray, known: dict) -> tuple[int, int] | None:
        """The region of the windows that align within the budget along the diagonals low to
        low + width; ``spots`` are the item's places of shared q-grams there."""
        text, k, w = self.texts[number], int(self.budget[number]), int(self.window[number])
        exact = data.find(text, max(0, low), max(0, low + width + len(text)))
        if exact >= 0:
            return exact, exact + len(text)
        starts = self.starts[number] if self.starts[number] is not None else np.arange(int(spots[0]) - w + Q, int(spots[-1]) + 1)
        starts = starts[(starts >= 0) & (starts <= len(text) - w)]
        shared = np.searchsorted(spots, starts + w - Q, side="right") - np.searchsorted(spots, starts)
        starts = starts[shared >= int(self.bound[number])]
        if not len(starts):
            return None
        # what is aligned: these windows and this piece of the text
        begin = int(starts[0]) + low - k
        piece = data[max(0, begin) : max(0, int(starts[-1]) + w + low + width + k)]
        seen = (number, starts.tobytes(), begin if begin < 0 else 0, piece)
        if seen not in known:
            found = self._align(data, text, starts, low - k, width + 2 * k + 1, w, k)
            known[seen] = None if found is None else (found[0] - begin, found[1] - begin)
        place = known[seen]
        return None if place is None else (max(0, place[0] + begin), min(len(data), place[1] + begin))

    @staticmethod
    def _align(data: bytes, text: bytes, starts: np.ndarray, low: int, diagonals: int, w: int, k: int) -> tuple[int, int] | None:
        """Banded edit distance of all windows of an item at once."""
        own = np.frombuffer(text, dtype=np.uint8)
        span = np.arange(diagonals)
        regions = []
        for at in range(0, len(starts), _GROUP):
            alive = starts[at : at + _GROUP]
            origin = int(alive[0]) + low  # place in the text of the first window's first diagonal
            padded = np.full(int(alive[-1]) - int(alive[0]) + w + len(span), -1, dtype=np.int16)
            piece = np.frombuffer(data[max(0, origin) : max(0, origin + len(padded))], dtype=np.uint8)
            padded[max(0, -origin) : max(0, -origin) + len(piece)] = piece
            around = np.lib.stride_tricks.sliding_window_view(padded, len(span))
            shift = alive - alive[0]
            edits = np.zeros((len(alive), len(span)), dtype=np.int32)
            for r in range(w):
                step = edits + (around[shift + r] != own[alive + r][:, None])
                # an item character without a partner comes from the next diagonal
                np.minimum(step[:, :-1], edits[:, 1:] + 1, out=step[:, :-1])
                # runs of text characters without a partner come from the diagonals before
                edits = np.minimum.accumulate(step - span, axis=1) + span
                if r % 8 == 7 or r == w - 1:
                    good = edits.min(axis=1) <= k
                    if not good.all():
                        edits, alive, shift = edits[good], alive[good], shift[good]
                        if not len(alive):
                            break
            if len(alive):
                end = alive + w + low + edits.argmin(axis=1)
                regions.append((int((end - w).min()), int(end.max())))
        return (min(a for a, _ in regions), max(b for _, b in regions)) if regions else None


def index_parts(benchmark: DataFrame, part_chars: int = PART_CHARS) -> Iterator[Index]:
    """Indexes of the items, part by part; the driver holds one part at a time."""
    rows: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((row[0], row[1]))
        held += len(row[1] or "")
        if held >= part_chars:
            found = Index.build(rows)
            if found is not None:
                yield found
            rows, held = [], 0
    found = Index.build(rows)
    if found is not None:
        yield found


def leak_udf(shared):
    """Pandas UDF text -> array of leaks (item_id, begin, end) of a broadcast index; places are
    bytes of the normalised text. The index is bounded by PART_CHARS."""

    @F.pandas_udf("array<struct<item_id:long,begin:long,end:long>>")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([[{"item_id": own.ids[n], "begin": a, "end": b} for n, a, b in own.find(normalise(t))] for t in texts])

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "_leaks", part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with all their columns and ``column``: the leaks of each row, none if clean."""
    spark, column = docs.sparkSession, fresh(docs, column)
    none = F.array().cast("array<struct<item_id:long,begin:long,end:long>>")
    parts = index_parts(benchmark, part_chars)
    index, following = next(parts, None), next(parts, None)
    if index is None:
        return docs.withColumn(column, none)
    if following is None:
        return docs.withColumn(column, leak_udf(spark.sparkContext.broadcast(index))(F.col("text")))
    row = fresh(docs, "_row")
    rows, _ = store_dealt(docs.withColumn(row, F.monotonically_increasing_id()), "leak-rows", row)
    leaks = None
    number = 0
    while index is not None:  # one index at a time
        shared = spark.sparkContext.broadcast(index)
        found, _ = store(rows.select(F.col(row), leak_udf(shared)(F.col("text")).alias("found")).where(F.size("found") > 0).withColumn("part", F.lit(number)), "leaks")
        shared.destroy()
        leaks = found if leaks is None else leaks.union(found)
        index, following, number = following, next(parts, None), number + 1
    whole = leaks.groupBy(row).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "found"))), lambda x: x["found"])).alias(column))
    return rows.join(whole, row, "left").select(*docs.columns, F.coalesce(column, none).alias(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("_leaks.item_id"))
    return found.select("doc_id", (F.size("_leaks") > 0).alias("contaminated"), F.size("_leaks").cast("long").alias("n_regions"), items.alias("item_ids"))
