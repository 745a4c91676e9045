"""Token-ID / binary output: Re-Pair grammar compression of the id stream.

The whole texts are encoded with a public tokenizer, an end id closes each document, and the
ids go in ascending document order into shards of bounded size. Each shard is compressed with
Re-Pair in rounds: a round counts all adjacent id pairs, gives the most frequent ones a
nonterminal each and replaces their non-overlapping occurrences from left to right; each round
takes twice as many pairs as the one before, and rounds go on until no pair occurs ``LEAST``
times. A shard stores its rules, the expansion length of every rule and a sampled table of
expanded positions, so that any range of ids can be decoded without the rest.

Defined results: a null text is an empty one (only the end id); rows with null or equal
doc_id all stay, ordered by doc_id (nulls first), then by text; an empty table gives an empty
stream; columns other than doc_id and text are not read.

File format (``shards``): Parquet rows ``part, seq, n_docs, n_tokens, doc_ids, blob`` in id
order; ``blob`` is little-endian: magic ``RPG2``, eight u64 (documents, rules, symbols, ids, base
vocabulary, bits of a symbol, bytes of a rule length, skip step), rules[rules][2], rule lengths
[rules], document lengths u32[documents], skip table u64 (ids before every skip-th symbol),
symbols. Rules and symbols are packed: the low 16 bits of each as u16, then for every higher bit a
plane of one bit each.
"""

from __future__ import annotations

import contextlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.llm.common import store, table, text_column

MAGIC = b"RPG2"
#: Ids in a shard at most, unless one document alone has more.
SHARD_IDS = 1 << 20
#: Pairs that the first round replaces (each later one twice as many as the one before), and the
#: occurrences below which a rule would take more bits than it saves.
FIRST_RULES, LEAST = 1500, 4
SKIP = 1024
#: Encoded words that a worker keeps at most.
CACHE_ENTRIES = 500_000


# ---------------------------------------------------------------- Re-Pair


_BUCKET_BITS = 18


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of symbols as numbers, of 32 bits where they fit."""
    if not len(first) or max(int(first.max()), int(second.max())) < 1 << 16:
        return (first.astype(np.uint32) << np.uint32(16)) | second.astype(np.uint32)
    return (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)


def _bucket(pair: np.ndarray) -> np.ndarray:
    if pair.dtype == np.uint32:
        return (pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BUCKET_BITS)
    return (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKET_BITS)


def _frequent_pairs(seq: np.ndarray, rules: int, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, code): occurrences of the ``rules`` most frequent pairs, and of those as frequent
    as the last of them; one pair for each code, in descending order of occurrences. Pairs below
    ``LEAST`` occurrences are left out, and so are places that ``active`` doesn't have.

    All pairs are counted exactly, by sorting. The hashed buckets only find the places."""
    pair = _pairs(seq[:-1], seq[1:]) if active is None else _pairs(seq[active], seq[active + 1])
    ordered = np.sort(pair)
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(begin, append=len(ordered))
    often = np.flatnonzero(counts >= LEAST)
    if len(often) > rules:
        often = often[counts[often] >= np.partition(counts[often], -rules)[-rules]]
    if not len(often):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    chosen = ordered[begin[often]]  # ascending
    rank = np.empty(len(often), dtype=np.int32)
    rank[np.argsort(-counts[often], kind="stable")] = np.arange(len(often), dtype=np.int32)
    # a bucket names one of its pairs; places of the others are searched for
    name = np.full(1 << _BUCKET_BITS, -1, dtype=np.int32)
    name[_bucket(chosen)] = np.arange(len(chosen), dtype=np.int32)
    code = name[_bucket(pair)]
    at = np.flatnonzero(code >= 0)
    pair, code = pair[at], code[at]
    odd = np.flatnonzero(chosen[code] != pair)
    if len(odd):
        found = np.minimum(np.searchsorted(chosen, pair[odd]), len(chosen) - 1).astype(np.int32)
        found[chosen[found] != pair[odd]] = -1
        code[odd] = found
        same = code >= 0
        at, code = at[same], code[same]
    return at if active is None else active[at], rank[code]


def _apart(at: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which of the places, ascending, are taken so that none overlaps another: of a run of one
    pair every second; of two pairs that overlap the more frequent one."""
    fresh = np.ones(len(at), dtype=bool)
    np.logical_or(at[1:] != at[:-1] + 1, code[1:] != code[:-1], out=fresh[1:])
    order = np.arange(len(at), dtype=np.int32)
    left = np.flatnonzero(((order - np.maximum.accumulate(np.where(fresh, order, 0))) & 1) == 0)
    taken = np.zeros(len(at), dtype=bool)
    while len(left):
        place, own = at[left], code[left]
        touch = place[1:] == place[:-1] + 1
        best = np.ones(len(left), dtype=bool)
        best[1:] &= ~touch | (own[1:] < own[:-1])
        best[:-1] &= ~touch | (own[:-1] <= own[1:])
        taken[left[best]] = True
        free = ~best  # but not next to one that was taken
        free[1:] &= ~(touch & best[:-1])
        free[:-1] &= ~(touch & best[1:])
        left = left[free]
    return taken


def repair_compress(ids: np.ndarray, base: int, first_rules: int = FIRST_RULES) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): symbol ``base + k`` stands for the pair ``rules[k]``.

    Rounds go on until no pair has ``LEAST`` occurrences that don't overlap others replaced. Once
    a round was offered all frequent pairs, a pair that is frequent in the next one has a new
    symbol or was frequent before, so only such places are looked at."""
    seq = ids.astype(np.int32)
    rules: list[np.ndarray] = []
    top, a_round = base, first_rules
    active: np.ndarray | None = None
    while len(seq) > 1:
        places, code = _frequent_pairs(seq, a_round, active)
        if not len(places):
            break
        everything = int(code.max()) + 1 < a_round
        keep = _apart(places, code)
        at, code = places[keep], code[keep]
        good = np.bincount(code) >= LEAST
        a_round *= 2
        if not good.any():
            if everything:
                break
            continue
        keep = good[code]
        at, code = at[keep], code[keep]
        number = (np.cumsum(good) - 1).astype(np.int32)
        fit = np.zeros((int(number[-1]) + 1, 2), dtype=np.uint32)
        fit[number[code], 0], fit[number[code], 1] = seq[at], seq[at + 1]
        seq[at] = top + number[code]
        rest = np.ones(len(seq), dtype=bool)
        rest[at + 1] = False
        if everything:
            new = at - np.arange(len(at))
            left = places[rest[places]]
            active = np.unique(np.concatenate((new, new - 1, left - np.searchsorted(at, left))))
        seq = seq[rest]
        if active is not None:
            active = active[(active >= 0) & (active < len(seq) - 1)]
        rules.append(fit)
        top += len(fit)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def _pack(values: np.ndarray, bits: int) -> bytes:
    """Numbers below 2**bits: their low 16 bits, then a plane of packed bits for each higher bit."""
    planes = [np.packbits((values >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(16, bits)]
    return b"".join(((values & 0xFFFF).astype("<u2").tobytes(), *planes))


def _packed_size(count: int, bits: int) -> int:
    return 2 * count + max(0, bits - 16) * (-(-count // 8))


def _unpack(blob: bytes, offset: int, count: int, bits: int) -> np.ndarray:
    out = np.frombuffer(blob, dtype="<u2", count=count, offset=offset).astype(np.uint32)
    offset += 2 * count
    for k in range(16, bits):
        plane = np.frombuffer(blob, dtype=np.uint8, count=-(-count // 8), offset=offset)
        out |= np.unpackbits(plane, count=count, bitorder="little").astype(np.uint32) << np.uint32(k)
        offset += len(plane)
    return out


def _rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of every rule; a rule only uses terminals and earlier rules."""
    lengths = np.zeros(len(rules), dtype=np.int64)
    open_ = np.ones(len(rules), dtype=bool)
    while open_.any():
        parts = [np.where(rules[:, s] < base, 1, lengths[np.clip(rules[:, s].astype(np.int64) - base, 0, None)]) for s in (0, 1)]
        ready = open_ & (parts[0] > 0) & (parts[1] > 0)
        lengths[ready] = parts[0][ready] + parts[1][ready]
        open_ &= ~ready
    return lengths


def _expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Replace rules by their right sides, all at once, until only ids are left."""
    seq = symbols.astype(np.int64)
    while len(seq):
        is_rule = seq >= base
        if not is_rule.any():
            break
        size = np.where(is_rule, 2, 1)
        out = np.repeat(seq, size)
        first = np.cumsum(size) - size
        at = first[is_rule]
        right = rules[seq[is_rule] - base]
        out[at], out[at + 1] = right[:, 0], right[:, 1]
        seq = out
    return seq.astype(np.uint32)


def pack_shard(ids: np.ndarray, doc_lengths: np.ndarray, base: int) -> bytes:
    seq, rules = repair_compress(ids, base)
    lengths = _rule_lengths(rules, base)
    bits = max(16, int(base + len(rules)).bit_length())
    weight = np.ones(len(seq), dtype=np.int64)
    of_rule = seq >= base
    weight[of_rule] = lengths[seq[of_rule] - base]
    before = np.cumsum(weight) - weight
    wide = 1 if len(rules) == 0 or int(lengths.max()) < 1 << 8 else 4
    head = struct.pack("<4s8Q", MAGIC, len(doc_lengths), len(rules), len(seq), len(ids), base, bits, wide, SKIP)
    return b"".join((head, _pack(rules.reshape(-1), bits), lengths.astype(f"<u{wide}").tobytes(), doc_lengths.astype("<u4").tobytes(), before[::SKIP].astype("<u8").tobytes(), _pack(seq, bits)))


class Shard:
    """A shard's blob, opened for reading."""

    def __init__(self, blob: bytes):
        magic, docs, rules, symbols, ids, base, bits, wide, skip = struct.unpack_from("<4s8Q", blob)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.n_tokens, self.base, self.skip = ids, base, skip
        at = struct.calcsize("<4s8Q")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.rules = _unpack(blob, at, 2 * rules, bits).reshape(-1, 2)
        at += _packed_size(2 * rules, bits)
        self.lengths = take(f"<u{wide}", rules)
        self.doc_lengths = take("<u4", docs)
        self.before = take("<u8", -(-symbols // skip))
        self.symbols = _unpack(blob, at, symbols, bits)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols: a table holds every symbol's expansion in one piece."""
        if not hasattr(self, "table"):
            own = _expand(np.arange(self.base, self.base + len(self.rules)), self.rules, self.base)
            self.table = np.concatenate((np.arange(self.base, dtype=np.uint32), own))
            self.size = np.concatenate((np.ones(self.base, dtype=np.int64), self.lengths.astype(np.int64)))
            self.begin = np.cumsum(self.size) - self.size
        size = self.size[symbols]
        total = np.cumsum(size)
        if not len(total):
            return np.zeros(0, dtype=np.uint32)
        at = np.repeat(self.begin[symbols] - (total - size), size)
        at += np.arange(int(total[-1]))
        return self.table[at]

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only the symbols around them are expanded."""
        start, stop = max(0, start), min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        first = int(np.searchsorted(self.before, start, side="right")) - 1
        last = int(np.searchsorted(self.before, stop, side="left"))
        ids = self._expand(self.symbols[first * self.skip : last * self.skip])
        shift = int(self.before[first])
        return ids[start - shift : stop - shift]


# ---------------------------------------------------------------- encoding

_ENCODERS: dict[str, "WordEncoder"] = {}
#: Characters that a word may end with as a pre-token of its own.
_TAIL = b".,;:!?#$%&*"
#: ASCII characters that are white space for Python.
_SPACES = frozenset((9, 10, 11, 12, 13, 28, 29, 30, 31, 32))
#: Words looked up at once.
_PIECE = 200_000
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in one piece with 16 bytes to spare, where each begins, and their lengths."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer(b"".join(words) + bytes(16), dtype=np.uint8), np.cumsum(length) - length, length


class WordTable:
    """Ids of words, for many words at once. Words of up to 16 bytes stand in a hash table that
    compares all their bytes, longer ones in a dictionary."""

    SLOTS = 1 << (2 * CACHE_ENTRIES - 1).bit_length()

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.head = np.zeros(self.SLOTS, dtype=np.uint64)  # first and last 8 bytes of a word
        self.tail = np.zeros(self.SLOTS, dtype=np.uint64)
        self.size = np.zeros(self.SLOTS, dtype=np.uint8)
        self.entry = np.full(self.SLOTS, -1, dtype=np.int32)
        self.long: dict[bytes, int] = {}
        self.first = np.zeros(1 << 16, dtype=np.int64)  # ids[first[e]:first[e + 1]] are entry e's
        self.ids = np.zeros(1 << 18, dtype=self.kind)
        self.entries = 0

    def _keys(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        at_any = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), shape=(len(raw) - 7,), strides=(1,))
        head = at_any[begin] & _MASK[np.minimum(length, 8)]
        tail = np.where((length > 8) & (length <= 16), at_any[begin + np.clip(length - 8, 0, 8)], np.uint64(0))
        with np.errstate(over="ignore"):
            x = (head ^ tail * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return head, tail, (x >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)

    def find(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entry of each word raw[begin:begin + length], -1 if unknown; raw has 16 bytes to spare."""
        out = np.full(len(begin), -1, dtype=np.int32)
        head, tail, slot = self._keys(raw, begin, length)
        todo = np.flatnonzero(length <= 16)
        slot = slot[todo]
        while len(todo):
            entry = self.entry[slot]
            same = (self.head[slot] == head[todo]) & (self.tail[slot] == tail[todo]) & (self.size[slot] == length[todo]) & (entry >= 0)
            out[todo[same]] = entry[same]
            on = (entry >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & (self.SLOTS - 1)
        for k in np.flatnonzero(length > 16).tolist():
            out[k] = self.long.get(raw[begin[k] : begin[k] + length[k]].tobytes(), -1)
        return out

    def add(self, words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        """Enter different words that the table doesn't have; ``flat`` has the ids of all."""
        if not words:
            return
        own = np.arange(self.entries, self.entries + len(words), dtype=np.int32)
        ends = np.cumsum(counts)
        used = int(self.first[self.entries])
        while self.entries + len(words) >= len(self.first):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[used : used + len(flat)] = flat
        self.first[self.entries + 1 : self.entries + len(words) + 1] = used + ends
        self.entries += len(words)
        raw, begin, length = joined(words)
        head, tail, slot = self._keys(raw, begin, length)
        todo = np.flatnonzero(length <= 16)
        slot = slot[todo]
        while len(todo):
            _, first = np.unique(slot, return_index=True)
            first = first[self.entry[slot[first]] < 0]
            at, k = slot[first], todo[first]
            self.head[at], self.tail[at], self.size[at], self.entry[at] = head[k], tail[k], length[k], own[k]
            on = np.ones(len(todo), dtype=bool)
            on[first] = False
            todo, slot = todo[on], (slot[on] + 1) & (self.SLOTS - 1)
        for k in np.flatnonzero(length > 16).tolist():
            self.long[words[k]] = int(own[k])

    def get(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some entries in one piece, and how many each has."""
        first = self.first[entry]
        size = self.first[entry + 1] - first
        total = np.cumsum(size)
        at = np.repeat(first - (total - size), size)
        at += np.arange(len(at))
        return self.ids[at], size


class WordEncoder:
    """Encodes whole texts with the tokenizers library, word by word where that gives the same.

    In a byte-level BPE with the usual pattern, a space between two characters that are no white
    space begins a pre-token, and a line end between two such characters is one. So a text is cut
    before these; words that a space or a line end leads are encoded once, many to a call, and
    kept in a table of bounded size, which starts anew when it is full. Texts with other white
    space at a cut, or that hold special tokens, and all texts under other tokenizers, are encoded
    as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.base <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        cut = rules.get("pre_tokenizer") or {}
        self.by_word = not rules.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and len(self._plain(["\n"])[0]) == 1
        self.widths = np.zeros(self.base, dtype=np.int64)  # bytes of each token
        if self.by_word:
            for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.widths[k] = len(token)  # byte-level: a character for each byte
        self.table = WordTable(self.kind)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words as they stand in a text, many to a text, and how many each has; the
        bytes of the tokens tell where a word ends."""
        if not words:
            return np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64)
        ids = np.concatenate(self._plain([b"".join(words[k : k + 500]).decode() for k in range(0, len(words), 500)]))
        upto = np.cumsum(self.widths[ids])
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        cut = np.searchsorted(upto, ends) + 1
        if not (upto[cut - 1] == ends).all():
            raise AssertionError("a token goes across words")
        return ids, np.diff(cut, prepend=0)

    def _learn(self, words: set[bytes]) -> None:
        """Enter words, each with the space or line end that leads it. Punctuation that ends a
        word is a pre-token of its own, so the word before it is learned without it. A word that
        is empty or has white space at an end shows a cut that isn't between two other
        characters: it is never entered."""
        plain: list[bytes] = []
        tailed: list[bytes] = []
        bares: list[bytes] = []
        for w in words:
            if len(w) == 1 or w[1] in _SPACES or w[-1] in _SPACES:
                continue
            if w[1] > 127 or w[-1] > 127:
                t = w.decode()
                if t[1].isspace() or t[-1].isspace():
                    continue
            bare = w.rstrip(_TAIL)
            if 1 < len(bare) < len(w) and bare.decode()[-1].isalnum():
                tailed.append(w)
                bares.append(bare)
            else:
                plain.append(w)
        more = list(set(bares).difference(plain))
        if more:
            unknown = self.table.find(*joined(more)) < 0
            plain += [more[k] for k in np.flatnonzero(unknown).tolist()]
        self.table.add(plain, *self._encode_words(plain))
        if not tailed:
            return
        body, n_body = self.table.get(self.table.find(*joined(bares)))
        kinds = {t: k for k, t in enumerate(sorted({w[len(bare) :] for w, bare in zip(tailed, bares)}))}
        tails = self._plain([t.decode() for t in kinds])
        which = np.fromiter((kinds[w[len(bare) :]] for w, bare in zip(tailed, bares)), dtype=np.int64, count=len(tailed))
        n_tails = np.array([len(t) for t in tails])
        n_tail = n_tails[which]
        both = n_body + n_tail
        start = np.cumsum(both) - both
        flat = np.empty(int(both.sum()), dtype=self.kind)
        flat[np.repeat(start - (np.cumsum(n_body) - n_body), n_body) + np.arange(len(body))] = body
        tail_start = np.cumsum(n_tails) - n_tails
        shift = np.cumsum(n_tail) - n_tail
        each = np.arange(int(n_tail.sum()))
        flat[np.repeat(start + n_body - shift, n_tail) + each] = np.concatenate(tails)[np.repeat(tail_start[which] - shift, n_tail) + each]
        self.table.add(tailed, flat, both)

    def _entries(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        entry = self.table.find(raw, begin, length)
        holes = np.flatnonzero(entry < 0)
        if len(holes):
            missing = lambda at: {raw[a : a + n].tobytes() for a, n in zip(begin[at].tolist(), length[at].tolist())}
            words = missing(holes)
            if self.table.entries + 2 * len(words) > CACHE_ENTRIES:
                self.table.clear()
                holes = np.arange(len(begin))
                words = missing(holes)
            self._learn(words)
            entry[holes] = self.table.find(raw, begin[holes], length[holes])
        return entry

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        by_word = [self.by_word and not any(s in t for s in self.specials) for t in texts]
        # a line end is set before each text, so that its first word is like any other
        data = [b"\n" + t.encode() if ok else b"\n" for t, ok in zip(texts, by_word)]
        raw = np.frombuffer(b"".join((*data, bytes(16))), dtype=np.uint8)
        size = np.array([len(d) for d in data])
        starts = np.cumsum(size) - size
        begin = np.flatnonzero((raw[:-16] == 32) | (raw[:-16] == 10))
        length = np.diff(begin, append=len(raw) - 16)
        first = np.searchsorted(begin, starts)  # first word of each text
        ids, counts, odd = [], [], np.zeros(len(begin), dtype=bool)
        for k in range(0, len(begin), _PIECE):
            entry = self._entries(raw, begin[k : k + _PIECE], length[k : k + _PIECE])
            odd[k : k + _PIECE] = entry < 0
            own, n = self.table.get(np.maximum(entry, 0))
            ids.append(own)
            counts.append(n)
        flat, ends = np.concatenate(ids), np.cumsum(np.concatenate(counts))
        whole = np.logical_or.reduceat(odd, first)
        stop = ends[np.append(first[1:], len(begin)) - 1]
        start = np.concatenate(([0], stop[:-1]))
        again = iter(self._plain([t for t, w in zip(texts, whole.tolist()) if w]))
        # the line end before each text is one id
        return [next(again) if w else flat[a + 1 : b] for w, a, b in zip(whole.tolist(), start.tolist(), stop.tolist())]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


#: Bytes of texts that go to a worker at once.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While a table is written, Arrow batches of at most BATCH_BYTES: a batch of the usual number of
    rows holds tens of MB of texts, in the JVM and in the worker. The setting is restored after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, doc_ids array<long>, blob binary"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the id stream; returns the written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) + 1 for x in ids])
            end = np.array([end_id], dtype=own.kind)
            stream = np.concatenate([y for x in ids for y in (x, end)])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seq, len(ids), len(stream), doc_ids, pack_shard(stream, lengths, own.base)), kind.types)], schema=kind)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(keys), 256):
                for key, row in zip(keys[k : k + 256], own.encode(texts.slice(k, 256).to_pylist())):
                    if ids and held + len(row) + 1 > shard_ids:
                        yield flush()
                        doc_ids, ids, held, seq = [], [], 0, seq + 1
                    doc_ids.append(key)
                    ids.append(row)
                    held += len(row) + 1
        if ids:
            yield flush()

    with small_batches(docs.sparkSession):
        return store(rows.mapInArrow(encode, SHARD_SCHEMA), "token-shards")[0]


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document of the written shards: place in the stream, number of ids and their crc32."""
    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one shard at a time
                row = {name: batch.column(name)[k].as_py() for name in ("part", "seq", "doc_ids", "blob")}
                shard = Shard(row["blob"])
                ids = shard.all().astype("<u4")
                lengths = shard.doc_lengths.astype(np.int64)
                begin = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), lengths.tolist())]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["part"]), pa.int32()), pa.array(np.full(n, row["seq"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begin), pa.array(lengths), pa.array(crc, pa.int64())], schema=kind)

    return shards.select("part", "seq", "doc_ids", "blob").mapInArrow(decode, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before every shard. Prefix sums run within each part; only the parts' totals, one
    row for each partition that wrote the stream, meet in one task."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("seq")
    return shards.select("part", "seq", (F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("inner_start")).join(before, "part").select("part", "seq", (F.col("part_start") + F.col("inner_start")).alias("shard_start"))


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the stream of ``docs``, read it back and return
    (doc_id, start, n_tokens, ids_crc32, shard_part, shard_seq) for each row."""
    shards = write_shards(docs, tokenizer_path, end_id)
    starts = shard_starts(shards.select("part", "seq", "n_tokens"))
    return read_documents(shards).join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", F.col("part").alias("shard_part"), F.col("seq").alias("shard_seq"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_stream(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
