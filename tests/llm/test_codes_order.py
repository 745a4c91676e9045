"""Codebooks by bounded Lloyd rounds and Order MinHash fingerprints against brute force."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
import xxhash

from skyweave.llm import op11_codes as codes
from skyweave.llm import op12_order as order

VECTORS = "vec_id long, embedding array<double>, label string, code string, part int"


def brute_codes(rows):
    """Full Lloyd rounds over Python integers; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    width = max(1, -(-max(len(r[1]) for r in kept) // 8))
    whole = [[math.floor(x * 4096) if abs(x) < 1e15 else int(x) * 4096 for x in r[1]] + [0] * (8 * width - len(r[1])) for r in kept]
    split = [[v[p * width : (p + 1) * width] for p in range(8)] for v in whole]
    books = [[list(s[p]) for s in split[:16]] for p in range(8)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda s: [min(range(len(books[p])), key=lambda c: (square(s[p], books[p][c]), c)) for p in range(8)]
    for _ in range(6):
        found = [nearest(s) for s in split]
        for p in range(8):
            for c in range(len(books[p])):
                mine = [s[p] for s, f in zip(split, found, strict=True) if f[p] == c]
                if mine:
                    books[p][c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, totals = [], {}
    for r, s in zip(kept, split, strict=True):
        f = nearest(s)
        e = min(sum(square(s[p], books[p][f[p]]) for p in range(8)), 2**63 - 1)
        totals[r[2]] = totals.get(r[2], 0) + e
        out.append((r[0], "".join(f"{c:02x}" for c in f), e, r[2]))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, e, min(totals[g], 2**63 - 1)) for i, c, e, g in out), key=str), digest


def coded(spark, rows, slices=5):
    table = spark.createDataFrame([(i, v, g, "clash", 1) for i, v, g in rows], VECTORS).repartition(slices)
    found, books, work = codes.compress(table)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.with_label_errors(found).collect()), key=str)
    return got, books.digest() if books else None, work


def vectors(rng, n, d=24):
    centres = rng.normal(size=(6, d))
    return [(k, (centres[k % 6] * 0.5 + rng.normal(size=d) * 0.05).tolist(), ["a", "b", None][k % 3]) for k in range(n)]


ODD = [(900, None, "a"), (901, [1.0, None], "a"), (902, [float("nan")] * 24, "b"), (903, [float("inf")] * 24, None), (904, [], "a"), (905, [0.25] * 5, "b"), (None, [0.1] * 24, "c")]


def test_codes_match_full_rounds(spark):
    rows = vectors(np.random.default_rng(3), 300)
    rows += [rows[0], rows[1]] + [(600 + k, [0.5] * 24, "tie") for k in range(20)] + ODD
    got, digest, work = coded(spark, rows)
    assert (got, digest) == brute_codes(rows)
    assert work[0][0] < work[0][1] and work[-1][0] < 0.5 * work[-1][1]  # the bounds prune
    assert coded(spark, rows, slices=2)[:2] == (got, digest)


@pytest.mark.parametrize("large", [1e5, 3e8, -1e30, 1e300])
def test_codes_of_large_components(spark, large):
    rows = vectors(np.random.default_rng(4), 40, 10) + [(100 + k, [large * (1 + k % 3)] + [0.5] * 9, "big") for k in range(5)] + [(-1, [large] * 10, None)]
    got, digest, _ = coded(spark, rows)
    assert (got, digest) == brute_codes(rows)


def test_codes_of_few_or_no_vectors(spark):
    for rows in ([], ODD[:4], ODD[4:5], vectors(np.random.default_rng(5), 3, 8), [(1, [0.0] * 8, "x")] * 4):
        got, digest, _ = coded(spark, rows)
        want, books = brute_codes(rows)
        assert (got, digest) == (want, books)


def test_pruned_assignment_breaks_ties_by_index():
    rng = np.random.default_rng(6)
    for _ in range(40):
        x = rng.integers(-4, 5, (60, 2))
        first = codes.Codebooks([rng.integers(-4, 5, (5, 2)).tolist()])
        code, upper, lower = np.zeros(60, dtype=np.int64), np.full(60, np.inf), np.zeros((60, 5))
        books = first
        for k in range(4):
            codes.assign_part(x, books, 0, code, upper, lower)
            far = ((x[:, None, :] - books.arrays[0][None]) ** 2).sum(axis=2)
            assert code.tolist() == far.argmin(axis=1).tolist()
            true = np.sqrt(far)
            assert (upper >= true[np.arange(60), code]).all() and (lower <= true).all()
            stored = codes._unpack_lower(codes._pack_lower(lower))
            assert (stored <= lower).all() and (codes._pack_upper(upper) >= upper).all()
            upper, lower = codes._pack_upper(upper).astype(float), stored
            books = codes.Codebooks([[[v + int(rng.integers(-1, 2)) for v in e] for e in books.entries[0]]], books)


def test_codes_match_their_sql(spark, tmp_path):
    rows = [(i, None if v is None else v, g, "clash", 1) for i, v, g in vectors(np.random.default_rng(7), 80, 16) + ODD[:4]]
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(codes.oracle()).fetchall()
    got = codes.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == sorted(want)


def long_hash(*values, seed=42):
    """Spark's xxhash64 of texts and signed longs, nulls passed over, as an unsigned number."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_signatures(text):
    """Order MinHash by definition: the minimal (k-mer, occurrence) pair of every cell."""
    pieces = re.findall(r"[^\x20\x09-\x0D]{1,4}", text or "")
    hashes = [signed(long_hash(p)) for p in pieces]
    mers = [hashes[i : i + 3] for i in range(max(len(hashes) - 2, 1))] if hashes else []
    seen, cells = {}, {}
    for place, mer in enumerate(mers):
        cut = long_hash(*mer) & ((1 << 33) - 1)
        cut = cut - (1 << 33) if cut >> 32 else cut
        occurrence = seen[cut] = seen.get(cut, -1) + 1
        # the occurrence is an int, hashed as four bytes
        pair = xxhash.xxh64_intdigest(occurrence.to_bytes(4, "little"), long_hash(cut)) & ((1 << 33) - 1)
        pair = pair - (1 << 33) if pair >> 32 else pair
        cell = (pair & ((1 << 33) - 1)) >> 26
        cells[cell] = min(cells.get(cell, (pair, place)), (pair, place))
    out = []
    for t in range(64):
        chosen = sorted((place, pair) for pair, place in (cells[c] for c in (2 * t, 2 * t + 1) if c in cells))
        if chosen:
            out.append(t << 16 | long_hash(*[pair for _, pair in chosen]) & 0xFFFF)
    return out


def likeness(a, b):
    slots = {x >> 16 for x in a} | {x >> 16 for x in b}
    return len(set(a) & set(b)) / len(slots) if slots else 1.0


def brute_fingerprints(rows):
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(f"{-1 if r[0] is None else len(str(r[0]))}:{'' if r[0] is None else r[0]}:{r[1]}".encode()).digest()))
    after = {d: distinct[(k + 1) % len(distinct)] for k, d in enumerate(distinct)}
    out = []
    for i, t in rows:
        text, following = t or "", after[i, t or ""][1]
        q = len(text) // 4
        changed = text[: len(text) - q] + following[:q]
        a, b, c = brute_signatures(text), brute_signatures(changed), brute_signatures(following)
        show = lambda s: "".join(f"{x:06x}" for x in s)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), show(a), show(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, key string, next_key string, signatures string"


def fingerprinted(spark, rows, folder, slices=6):
    spark.createDataFrame([(i, t, "k", "n", "s") for i, t in rows], DOCS).repartition(slices).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, order.query(spark, str(folder)).collect()), key=str)


def prose(rng, n):
    words = [f"{a}{b}" for a in ("lo", "mar", "tes", "quin") for b in ("do", "vis", "ter", "um", "a")]
    return " ".join(rng.choice(words, n))


def test_fingerprints_match_their_definition(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, prose(rng, int(n))) for k, n in enumerate(rng.integers(1, 400, 40))]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "ab ab ab ab ab " * 50), (55, "漢字かな交じり文" * 40), (56, "😀é" * 30), (57, prose(rng, 20_000)), (58, "x" * 5_000)]
    rows += [rows[3], rows[3], (3, "another text of this id"), (None, "no id"), (None, None), (60, rows[5][1])]
    assert fingerprinted(spark, rows, tmp_path) == brute_fingerprints(rows)


def test_fingerprints_of_one_and_no_document(spark, tmp_path):
    for k, rows in enumerate(([(1, "abcd efgh ijkl")], [(1, None)], [])):
        assert fingerprinted(spark, rows, tmp_path / str(k)) == brute_fingerprints(rows)


def test_fingerprints_follow_order_and_edits(spark):
    """Equal texts are alike, moved passages less than kept ones, unrelated texts hardly."""
    rng = np.random.default_rng(9)
    base = " ".join(f"{w}{k}" for k, w in enumerate(prose(rng, 600).split()))
    words = base.split()
    swapped = " ".join(x for block in reversed([words[k : k + 10] for k in range(0, 600, 10)]) for x in block)
    edited = " ".join([*words[:570], *prose(rng, 30).split()])
    table = spark.createDataFrame([(0, base, base), (1, base, edited), (2, base, swapped), (3, base, prose(rng, 600))], "k int, a string, b string")
    both = order.with_signatures(order.with_signatures(table, "a", "x"), "b", "y")
    alike = [r.n for r in both.select("k", order.likeness("x", "y").alias("n")).orderBy("k").collect()]
    assert alike[0] == 1.0 and alike[1] > 0.75 and alike[2] < alike[1] - 0.2 and alike[3] < 0.05


def test_fingerprints_need_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "k", "n", "s")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    plan = order.query(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
