"""Every corpus operator on small tables with nulls, empty and long texts, ties, repeated rows,
empty tables and columns of clashing names, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import op1_tokens, op2_quality, op3_decontam, op4_capjoin, op5_minhash, op6_pii, op7_toxicity, op8_mixing, op9_html, op10_substrings
from skyweave.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k:03d}" for k in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    base = sentence(rng, 300)
    near = base.split()
    near[7] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "One"), (9, sentence(rng, 20_000)),
        (10, "é ñ ß 漢字 😀 " + sentence(rng, 40)), (11, "a  b\n c d <|endoftext|> e "), (None, base), (12, sentence(rng, 50) + "\n" + base[100:700]),
    ] + [(20 + k, sentence(rng, 30 + k)) for k in range(20)]
    data = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data + [data[0]], DOC)  # one row repeats


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


# ------------------------------------------------------------------ 1


def test_token_stream(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op1_tokens.tokenizer_file())
    got = sorted(op1_tokens.token_stream(corpus, op1_tokens.tokenizer_file()).collect(), key=lambda r: r.start)
    rows = sorted(corpus.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert op1_tokens.token_stream(empty(spark), op1_tokens.tokenizer_file()).count() == 0


def test_shards_decode_at_random_places():
    rng = np.random.default_rng(1)
    for ids in (np.array([0], dtype=np.uint16), np.zeros(5000, dtype=np.uint16), rng.zipf(1.3, 60_000).clip(0, 50_000).astype(np.uint16), np.tile(rng.integers(0, 9, 50), 800).astype(np.uint16)):
        shard = op1_tokens.Shard(op1_tokens.pack_shard(ids, np.array([len(ids)]), 50_257))
        assert (shard.all() == ids).all()
        for a, b in rng.integers(0, len(ids) + 1, (30, 2)):
            assert (shard.read(int(a), int(b)) == ids[a:b]).all()


def test_many_small_shards(spark, corpus):
    shards = op1_tokens.write_shards(corpus, op1_tokens.tokenizer_file(), shard_ids=500)
    assert shards.count() > 5
    starts = op1_tokens.read_documents(shards).join(op1_tokens.shard_starts(shards.select("part", "seq", "n_tokens")), ["part", "seq"]).select((F.col("shard_start") + F.col("at")).alias("start"), "n_tokens").orderBy("start").collect()
    assert starts[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(starts, starts[1:]))


# ------------------------------------------------------------------ 2 and 7


def labelled(spark, bad):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for k in range(500):
        n = int(rng.integers(5, 200))
        words = list(rng.choice(WORDS, n))
        y = int(rng.random() < 0.3)
        text = bad(rng, words) if y else " ".join(words) + "."
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, 1 - y, y))
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (0, docs[0][1], "en", "s", 0)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame([*labels, (900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, held, folds):
    rows = scored.join(labels.where(F.col(label).isNotNull()), "doc_id").select("doc_id", "predicted", label).collect()
    out = [r.predicted == r[label] for r in rows if zlib.crc32(str(r.doc_id).encode()) % folds == held]
    return sum(out) / len(out)


def test_quality_rules(spark):
    docs, labels = labelled(spark, lambda rng, words: " ".join(w + "###" for w in words) if rng.random() < 0.5 else " ".join(words[:2] * len(words)))
    model = op2_quality.fit(docs, labels)
    assert model.rules and all(len(r) <= op2_quality.DEPTH for r in model.rules)
    scored = op2_quality.score_documents(docs.withColumn("_words", F.lit(1)), model).withColumn("predicted", (F.col("_quality") >= 0.5).cast("int"))
    assert accuracy(scored, labels, "quality", 1, 3) > 0.9
    assert scored.count() == docs.count() and scored.where("_quality is null or _quality < 0 or _quality > 1").count() == 0
    assert {c for c in docs.columns} < set(scored.columns)
    nothing = op2_quality.fit(docs, labels.where("false"))
    assert op2_quality.score_documents(docs, nothing).agg(F.min("_quality"), F.max("_quality")).first()[:] == (0.5, 0.5)
    assert op2_quality.score_documents(empty(spark), model).count() == 0


def test_toxic_segments(spark):
    docs, labels = labelled(spark, lambda rng, words: " ".join([*words[: len(words) // 2], *rng.choice(["vile", "grim", "foul"], 4), *words[len(words) // 2 :]]))
    model = op7_toxicity.fit(docs, labels)
    scored = op7_toxicity.score_documents(docs, model).select("doc_id", "_toxicity.*")
    assert accuracy(scored, labels, "toxic", 0, 5) > 0.95
    assert scored.count() == docs.count() and scored.where("score is null").count() == 0
    found = op7_toxicity.passages(docs, model).join(docs, "doc_id").select(F.expr("substring(text, begin + 1, end - begin)").alias("s")).distinct().collect()
    assert any({"vile", "grim", "foul"} & set(r.s.split()) for r in found)
    nothing = op7_toxicity.fit(docs, labels.where("false"))
    assert op7_toxicity.score_documents(docs, nothing).where("_toxicity.score > 0").count() == 0
    assert op7_toxicity.score_documents(empty(spark), model).count() == 0


def test_maximal_segments_match_definition():
    def brute(scores):  # the best segment, then the same left and right of it
        best = None
        for a in range(len(scores)):
            total = 0.0
            for b in range(a, len(scores)):
                total += scores[b]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                    best = (a, b, total)
        if best is None:
            return []
        a, b, s = best
        return brute(scores[:a]) + [(a, b, s)] + [(x + b + 1, y + b + 1, z) for x, y, z in brute(scores[b + 1 :])]

    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        hit = rng.random(n) < 0.4
        scores = np.where(hit, np.round(rng.random(n) * 3 + 0.1, 3), -0.7)
        at = np.flatnonzero(hit)
        got = sorted(op7_toxicity.maximal_segments(at.tolist(), scores[at].tolist(), -0.7))
        want = brute(scores.tolist())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


# ------------------------------------------------------------------ 3


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnop")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(2, 8))))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30)) for k in range(12)] + [(90, None), (91, ""), (92, "too short")]
    rows, want = [], {}
    for k in range(12):
        s = bytearray(items[k][1].encode())
        for _ in range(min(len(s), 100) // 10 * len(s) // 110):
            s[int(rng.integers(len(s)))] = ord("z")
        rows += [(10 * k, text(60) + " " + items[k][1].upper() + "! " + text(50)), (10 * k + 1, text(10) + ", " + s.decode() + "  " + text(9)), (10 * k + 2, text(200))]
        want |= {10 * k: k, 10 * k + 1: k}
    rows += [(900, None), (901, ""), (902, text(5000) + " " + items[3][1]), (903, "ab " * 4000)]
    want[902] = 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r._leaks] for r in op3_decontam.find_leaks(docs, bench).collect()}
    assert {d: v for d, v in got.items() if v} == {d: [k] for d, k in want.items()}
    parts = {r.doc_id: [x.item_id for x in r._leaks] for r in op3_decontam.find_leaks(docs, bench, part_chars=400).collect()}
    assert parts == got
    assert op3_decontam.find_leaks(docs, bench.where("false")).where("size(_leaks) > 0").count() == 0
    assert op3_decontam.find_leaks(docs.where("false"), bench).count() == 0


# ------------------------------------------------------------------ 4


@pytest.mark.parametrize("block", [2000, 7])
def test_cap_join(spark, monkeypatch, block):
    monkeypatch.setattr(op4_capjoin, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(240):
        v = rng.standard_normal(24)
        for m in range(int(rng.integers(1, 5))):
            u = v / np.linalg.norm(v) + rng.standard_normal(24) * 0.03 * m / 1.2
            rows.append((len(rows), [float(x) for x in u.astype(np.float32)], int(k % 3)))
    v = rng.standard_normal(24)
    rows += [(len(rows) + m, [float(x) for x in v + rng.standard_normal(24) * 0.01], 1) for m in range(40)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, None, 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan")] * 24, 0), (n + 4, rows[0][1], None), (n + 5, [1.0, None], 0), (n + 6, [2.0] * 5, 0), (n + 7, [1.0] * 5, 0), (n + 8, [], 0)]
    got = {r.vec_id: r for r in op4_capjoin.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit(1))).collect()}
    unit = {i: np.array(v, dtype=np.float32).astype(float) for i, v, lab in rows if v and None not in v and lab is not None and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {i: lab for i, _, lab in rows}
    links = {i: [j for j in unit if j != i and label[j] == label[i] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in unit}
    assert {i: r.n_links for i, r in got.items()} == {i: len(links.get(i, ())) for i in got}
    for i in got:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))


# ------------------------------------------------------------------ 5


def brute_near(rows, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.setdefault(i, []).append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]))
    linked = lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, corpus, width, monkeypatch):
    monkeypatch.setattr(op5_minhash, "BLOCK", 6)
    rng = np.random.default_rng(8)
    more = []
    seed = list(rng.choice(WORDS, 80))
    for k in range(40):  # a group whose members are more or less alike
        w = list(seed)
        for p in rng.integers(0, 80, int(rng.integers(0, 9))):
            w[p] = f"x{k}"
        more.append((2000 + k, " ".join(w), "en", "s", 0))
    docs = corpus.union(spark.createDataFrame([*more, (2000, "another text of this id", "en", "s", 0)], DOC)).withColumn("node", F.lit(0))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, sets = brute_near(rows, width)
    got = op5_minhash.link(docs, width)[0].collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert op5_minhash.link(empty(spark), width)[0].count() == 0


# ------------------------------------------------------------------ 6


def luhn(s):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data(spark):
    texts = [
        None, "", "a@b.c_d@e.f g@h", "mail é x.y+z@mail-1.example.com, and @bad.com a@b", "1.2.3.4.5.6 0001.2.3.255 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111111",
        "+1 (414) 555-7134 +12 +1 2 3 +1 (269) 555-3296 4524132264652876", "😀😀 +44 20 7946 0958 a@b.co", "7" * 30_000, "x" * 30_000 + "@y.com", "a@" * 3000, "9.9." * 3000, "call (865) 555-6198 now", "++1-800-555-0100 1.1.1.1@x.y.z", "\x01 a@b.cd \x02",
    ]
    rng = np.random.default_rng(9)
    alphabet = list("0123456789.@+-() ab\n,é")
    texts += ["".join(rng.choice(alphabet, int(rng.integers(1, 80)))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("found", F.lit(1))
    got = {r.doc_id: r for r in op6_pii.find(docs).collect()}
    for k, t in enumerate(texts):
        assert [(x.start, x.kind, x.end) for x in got[k].base] == base_spans(t or ""), t
        assert set(map(tuple, got[k].base)) <= set(map(tuple, got[k].spans))
    assert (5, 3, 19) in [tuple(x) for x in got[12].spans]
    assert op6_pii.find(docs.where("false")).count() == 0


# ------------------------------------------------------------------ 8


def test_mixing(spark, corpus, monkeypatch):
    monkeypatch.setattr(op8_mixing, "CELL_ROWS", 3)
    rng = np.random.default_rng(10)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), "en", ["b", "a", None, "é", "Z"][int(rng.choice(5, p=[0.6, 0.2, 0.1, 0.05, 0.05]))], 0) for k in range(1500)]
    docs = corpus.union(spark.createDataFrame(rows, DOC)).withColumn("size", F.lit("clash"))
    mixed = op8_mixing.mix(docs)
    got = mixed.select("source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    size, take, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in got:
        largest[r.source] = max(largest[r.source], r.mix_size)
        size[r.source] += r.mix_size
        take[r.source] += r.mix_copies * r.mix_size
        target[r.source] = r.mix_target
        assert 0 <= r.mix_copies <= 3
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    cap, free, total = {s: 3 * size[s] for s in order}, set(order), sum(size.values())
    while True:
        rest = total - sum(cap[s] for s in order if s not in free)
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap[s]}
        if not over:
            break
        free -= over
    for s in order:
        want = level * weight[s] if s in free else cap[s]
        # whole copies: half the largest document is what rounding can miss by
        assert abs(target[s] - want) < 1e-6 and abs(take[s] - want) <= max(0.02 * want, largest[s] / 2), s
    again = op8_mixing.mix(docs.repartition(7)).select("doc_id", "source", "mix_size", "mix_copies")
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.select("doc_id", "source", "mix_size", "mix_copies").collect()))
    copies = op8_mixing.repeat_copies(mixed)
    assert copies.columns == docs.columns and copies.count() == sum(r.mix_copies for r in got)
    assert op8_mixing.mix(empty(spark)).count() == 0


# ------------------------------------------------------------------ 9


def test_html():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>One&nbsp;&nbsp;two<br>three.</p><script>var x='<p>no</p>'</script><div class='ad'>Buy</div><p>Be.</p></article><div class=comments><p>I like it</p></div><footer>(c)</footer>"
    assert op9_html.extract(page) == "Title & more\nOne two three.\nBe."
    assert op9_html.extract(None) == op9_html.extract("") == op9_html.extract("<nav><a href=x>only</a></nav>") == ""
    assert op9_html.extract("<article><p>cut <b>of") == "cut of"
    long = "<article>" + "<p>word</p>" * 20_000
    assert op9_html.extract(long).count("\n") == 19_999
    x, y = op9_html.labelled_table()
    assert (op9_html.tree().predict(x) == y).mean() > 0.97


# ------------------------------------------------------------------ 10


@pytest.mark.parametrize("block", [4000, 2])
def test_repeated_bytes(spark, monkeypatch, block):
    monkeypatch.setattr(op10_substrings, "BLOCK", block)
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdefghij é"), n))
    shared, other = text(260), text(900)
    texts = [None, "", "short", "x" * 500, text(50) + shared + text(80), text(90) + shared[20:] + text(10), other, other, other[:450] + "!" + other[450:], shared[:199], "ab" * 300]
    texts += [text(int(rng.integers(0, 300))) + shared + text(int(rng.integers(0, 300))) for _ in range(12)] + [text(700) for _ in range(5)]
    ids = [*range(len(texts) - 2), None, 3]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("rid", F.lit(0))
    seen = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    want = []
    for i, b in zip(ids, data):
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in op10_substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert op10_substrings.remove_repeats(docs.where("false")).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(12)
    contexts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(200, 380, 20)]
    contexts[3] = contexts[2]
    array = op10_substrings.SuffixArray(contexts)
    suffix = lambda p: (contexts[array.owner[p]][p - array.first[array.owner[p]] :], array.owner[p])
    order = [suffix(p) for p in array.order]
    assert order == sorted(order)
    lcp = array.common_prefixes()
    place = {p: k for k, p in enumerate(array.order.tolist())}
    for p in array.starts()[::37]:
        a, b = suffix(p)[0], order[place[p] - 1][0] if place[p] else b""
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[p] == min(n, 200)


def test_repair_takes_the_most_frequent_pairs():
    rng = np.random.default_rng(17)
    seq = rng.integers(0, 50_000, 600_000).astype(np.int32)
    for k in range(300):  # pair (k, k + 1) stands k + 5 times in the first half, rare pairs after it
        seq[rng.choice(150_000, k + 5, replace=False)[:, None] * 2 + [0, 1]] = k, k + 1
    pairs = collections.Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    least = max(4, sorted(pairs.values())[-200])
    at, code = op1_tokens._frequent_pairs(seq, 200)
    got = collections.Counter(zip(seq[at].tolist(), seq[at + 1].tolist()))
    assert got == {p: n for p, n in pairs.items() if n >= least}
    assert len(set(zip(code.tolist(), seq[at].tolist(), seq[at + 1].tolist()))) == len(got) == len(set(code.tolist()))


def test_pii_card_candidates_inside_longer_runs(spark):
    def with_check(head):  # a last digit that makes the sum a multiple of ten
        return next(head + str(d) for d in range(10) if sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(head + str(d))))) % 10 == 0)

    long = {n: with_check("6" + "304512389674501273"[: n - 2]) for n in (12, 17, 18, 19)}
    texts = {1: ("card 12 4111 1111 1111 1111 ok", "4111 1111 1111 1111"), 2: ("12-4111-1111-1111-1111-7", "4111-1111-1111-1111"), 3: ("9999 1234 5555 4111 1111 1111 1111 10", "4111 1111 1111 1111"), 4: ("pay 77 3782 822463 10005 now", "3782 822463 10005")}
    texts |= {n: (f"card 5 {c} x", c) for n, c in long.items()}
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, (t, _) in texts.items()], DOC)
    for r in op6_pii.candidates(docs).collect():
        text, card = texts[r.doc_id]
        hits = [x for x in r.found if text[x.start : x.end] == card and x.kind == 2]
        assert len(hits) == 1 and not hits[0].base, text
