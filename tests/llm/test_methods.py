"""The methods themselves against brute force or the library, and cases at their limits."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import op1_tokens, op2_quality, op3_decontam, op4_capjoin, op7_toxicity, op8_mixing, op9_html
from skyweave.llm.common import fresh

# ------------------------------------------------------------------ 1


ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\tb", "a \tb\t c", "\na", "a\n", "x<|endoftext|>y", "it's.", "don't!? 'tis 's", "é. ñ, 漢字。😀!", "²? ½.", "\x00 a\x00 b", " a b　",
       "w" * 40 + " " + "v" * 17 + ". " + "u" * 16 + ".", "a.b. c.,; 1.5, 12.", "é. x", "\r\n a\r\nb", "\x1c a \x85b", "... ... ,", "a\x0bb \x0cc"]


@pytest.mark.parametrize("entries, piece", [(500_000, 200_000), (40, 15)])
def test_encoder_agrees_with_the_library(monkeypatch, entries, piece):
    monkeypatch.setattr(op1_tokens, "CACHE_ENTRIES", entries)
    monkeypatch.setattr(op1_tokens, "_PIECE", piece)
    rng = np.random.default_rng(21)
    letters = list("ab'.,! \n\t é1²\r😀s")
    texts = ODD + ["".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(3000)] + [" ".join("".join(rng.choice(list("abcdé."), int(rng.integers(1, 30)))) for _ in range(60)) for _ in range(50)]
    own = op1_tokens.WordEncoder(op1_tokens.tokenizer_file())
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        want = own.tokenizer.encode_batch_fast(part, add_special_tokens=False)
        assert [x.tolist() for x in own.encode(part)] == [w.ids for w in want]


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(22)
    for ids in (rng.zipf(1.4, 40_000).clip(0, 40_000), np.tile(rng.integers(0, 9, 50), 400), np.zeros(3000, dtype=np.int64), rng.integers(0, 3, 5000)):
        symbols, rules = op1_tokens.repair_compress(ids.astype(np.uint16), 50_257, 8)
        assert (op1_tokens._expand(symbols, rules, 50_257) == ids).all()
        seen: dict = collections.Counter()
        last: dict = {}
        for k, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
            if last.get(pair, -2) < k - 1:
                seen[pair] += 1
                last[pair] = k
        # what is left overlaps more frequent pairs of the last round, or is rare
        assert sum(n >= op1_tokens.LEAST for n in seen.values()) <= 0.01 * len(symbols) + 1
        used = collections.Counter(rules.reshape(-1).tolist())
        assert all(used[50_257 + k] + (symbols == 50_257 + k).sum() >= 1 for k in range(len(rules)))


# ------------------------------------------------------------------ 2 and 7


def marked(spark, n=300):
    rng = np.random.default_rng(23)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        y = int(rng.random() < 0.4)
        text = " ".join([*rng.choice(words, 30), *(["vile"] * 3 if y else ["kind"] * 3), *rng.choice(words, 30), *(["###"] * 30 if y else [])])
        rows.append((k, text, 1, 2))
        labels.append((k, 1 - y, y))
    return spark.createDataFrame(rows, "doc_id long, text string, _quality int, _toxicity int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op, label", [(op2_quality, "_quality"), (op7_toxicity, "_toxicity")])
def test_scores_keep_clashing_columns_and_repeated_labels(spark, op, label, monkeypatch):
    docs, labels = marked(spark)
    once = op.fit(docs, labels)
    many = docs
    for _ in range(3):  # the labelled rows stand eight times in the documents
        many = many.union(many)
    assert op.fit(many, labels) == once
    scored = op.score_documents(docs, once)
    assert scored.columns[:-1] == docs.columns and scored.columns[-1].startswith(label) and scored.select(label).distinct().count() == 1
    monkeypatch.setattr(op, "SAMPLE_ROWS", 50)
    assert op.score_documents(docs, op.fit(many, labels)).count() == docs.count()


def test_evidence_uses_every_segment(spark):
    docs, labels = marked(spark)
    model = op7_toxicity.fit(docs, labels)
    scorer = op7_toxicity.Scorer(model)
    rest = "w1 " * 40
    few, many = scorer.score(("vile " + rest) * 60), scorer.score(("vile " + rest) * 10_000)
    assert len(scorer.segments(scorer.words(("vile " + rest) * 10_000))) == 10_000
    assert many[0] >= few[0] >= scorer.score(rest * 60)[0]
    # by the definition, one r after the other
    import math

    for scores, n in (([3.0, 1.0, 2.5], 100), ([4.0] * 70, 500)):
        shift, total, most = math.log(model.k * n), 0.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += model.lam * s - shift
            if r == 1:
                most = model.evidence(s, n) - math.log(2)
            elif total > r - 1:
                most = max(most, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        assert model.joint_evidence(scores, n) == pytest.approx(max(0.0, most))


# ------------------------------------------------------------------ 3


def least_edits(pattern: bytes, text: bytes) -> int:
    """Least edits of the pattern against any part of the text."""
    row, chars, span = np.zeros(len(text) + 1, dtype=int), np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for c in pattern:
        new = np.empty(len(text) + 1, dtype=int)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (chars != c), row[1:] + 1)
        row = np.minimum.accumulate(new - span) + span
    return int(row.min())


def test_leaks_at_the_edit_budget():
    """Regions with a few edits less and more than the budget, against the edit distance itself."""
    rng = np.random.default_rng(24)
    letters = np.frombuffer(b"abcdefghij klmnop", np.uint8)
    draw = lambda n: bytes(rng.choice(letters, n))
    seen = collections.Counter()
    for _ in range(250):
        item = op3_decontam.normalise(draw(int(rng.integers(45, 220))).decode())
        w = min(len(item), op3_decontam.WINDOW)
        k = w // op3_decontam.PER_EDIT
        if len(item) < op3_decontam.SHORTEST:
            continue
        first = int(rng.integers(0, len(item) - w + 1))
        piece = bytearray(item[first : first + w])
        for _ in range(int(rng.integers(max(0, k - 2), k + 4))):
            how, at = rng.random(), int(rng.integers(len(piece)))
            if how < 0.4:
                piece[at] = int(rng.choice(letters))
            elif how < 0.7:
                del piece[at]
            else:
                piece.insert(at, int(rng.choice(letters)))
        text = op3_decontam.normalise((draw(int(rng.integers(0, 80))) + bytes(piece) + draw(int(rng.integers(0, 80)))).decode())
        want = any(least_edits(item[s : s + w], text) <= k for s in range(len(item) - w + 1))
        got = op3_decontam.Index.build([(1, item.decode())]).find(text)
        assert bool(got) == want, (item, text)
        seen[want] += 1
    assert min(seen.values()) > 40


def test_long_short_and_unnamed_items(spark):
    rng = np.random.default_rng(25)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 160_000))
    assert len(long) > 1 << 20
    items = [(5, long), (6, "short one"), (None, "Word-for word item"), (6, "SHORT one!"), (8, None), (9, " . ")]
    rows = [(0, "zzz " + long[600_000:600_400] + " yyy"), (1, "a Short, one here"), (2, "shorter one, a short onee"), (3, "é word for\nword item."), (4, long[600_000:600_060]), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_leaks", F.lit("own"))
    for part_chars in (op3_decontam.PART_CHARS, 10):
        found = op3_decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), part_chars=part_chars)
        assert found.columns[:-1] == docs.columns
        got = {r.doc_id: sorted((str(x.item_id) for x in r[-1])) for r in found.collect()}
        assert got == {0: ["5"], 1: ["6", "6"], 2: [], 3: ["None"], 4: [], 5: []}


# ------------------------------------------------------------------ 4 and 8


def test_vectors_with_null_and_repeated_ids(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one, 0), (1, other, 0), (2, other, 0), (None, one, 0), (3, one, 0), (4, one, 1)]
    schema = "vec_id long, embedding array<float>, label int"
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in op4_capjoin.link(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (None, 0, None, None)], key=str)
    assert op4_capjoin.link(spark.createDataFrame([], schema)).count() == 0


def test_mix_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "w " * (k + 1), "s", k) for k in range(9)], "doc_id long, text string, source string, mix_size long")
    mixed = op8_mixing.mix(docs)
    assert mixed.columns[:4] == docs.columns and [r.mix_size for r in mixed.orderBy("doc_id").collect()] == list(range(9))
    assert op8_mixing.repeat_copies(mixed).columns == docs.columns
    assert fresh(docs, "MIX_") == "MIX__"


# ------------------------------------------------------------------ 9


LONG = "one two three four five six seven eight nine ten "
PAGES = [
    (f"<article><header class='article-header'><h1>Head line</h1></header><p>{LONG * 3}</p></article>", 2),
    (f"<article><div class='share-price'><p>{LONG * 6}</p></div></article>", 1),
    (f"<div class='share-price'><p>{LONG * 6}</p></div>", 1),
    (f"<main><div class='social-policy tags'><p>{LONG * 5}</p></div></main>", 1),
    (f"<div class='story-header'><h1>Head line</h1></div><p>{LONG * 4}</p>", 2),
    (f"<nav><ul><li><a>x</a><article><h1>T t</h1><p>{LONG * 3}</p></article>", 2),
    (f"<article><p>{LONG * 9}</p><p>{LONG * 8}</p><p>Zu und auf der.</p></article><footer>&copy; site</footer>", 3),
    (f"<article><h1>T</h1><p>{LONG * 3}</p></article><section class=comments><article><p>{LONG * 4}</p></article></section>", 2),
    (f"<form id=page><div><h1>A title</h1><p>{LONG * 6}</p><p>{LONG * 5}</p></div></form>", 3),
]


def test_pages_keep_their_main_text():
    for page, n in PAGES:
        assert len(op9_html.extract(f"<body>{page}</body>").split("\n")) == n, page


def test_tree_on_held_out_pages():
    x, y = op9_html.labelled_table(held_out=True)
    assert (op9_html.tree().predict(x) == y).mean() > 0.98
    used = {op9_html.FEATURES[node[0]] for node in op9_html.tree().nodes if node[0] is not None}
    assert {"words", "links", "words_after", "links_before"} <= used


def test_page_table(spark):
    rows = [(1, "u", PAGES[0][0]), (1, "u", PAGES[0][0]), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "x " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_text", F.lit(0))
    got = op9_html.extract_pages(pages)
    assert got.columns[:-1] == pages.columns
    texts = [r[-1] for r in got.orderBy("page_id").collect()]
    assert texts[0] == "" and texts[1] == texts[2] == op9_html.extract(PAGES[0][0]) and texts[3] == "" and len(texts[4]) == 99_999
    assert op9_html.extract_pages(pages.where("false")).count() == 0
