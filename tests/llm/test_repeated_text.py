"""Decontamination where texts, items or both repeat one line: one leak, in little time, as brute
force has it."""

import time

import numpy as np
import pytest

from skyweave.llm import op3_decontam as op3

LINE = "the quick brown fox jumps over the lazy dog near river"
OTHER = "five wizards mixed their jugs of liquid amber vapour again"


def search(item, text):
    return op3.Index.build([(1, item)]).find(op3.normalise(text))


def test_a_repeated_line_is_one_leak_and_fast():
    item = f"{LINE}. " * 85
    text = f"some intro text here. {f'{LINE}! ' * 1850}{OTHER}"
    assert len(text) > 100_000
    index = op3.Index.build([(1, item), (2, f"{OTHER}, " * 1700)])
    data = op3.normalise(text)
    began = time.perf_counter()
    found = index.find_long(data)
    assert time.perf_counter() - began < 1.0
    assert [n for n, _, _ in found] == [0]  # the other line stands once, its windows span two
    (_, a, b), size = found[0], len(op3.normalise(f"{LINE}! " * 1850))
    assert abs(a - len("some intro text here ")) <= 25 and abs(b - a - size) <= 50
    assert len(index.keys) < 300  # both items are as small as their lines


def test_leaks_apart_stay_apart():
    filler = " ".join(f"w{k * k % 997}" for k in range(300))
    found = search(f"{LINE}. " * 40, f"{filler} {f'{LINE} ' * 3} {filler} {f'{LINE} ' * 30}{filler}")
    assert len(found) == 2 and found[0][2] < found[1][1] and found[1][2] - found[1][1] > 8 * (found[0][2] - found[0][1])


def brute(item, text):
    """Whether some window of the item lies within its edits of some part of the text."""
    item, text = op3.normalise(item), op3.normalise(text)
    w = min(len(item), op3.WINDOW)
    k = w // op3.PER_EDIT
    own = np.frombuffer(text, dtype=np.uint8)
    for s in range(len(item) - w + 1):
        row = np.zeros(len(own) + 1, dtype=np.int64)
        for r, c in enumerate(item[s : s + w]):
            step = np.minimum(row[:-1] + (own != c), row[1:] + 1)
            row = np.minimum.accumulate(np.concatenate(([r + 1], step)) - np.arange(len(own) + 1)) + np.arange(len(own) + 1)
        if row.min() <= k:
            return True
    return False


@pytest.mark.parametrize("seed", range(12))
def test_repetition_agrees_with_brute_force(seed):
    """Lines of short period, some of them edited, in items and texts."""
    rng = np.random.default_rng(seed)
    unit = "".join(rng.choice(list("abcde "), int(rng.integers(3, 60))))
    line = lambda n, edits: "".join(c if rng.random() > edits else "z" for c in unit * n)
    item = line(1 + 220 // len(unit), 0.0)
    for edits in (0.0, 0.06, 0.12, 0.25):
        text = "some words before " + line(1 + 300 // len(unit), edits) + " and after"
        assert bool(search(item, text)) == brute(item, text)


def test_a_leak_across_segments(monkeypatch):
    monkeypatch.setattr(op3, "SEGMENT", 512)
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("lo", "mar", "tes", "quin") for b in ("do", "vis", "ter", "um")]
    prose = lambda n: " ".join(rng.choice(words, n))
    item = prose(25)
    for before in range(60, 110, 3):
        text = f"{prose(before)} {item} {prose(90)}"
        found = search(item, text)
        assert len(found) == 1 and op3.normalise(text)[found[0][1] : found[0][2]] == op3.normalise(item)


def test_a_benchmark_in_parts_finds_the_same(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("lo", "mar", "tes", "quin") for b in ("do", "vis", "ter", "um")]
    prose = lambda n: " ".join(rng.choice(words, n))
    items = [(k, prose(20)) for k in range(12)] + [(None, prose(20))]
    docs = [(k, f"{prose(30)} {items[k % 13][1]} {items[(k * 5) % 13][1] if k % 2 else ''}", "x") for k in range(20)] + [(None, prose(50), "y"), (3, None, "z"), (3, "", "z")]
    table = spark.createDataFrame(docs, "doc_id long, text string, _row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda part: sorted(((r.doc_id, r.text, r._row, sorted(map(tuple, r._leaks), key=str)) for r in op3.find_leaks(table, bench, part_chars=part).collect()), key=str)
    assert rows(300) == rows(4_000_000) and sum(map(bool, (r[3] for r in rows(300)))) == 20
    assert op3.find_leaks(table, bench.limit(0)).where("size(_leaks) > 0").count() == 0
