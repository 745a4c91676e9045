"""Every registered corpus query and the pipeline on whole small tables."""

import collections
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyweave.llm import common, op3_decontam, registry
from tests.llm.test_corpus_small import WORDS, brute_near

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, Mix_size int"


def write(spark, folder, docs, labels, bench=(), pages=(), vectors=()):
    tables = {
        "documents": (docs, DOCS), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (list(bench), "item_id long, text string"),
        "pages": (list(pages), "page_id long, url string, html string"), "embeddings": (list(vectors), "vec_id long, embedding array<float>, label int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = np.random.default_rng(31)
    docs, labels = [], []
    for k in range(240):
        toxic = k % 6 == 5
        text = sentence(rng, int(rng.integers(40, 120))) + (" vile grim foul vile foul" if toxic else "")
        docs.append((k, text, "en", [None, "a", "b"][k % 3], len(text), "r", 0))
        labels.append((k, int(not toxic), int(toxic)))
    base = docs[0][1].split()
    near = [*base]
    near[len(near) // 2] = "other"
    item = sentence(rng, 30)
    extra = [(300, docs[0][1]), (301, " ".join(near)), (0, docs[0][1]), (None, docs[0][1]), (None, None), (302, None), (303, ""), (304, " \n"), (305, sentence(rng, 20) + " " + item + " " + sentence(rng, 20)), (306, sentence(rng, 30_000)), (0, "another text under this id " + sentence(rng, 30))]
    docs += [(i, t, None, "b", None, None, None) for i, t in extra]
    folder = tmp_path_factory.mktemp("small")
    return write(spark, folder / "data", docs, [*labels, (None, 1, 0), (300, None, None)], [(7, item), (None, "x")], [(1, "u", "<article><p>one two</p></article>"), (None, None, None)], [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, None, None)])


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing") / "data", [], [])


CONTRACT = {
    "op1": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op2": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op3": [("doc_id", "bigint")],
    "op4": [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op5": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op6": [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")), ("base_sha256", "string"), ("spans", "string")],
    "op7": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op8": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op9": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op10": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op11": [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")],
    "op12": [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")],
}
TABLE = {"op4": "embeddings", "op9": "pages", "op11": "embeddings"}


@pytest.mark.parametrize("name", [n for n in registry.queries() if n != "pipeline"])
def test_query_columns_rows_and_folds(spark, small, nothing, name):
    op = name.split("_")[0]
    source = TABLE.get(op, "documents")
    out = registry.queries()[name](spark, small)
    assert out.dtypes[: len(CONTRACT[op])] == CONTRACT[op]
    rows = out.collect()
    own = spark.read.parquet(f"{small}/{source}.parquet")
    own = own.dropna(subset=["embedding"]) if op == "op11" else own
    key = own.columns[0]
    assert collections.Counter(r[key] for r in rows) == collections.Counter(r[0] for r in own.select(key).collect())
    if "held_out" in out.columns:
        folds, held = (3, 1) if op == "op2" else (5, 0)
        for r in rows:
            assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    empty = registry.queries()[name](spark, nothing)
    assert empty.dtypes == out.dtypes and empty.count() == 0


def tables(spark):
    folder = f"{common.shared_dir(spark)}/skyweave"
    path = folder.removeprefix("file:")
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def stage_by_stage(spark, folder, tmp):
    """The documents after each stage, written and read again as the pipeline's users do."""
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp}/{name}")
        found[name] = (before, docs)
    return found


def test_pipeline_stages(spark, small, tmp_path):
    found = stage_by_stage(spark, small, str(tmp_path))
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    for name, (before, after) in list(found.items())[:-1]:
        assert after.columns == columns, name
    rows = lambda df: collections.Counter(tuple(r) for r in df.collect())

    before, after = map(rows, found["toxicity"])
    assert {r[0] for r in (before - after)} == {k for k in range(240) if k % 6 == 5} and not after - before

    # near duplicates by brute force: every row is a document, linked by its five-word shingles
    before, after = (df.collect() for df in found["near_duplicates"])
    root, _ = brute_near([(k, r.text) for k, r in enumerate(before)], corpus_pipeline.SHINGLE_WORDS)
    groups = collections.defaultdict(list)
    for k, r in enumerate(before):
        groups[root[k]].append(r)
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert len(after) == len(groups)
    kept = collections.Counter((r.doc_id, r.text) for r in after)
    for group in groups.values():
        least = min(map(order, group))
        assert any(kept[r.doc_id, r.text] for r in group if order(r) == least)

    before, after = (df.collect() for df in found["decontamination"])
    gone = collections.Counter(r.doc_id for r in before) - collections.Counter(r.doc_id for r in after)
    assert gone == {305: 1}
    index = op3_decontam.Index.build([(r[0], r[1]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    assert all(not index.find(op3_decontam.normalise(r.text)) for r in after)

    before, after = (df.collect() for df in found["mixing"])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, taken = collections.Counter(), collections.Counter()
    for r in before:
        have[r.source] += size(r.text)
    for r in after:
        taken[r.source] += size(r.text)
    copies = collections.Counter(tuple(r) for r in after)
    stock = collections.Counter(tuple(r) for r in before)
    assert all(n <= 3 * stock[r] for r, n in copies.items())
    total, weight = sum(have.values()), {"a": 1, "b": 2, None: 3}
    cap = {s: 3 * have[s] for s in have}
    free, level = set(have), 0.0
    while True:
        level = (total - sum(cap[s] for s in have if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap[s]}
        if not over:
            break
        free -= over
    largest = max(size(r.text) for r in before)
    assert all(abs(taken[s] - (level * weight[s] if s in free else cap[s])) <= largest / 2 + 1 for s in have)

    before, after = (df.collect() for df in found["token_ids"])
    assert collections.Counter(r.doc_id for r in after) == collections.Counter(r.doc_id for r in before)
    ends = sorted((r.start, r.n_tokens) for r in after)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_pipeline_leaves_only_its_result(spark, small):
    corpus_pipeline._release(spark)
    before = set(tables(spark))
    out = corpus_pipeline.run(spark, small)
    left = set(tables(spark)) - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-token_ids") and out.count() > 0
    again = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_pipeline_of_nothing(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_stages_keep_wide_tables(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("_toxicity", F.lit(1)).withColumn("_leaks", F.lit("x")).withColumn("node", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        assert spark.read.parquet(f"{tmp_path}/{name}").columns == docs.columns
