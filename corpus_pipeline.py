"""From raw documents to token shards: toxicity filter, near-duplicate removal, benchmark
decontamination, mixing to target weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table: all but the last the columns of
``docs``. ``run`` writes every stage's table to the shared folder and reads it back.

A stage's work tables lie in the shared folder until its result is written; the next stage, or
the end of ``run``, deletes them. So write a stage's result before calling another stage.

Defined results, beside those of the operators: every row is a document of its own, whatever its
doc_id (equal and null ids too). Of linked rows the near-duplicate stage keeps the one of
smallest doc_id (null last), then of smallest text hash; rows without words stay. Other columns
pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import op1_tokens, op3_decontam, op5_minhash, op7_toxicity, op8_mixing
from skyweave.llm.common import discard, fresh, made, store, store_dealt, table

#: Words of a shingle in the near-duplicate stage; the similarity is the operator's 0.8.
SHINGLE_WORDS = 5

#: Work tables that the last stage's result still reads.
_IN_USE: list[str] = []


def _release(spark: SparkSession) -> None:
    discard(spark, *_IN_USE)
    _IN_USE.clear()


def _stage(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(spark)
        before = set(made())
        out = stage(spark, docs, sf_dir)
        _IN_USE.extend(path for path in made() if path not in before)
        return out

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict as toxic. Texts go to the workers in
    batches of bounded bytes."""
    name = fresh(docs, "_toxicity")
    # the result is written here, where the bound on batches holds
    with op1_tokens.small_batches(spark):
        model = op7_toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
        kept, _ = store(op7_toxicity.score_documents(docs, model, name).where(F.col(name)["predicted"] == 0).select(*docs.columns), "clean")
    return kept


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Whole rows are dealt once by a row number; the sets and the final filter are then joined
    where the rows lie."""
    row = fresh(docs, "_row")
    rows, _ = store_dealt(docs.withColumn(row, F.monotonically_increasing_id()), "rows", row)
    found, paths = op5_minhash.link(rows.select(F.col(row).alias("doc_id"), "text"), SHINGLE_WORDS)
    order = rows.select(F.col(row).alias("_id"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), F.col(row).alias("row")).alias("_o"))
    placed = found.select(F.col("doc_id").alias("_id"), "component_id").join(order, "_id")
    kept, _ = store(placed.groupBy("component_id").agg(F.min("_o").alias("o")).select(F.col("o.row").alias(row)), "kept")
    discard(spark, *paths)
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a region of a benchmark item."""
    name = fresh(docs, "_leaks")
    return op3_decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), name).where(F.size(name) == 0).select(*docs.columns)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as it is taken."""
    return op8_mixing.repeat_copies(op8_mixing.mix(docs, tie=F.xxhash64("text"))).select(*docs.columns)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix; a row for each document copy in them."""
    return op1_tokens.token_stream(docs.select("doc_id", "text"), op1_tokens.tokenizer_file())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: Fitted models, banding and rounding to copies are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of all tables made on the way only theirs are left."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir), f"stage-{name}")
        _release(spark)
        discard(spark, *before)
        before = [path]
    return docs
