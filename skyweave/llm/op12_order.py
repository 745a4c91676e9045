"""Document fingerprints by Order MinHash, with column functions only.

A text's words are cut into pieces of at most ``PIECE`` code points, and ``K`` pieces in a row are
a k-mer (with fewer pieces the whole sequence is one). Equal k-mers of a text are numbered by
occurrence, in text order; a hash of (k-mer, occurrence number) deals each of these pairs into one
of ``TUPLES`` x ``PAIRS`` cells and orders those of a cell. Each cell's minimal pair is selected;
the selected pairs of a tuple are put in the order of their places in the text, and the hash of
that sequence is the tuple's signature. So a signature stands for which pairs are minimal and for
their order: moved, repeated or replaced passages change it in proportion to the edit, where
unordered MinHash sees a set. (Marcais et al., 2019, with one permutation cut into cells in place
of one for each tuple, so that a text is sorted twice and not once for each signature.)

All of it is array expressions within the row: no k-mer is ever shuffled. Occurrence numbers come
from the sorted array of (hash, place) by a search over powers of two for the first place of the
run of equal hashes, so a word repeated through a whole text costs a logarithm more.

Defined results. A null text is empty. Texts without words have an empty fingerprint; two of them
are alike (1.0), one and another text are not (0.0). In the order of documents null ids come last,
equal ids by a digest of their texts, and rows that repeat both id and text stand once, so all of
them get the same next document. A single document follows itself. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.llm.common import WORD_PATTERN, discard, store, table, text_column

#: Code points of a piece, pieces of a k-mer, signatures of a fingerprint, pairs of a signature.
PIECE, K, TUPLES, PAIRS = 4, 3, 64, 2
#: Bits of a place in an array of pieces (as many as an array can have), of a signature's value.
_PLACE, _VALUE = 31, 16
_STEPS = ", ".join(str(1 << b) for b in range(30, -1, -1))
_CELL = 64 - (TUPLES * PAIRS - 1).bit_length()


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the signatures of the column ``text``, an array of (tuple << 16 | value)
    without those of empty tuples."""
    keep = [c for c in df.columns if c != name]
    pieces = WORD_PATTERN.rstrip("+") + f"{{1,{PIECE}}}"
    hashed = df.select(*keep, F.transform(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), lambda x: F.xxhash64(x)).alias("_h"))
    parts = ", ".join(f"try_element_at(_h, i + {j + 1})" for j in range(K))
    mers = hashed.select(*keep, F.expr(f"sort_array(transform(slice(_h, 1, greatest(size(_h) - {K - 1}, 1)), (x, i) -> shiftleft(xxhash64({parts}), {_PLACE}) | i))").alias("_p"))
    same = f"shiftright(_p[j - {{}}], {_PLACE}) = shiftright(x, {_PLACE})"
    search = f"aggregate(array({_STEPS}), 0, (d, b) -> if(b <= j - d and {same.format('d - b')}, d + b, d))"
    run = f"if(j = 0 or not {same.format(1)}, 0, if(j = 1 or not {same.format(2)}, 1, {search}))"
    place = (1 << _PLACE) - 1
    pairs = mers.select(*keep, F.expr(f"sort_array(transform(_p, (x, j) -> shiftleft(xxhash64(shiftright(x, {_PLACE}), {run}), {_PLACE}) | (x & {place})))").alias("_q"))
    least = pairs.select(*keep, F.expr(f"filter(_q, (x, j) -> j = 0 or shiftrightunsigned(_q[j - 1], {_CELL}) != shiftrightunsigned(x, {_CELL}))").alias("_m"))
    tuple_ = 64 - (TUPLES - 1).bit_length()
    group = f"filter(slice(_m, j + 1, {PAIRS}), y -> shiftrightunsigned(y, {tuple_}) = shiftrightunsigned(x, {tuple_}))"
    ordered = f"array_sort(transform({group}, y -> struct(y & {place} as place, shiftright(y, {_PLACE}) as pair)))"
    value = f"xxhash64(transform({ordered}, z -> z.pair)) & {(1 << _VALUE) - 1}"
    entry = f"if(j > 0 and shiftrightunsigned(_m[j - 1], {tuple_}) = shiftrightunsigned(x, {tuple_}), null, cast(shiftleft(shiftrightunsigned(x, {tuple_}), {_VALUE}) | ({value}) as int))"
    return least.select(*keep, F.expr(f"filter(transform(_m, (x, j) -> {entry}), y -> y is not null)").alias(name))


def likeness(a: str, b: str) -> Column:
    """Equal signatures of all tuples that either text has; 1.0 if both have none."""
    tuples = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, _VALUE)), F.transform(b, lambda x: F.shiftright(x, _VALUE))))
    return F.when(tuples == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / tuples)


def as_text(signatures: str) -> Column:
    """Six hex digits for every signature: two of its tuple, four of its value."""
    return F.array_join(F.transform(F.array_sort(signatures), lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def _key(doc_id: Column, text: Column) -> Column:
    """A digest of id and text."""
    said = doc_id.cast("string")
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.length(said), F.lit(-1)).cast("string"), F.coalesce(said, F.lit("")), text)))


def next_documents(keyed: DataFrame) -> tuple[DataFrame, list[str]]:
    """(key, doc_id, n_chars, next_key) of every different document of (key, doc_id, text), in
    ascending order of doc_id; the last is followed by the first. Ids are sorted in ranges; the
    only rows that meet are one for each range."""
    slim, at = store(keyed.groupBy("key", "doc_id").agg(F.max(F.length("text")).cast("long").alias("n_chars")), "order-slim")
    rank = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")]
    ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, at_dealt = store(slim.repartitionByRange(ranges, *rank).select("*", F.spark_partition_id().alias("range")), "order-ranges")
    firsts = dealt.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("first_key"))
    # one row for each range, as many as shuffle partitions
    follow = firsts.select("range", F.coalesce(F.lead("first_key").over(Window.orderBy("range")), F.first("first_key").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = dealt.withColumn("inside", F.lead("key").over(Window.partitionBy("range").orderBy(*rank)))
    linked = inside.join(F.broadcast(follow), "range").select("key", "doc_id", "n_chars", F.coalesce("inside", "after").alias("next_key"))
    found, at_links = store(linked, "order-links")
    discard(keyed.sparkSession, at, at_dealt)
    return found, [at_links]


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(key, next_key, doc_id, n_chars, text, edited_text) of every row: the last quarter of the
    text's code points is replaced by as many first ones of the next document. The texts are
    shuffled once, by key, for both joins."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text")).withColumn("key", _key(F.col("doc_id"), F.col("text")))
    links, paths = next_documents(keyed)
    texts = keyed.select("key", "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = links.select("key", "doc_id", "n_chars", "next_key")
    one = texts.withColumnRenamed("key", "next_key").join(wanted.hint("shuffle_hash"), "next_key")
    # of equal texts under one key any one gives the head
    heads = one.select("key", "next_key", "doc_id", "n_chars", F.left("text", quarter).alias("head")).groupBy("key").agg(*[F.max(c).alias(c) for c in ("next_key", "doc_id", "n_chars", "head")])
    both = texts.join(heads.hint("shuffle_hash"), "key")
    return both.select("key", "next_key", "doc_id", "n_chars", "text", F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), "head").alias("edited_text")), paths


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_chars, edited_sha256, signatures, edited_signatures, near_edited, near_next."""
    changed, _ = edited(docs, id_col, text_col)
    signed = with_signatures(with_signatures(changed, "text", "signatures").withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256)).drop("text"), "edited_text", "edited_signatures").drop("edited_text")
    mine, _ = store(signed, "order-signed")
    following = mine.select(F.col("key").alias("next_key"), F.col("signatures").alias("next_signatures")).groupBy("next_key").agg(F.max("next_signatures").alias("next_signatures"))
    return mine.join(following, "next_key").select("doc_id", "n_chars", "edited_sha256", "signatures", "edited_signatures", likeness("signatures", "edited_signatures").alias("near_edited"), likeness("signatures", "next_signatures").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text("signatures").alias("fingerprint"), as_text("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next")
