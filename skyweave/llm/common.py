"""Shared helpers of the corpus operators: tables, shared storage, word and hash kernels."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the code points 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and driver and
    executors are one process (tests, a single machine) the checkpoint folder of the context is
    used, or a new temporary folder; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="skyweave-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


#: Tables of ``store`` and ``store_dealt`` that are not discarded yet.
_MADE: list[str] = []


def made() -> list[str]:
    """Paths of the work tables that exist now, in the order of their making."""
    return list(_MADE)


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/skyweave/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and
    survives lost executors. Returns the table and its path."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def store_dealt(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """``store``, dealt by ``key`` into as many buckets as the session has shuffle partitions:
    later joins by ``key`` don't shuffle the table. The key should have no hot values."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"skyweave_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(label)
    _CATALOG[path] = label
    return spark.table(label), path


_CATALOG: dict[str, str] = {}


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``store`` that no later step reads."""
    jvm = spark._jvm
    for path in paths:
        if path in _CATALOG:
            spark.sql(f"DROP TABLE IF EXISTS {_CATALOG.pop(path)}")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _MADE:
            _MADE.remove(path)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name with which no column of ``docs`` begins, whatever the case."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def text_column(name: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(column, modulus: int):
    """crc32 of the number as text, modulo ``modulus``: the folds of the learned scores."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[32, 9, 10, 11, 12, 13]] = True
_WORD_BYTE = (~_SPLIT).astype(np.int8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
        _TABLES[base] = have
    return have[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, A to Z lowered, in order, and their starts."""
    if not data:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), _BASE), out=total[1:])
        value = (total[ends] - total[starts]) * _powers(len(raw), _INVERSE)[starts]
        return mix(value + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; with fewer
    words the whole sequence is one shingle; without words none."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for k, text in enumerate(texts):
        group.append(text)
        held += len(text)
        if held > 1 << 20 or k == len(texts) - 1:
            out.extend(_shingle_group(group, width))
            group, held = [], 0
    return out


def _shingle_group(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, ends)
    with np.errstate(over="ignore"):
        acc = np.full(max(0, len(words) - width + 1), np.uint64(width), dtype=np.uint64)
        for k in range(width):
            acc = mix(acc * np.uint64(0x100000001B3) + words[k : k + len(acc)])
    out = []
    first = 0
    for last in upto.tolist():
        n = last - first
        if n >= width:
            out.append(np.unique(acc[first : last - width + 1]))
        elif n == 0:
            out.append(np.zeros(0, dtype=np.uint64))
        else:
            with np.errstate(over="ignore"):
                whole = np.full(1, np.uint64(n), dtype=np.uint64)
                for w in words[first:last]:
                    whole = mix(whole * np.uint64(0x100000001B3) + w)
            out.append(whole)
        first = last
    return out
