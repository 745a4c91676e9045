"""Identifier, list-in-string and encoding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitise(c: Column, collapse: bool = False) -> Column:
    """Characters outside ``[A-Za-z0-9_.+-]`` become ``_``, a run of them one or as many."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.+-]" + ("+" if collapse else ""), "_")


def csv_items(c: Column) -> Column:
    """Non-empty parts of a comma list; none for null."""
    return F.coalesce(F.filter(F.split(c, ","), lambda x: x != ""), F.array().cast("array<string>"))


def csv_union(a: Column, b: Column, most: int | None = None) -> Column:
    """Sorted distinct parts of two lists, as a list."""
    both = F.array_sort(F.array_union(csv_items(a), csv_items(b)))
    return F.array_join(F.slice(both, 1, most) if most else both, ",")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the given order, as a comma list."""
    named = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs))
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), ",")


def base36(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 36))


def split_bucket(key: Column) -> Column:
    """0 to 99 from the first 8 hexadecimal digits of SHA-1."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long") % 100


def data_split(key: Column, train: int = 70, validation: int = 85) -> Column:
    bucket = split_bucket(key)
    return F.when(bucket < train, "train").when(bucket < validation, "validation").otherwise("test")


def matches_text(columns: list[Column], query: str) -> Column:
    """Case-insensitive substring search in any of the columns."""
    needle = F.lit(query.lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c.cast("string")), needle), F.lit(False))
    return found


def first_json_object(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def bucket_uri(cloud: Column) -> Column:
    """``s3://bucket/key`` from the nested cloud-access JSON."""
    bucket, key = F.get_json_object(cloud, "$.aws.bucket_name"), F.get_json_object(cloud, "$.aws.key")
    return F.when(bucket.isNotNull() & key.isNotNull(), F.concat(F.lit("s3://"), bucket, F.lit("/"), key))


def integer_ranges(c: Column) -> Column:
    """``3-7,9`` as distinct integers in order; parts that are no range are skipped."""
    bounds = F.transform(csv_items(F.regexp_replace(c, r"\s", "")), lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("a"), F.coalesce(F.regexp_extract(p, r"^\d+-(\d+)$", 1).try_cast("int"), F.regexp_extract(p, r"^(\d+)$", 1).try_cast("int")).alias("b")))
    good = F.filter(bounds, lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] <= p["b"]))
    return F.array_distinct(F.flatten(F.transform(good, lambda p: F.sequence(p["a"], p["b"]))))


def float_list(c: Column) -> Column:
    return F.filter(F.transform(csv_items(c), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def remove_suffixes(c: Column, *suffixes: str) -> Column:
    """Without each of the suffixes, in their order, where the text ends with it."""
    for s in suffixes:
        c = F.when(c.endswith(s), F.left(c, F.length(c) - len(s))).otherwise(c)
    return c


def campaign_and_target(run: Column, campaigns: list[str] | None = None) -> tuple[Column, Column]:
    """Campaign and target of a run name: by a known campaign, by the ``_cvj_`` mark, else the last
    underscore parts them and the whole name is the target."""
    stem = remove_suffixes(run, "_injected", "_baseline")
    campaign, target = F.when(stem.contains("_cvj_"), F.substring_index(stem, "_cvj_", 1)), F.when(stem.contains("_cvj_"), F.concat(F.lit("cvj_"), F.substr(stem, F.instr(stem, "_cvj_") + 5)))
    campaign, target = F.coalesce(campaign, F.regexp_extract(stem, "^(.*)_[^_]*$", 1)), F.coalesce(target, stem)
    for known in reversed(campaigns or []):
        same, inside = stem == known, stem.startswith(f"{known}_")
        campaign = F.when(same | inside, F.lit(known)).otherwise(campaign)
        target = F.when(same, stem).when(inside, F.substr(stem, F.lit(len(known) + 2))).otherwise(target)
    return campaign, target


def query_parameter(query: Column, name: str) -> Column:
    """First value of a parameter in a query string; a plus sign stays one. Null if absent."""
    parts = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == name)
    value = F.get(F.transform(parts, lambda p: F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("")), F.lit(0))
    return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def log_time(line: Column) -> Column:
    """Seconds since 1970 of the ISO time after the mark ``=== `` in a log line; null without one."""
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(F.regexp_extract(line, "=== ([^ ]+)", 1), F.lit(""))))


def run_parts(c: Column) -> dict[str, Column]:
    """Parts of a run name ``<campaign>_<target>_<kind>``, with tile and magnitude bin if named."""
    return {
        "run_kind": F.when(c.endswith("_injected"), "injected").when(c.endswith("_baseline"), "baseline").otherwise("science"),
        "campaign": F.regexp_replace(c, "_(injected|baseline)$", ""),
        "mag_bin": F.nullif(F.regexp_extract(c, r"_(g\d+(?:p\d+)?_\d+(?:p\d+)?)", 1), F.lit("")),
        "hpx": F.regexp_extract(c, r"hpx_nside\d+_[a-z]+_(\d+)", 1).try_cast("long"),
        "nside": F.regexp_extract(c, r"hpx_nside(\d+)_", 1).try_cast("int"),
    }


def first_known(*columns: Column, default: str | None = None) -> Column:
    """The first value that is known, else the default."""
    return F.coalesce(*columns, F.lit(default))


def payload_weight(text: Column) -> dict[str, Column]:
    """What a text weighs as a prompt: bytes, and tokens at 4, 3 and 2.5 characters each."""
    n = F.length(text)
    return {"n_bytes": F.octet_length(text).cast("long"), "tokens_4": F.bround(n / 4.0).cast("long"), "tokens_3": F.bround(n / 3.0).cast("long"), "tokens_2p5": F.bround(n / 2.5).cast("long")}
