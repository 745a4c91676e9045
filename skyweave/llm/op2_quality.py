"""Quality classifier: sparse rule ensemble over text statistics, compiled to column expressions.

Statistics of the whole texts are Spark columns. On a bounded sample of labelled rows small
trees are grown on random halves of rows and features; every path of every tree is a
conjunctive rule. A lasso logistic regression over the rules keeps few of them, and those are
compiled into one Spark expression, so that scoring is a scan without Python.

Defined results: null and empty texts have all statistics 0 and are scored like any text;
labelled rows with a null label are not used; of documents of one
doc_id the least text is learned, once for each label it has; a column of the result's name is kept,
the result then has underscores added; without labelled rows the score is 0.5 (the share
of label 1 where all labels are equal); repeated rows repeat. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import fold, fresh, table

#: Labelled rows used for the fit at most (the rows of smallest hash).
SAMPLE_ROWS = 12_000
TREES, DEPTH, LEAST_ROWS, CUTS = 60, 3, 12, 24
PENALTY = 4e-4
SEED = 11


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.when(whole > 0, whole), F.lit(0.0))


#: Classes of characters that are counted; one translation names each by its first character.
CLASSES = {"symbols": "#$%&*@^~<>{}[]\\_=+", "bars": "|/", "exclamations": "!", "digits": "0123456789", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "periods": ".?", "commas": ",;:"}


def with_statistics(docs: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` and the statistics of ``text`` as columns of that prefix, by name; all doubles, all 0
    for an empty text. Words, lines and classes are columns first, so each is made once."""
    t = F.coalesce(F.col("text"), F.lit(""))
    parts = {
        "_n": F.length(t), "_words": F.array_remove(F.split(t, r"\s+"), ""), "_lines": F.array_remove(F.split(t, r"\n"), ""),
        "_classes": F.translate(t, "".join(CLASSES.values()), "".join(c[0] * len(c) for c in CLASSES.values())),
    }
    docs = docs.withColumns({prefix + n: c for n, c in parts.items()})
    n, words, lines, classes = (F.col(prefix + p) for p in parts)
    found = {k: n - F.length(F.replace(classes, F.lit(c[0]))) for k, c in CLASSES.items()}
    count, n_lines = F.size(words), F.size(lines)
    stats = {
        "words": F.log1p(count.cast("double")),
        "word_length": _share(n, count),
        "distinct_words": _share(F.size(F.array_distinct(words)), count),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), n_lines),
        "words_a_line": _share(count, n_lines),
        "symbols": _share(found["symbols"], n),
        "bars": _share(found["bars"], n),
        "exclamations": _share(found["exclamations"], count),
        "digits": _share(found["digits"], n),
        "capitals": _share(found["capitals"], n),
        "stops": _share(found["periods"] + found["exclamations"], count),
        "commas": _share(found["commas"], count),
    }
    return docs.withColumns({prefix + k: c for k, c in stats.items()}).drop(*(prefix + p for p in parts)), {k: F.col(prefix + k) for k in stats}


@dataclass
class RuleModel:
    """Rules as tuples of (statistic, above?, cut), with weights; and the intercept."""

    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def expression(self, stats: dict[str, Column]) -> Column:
        """The score, 0 to 1."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & (stats[name] > cut if above else stats[name] <= cut)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int, path: tuple, out: set) -> None:
    if path:
        out.add(path)
    if depth == 0 or len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return
    best, gain = None, 1e-9
    base = len(y) * y.mean() * (1 - y.mean())
    for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        order = np.argsort(x[:, f], kind="stable")
        ones = np.cumsum(y[order])
        at = np.searchsorted(x[order, f], cuts[f], side="right")
        for cut, k in zip(cuts[f], at):
            if LEAST_ROWS <= k <= len(y) - LEAST_ROWS:
                low, high = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(y) - k)
                cost = k * low * (1 - low) + (len(y) - k) * high * (1 - high)
                if base - cost > gain:
                    best, gain = (int(f), float(cut)), base - cost
    if best:
        f, cut = best
        below = x[:, f] <= cut
        _grow(x[below], y[below], cuts, rng, depth - 1, (*path, (f, False, cut)), out)
        _grow(x[~below], y[~below], cuts, rng, depth - 1, (*path, (f, True, cut)), out)


def _lasso(h: np.ndarray, y: np.ndarray, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Logistic loss with an L1 penalty by accelerated proximal gradient steps; h is 0 or 1."""
    n, m = h.shape
    scale = np.sqrt(np.maximum(h.mean(axis=0) * (1 - h.mean(axis=0)), 1e-4))
    z = (h - h.mean(axis=0)) / scale
    lip = 0.25 * max(1.0, float(np.linalg.norm(z.T @ (z @ np.ones(m)) / n) / math.sqrt(m)))
    v = np.random.default_rng(SEED).standard_normal(m)
    for _ in range(30):  # largest eigenvalue of z'z / n
        v = z.T @ (z @ v) / n
        v /= np.linalg.norm(v) + 1e-12
    lip = 0.25 * float(np.linalg.norm(z.T @ (z @ v) / n)) + 0.3
    w, b = np.zeros(m), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ pw + pb, -30, 30))) - y
        nw = pw - (z.T @ r) / n / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - PENALTY / lip, 0)
        nb = pb - r.mean() / lip
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        if max(np.abs(nw - w).max(initial=0), abs(nb - b)) < 1e-7:
            w, b = nw, nb
            break
        w, b, t = nw, nb, nt
    w = w / scale
    return float(b - (w * h.mean(axis=0)).sum()), w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    if not len(y):
        return RuleModel()
    if y.min() == y.max():
        return RuleModel(intercept=30.0 if y[0] else -30.0)
    rng = np.random.default_rng(SEED)
    quantiles = np.linspace(0.01, 0.99, CUTS)
    # cuts lie between seen values and are rounded, so that a model prints and ships exactly
    cuts = [np.unique(np.round(np.quantile(x[:, f], quantiles), 6)) for f in range(x.shape[1])]
    paths: set = set()
    for _ in range(TREES):
        rows = rng.random(len(y)) < 0.5
        if rows.any():
            _grow(x[rows], y[rows], cuts, rng, DEPTH, (), paths)
    rules = sorted(paths)
    if not rules:
        return RuleModel(intercept=math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    h = np.ones((len(y), len(rules)), dtype=bool)
    for k, rule in enumerate(rules):
        for f, above, cut in rule:
            h[:, k] &= (x[:, f] > cut) == above
    _, first = np.unique(h, axis=1, return_index=True)  # rules that hold for the same rows are one
    first = np.sort(first)
    intercept, weights = _lasso(h[:, first].astype(float), y)
    kept = [(rules[i], float(w)) for i, w in zip(first, weights) if abs(w) > 1e-4]
    return RuleModel([tuple((names[f], above, cut) for f, above, cut in r) for r, _ in kept], [w for _, w in kept], intercept)


def fit(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Fit on labelled rows outside the held-out fold, at most SAMPLE_ROWS of them."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    picked = known.select("doc_id", F.col("quality").cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(SAMPLE_ROWS)
    # bounded by SAMPLE_ROWS ids; a repeated doc_id counts once, so the driver gets as many rows of
    # a dozen numbers at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked.distinct()), "doc_id")
    texts = texts.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    counted, stats = with_statistics(texts, "_quality_")
    rows = counted.select("doc_id", "_label", *(c.alias(n) for n, c in stats.items())).orderBy("doc_id", "_label").collect()
    x = np.array([[r[n] for n in stats] for r in rows], dtype=float).reshape(len(rows), len(stats))
    return fit_rules(x, np.array([r["_label"] for r in rows], dtype=float), list(stats))


def score_documents(docs: DataFrame, model: RuleModel, column: str = "_quality") -> DataFrame:
    """``docs`` with all their columns and the score as the last one."""
    column = fresh(docs, column)
    rows, stats = with_statistics(docs, f"{column}_")
    return rows.select(*docs.columns, model.expression(stats).alias(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.5).cast("int").alias("predicted"))
