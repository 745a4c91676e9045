"""Toxicity: maximum-scoring segment search over token log-odds, calibrated by extreme values.

Fit, on a bounded sample of labelled rows (``SAMPLE_ROWS``): units (words and word prefixes)
are counted by the toxic and clean documents that hold them (a word that one document repeats
is one observation, and so are documents of one minimum triple hash, mostly copies); a unit's
log-odds ratio has a Dirichlet prior, part uniform, part proportional to its share of the
background. Units whose likelihood ratio exceeds what the best of all tested units reaches by
chance score that ratio, shrunk by its deviation; every other word scores a small negative
constant. A word takes the score of its longest scoring unit.

Score: a linear scan lists all maximal scoring segments of a document (no segment of higher
score overlaps one). Scores of the best segment of clean documents follow an extreme-value law
``P(M < x) = exp(-K n exp(-lambda x))`` over n words; lambda solves the usual moment equation
over the words of clean documents, K is the maximum-likelihood value on held-back sample rows.
The segments' expected counts ``K n exp(-lambda s)`` say which are significant, and a logistic
link on the calibrated evidence of a document gives its score. That evidence comes from the sum
of its r best normalised segment scores ``lambda s - ln(K n)``, whose tail is
``exp(-t) t^(r-1) / (r! (r-1)!)``, each r discounted by 2^-r and the best r taken.

Defined results: null and empty texts have no segments and score as a document without
evidence; of documents of one doc_id the least text is learned, once for each label it has; a column
of the result's name is kept, the result then has underscores added; a
documents row repeats if it is repeated; without any labelled toxic row all scores are the
share of toxic rows (0 without labels). Only doc_id and text are read from documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import fold, fresh, table

#: Labelled rows used for the fit at most (the rows of smallest hash), and the share kept back
#: from the unit counts for calibration.
SAMPLE_ROWS, CALIBRATION_SHARE = 12_000, 0.34
#: Prefix lengths that are units beside the whole word.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Least shrunk ratio and documents of a unit, strength of the Dirichlet prior (documents, and
#: share of the background), score of other words.
LEAST_ODDS, LEAST_COUNT, PRIOR, REST_SCORE = 2.0, 3, (0.5, 0.01), -0.35
SIGNIFICANT = 0.05
_WORD = re.compile(r"\w+")
_MEMO_WORDS = 200_000
#: Units that a task counts at once.
COUNTED_UNITS = 50_000


def units(word: str) -> list[str]:
    """The whole word (closed by a blank) and its prefixes."""
    return [word + " ", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class ToxicModel:
    scores: dict[str, float] = field(default_factory=dict)
    rest: float = REST_SCORE
    lam: float = 1.0
    k: float = 1e-3
    slope: float = 1.0
    intercept: float = 0.0
    base_rate: float = 0.0

    def word_score(self, word: str) -> float:
        got = self.scores.get(word + " ")
        if got is not None:
            return got
        for k in reversed(PREFIXES):
            if len(word) >= k:
                got = self.scores.get(word[:k])
                if got is not None:
                    return got
        return self.rest

    def evidence(self, best: float, n: int) -> float:
        """Minus the log of the chance that a clean document of n words has a segment this good."""
        if best <= 0 or n == 0:
            return 0.0
        expected = self.k * n * math.exp(-min(self.lam * best, 700.0))
        return -math.log(max(-math.expm1(-expected), 1e-300))

    def joint_evidence(self, scores: list[float], n: int) -> float:
        """Minus the log of the chance of the r best segments together, for the best r."""
        if not scores or n == 0:
            return 0.0
        best = np.sort(np.asarray(scores, dtype=np.float64))[::-1]
        most = self.evidence(float(best[0]), n) - math.log(2)
        if len(best) > 1:
            r = np.arange(1, len(best) + 1)
            total = np.cumsum(self.lam * best - math.log(self.k * n))
            logs = np.cumsum(np.log(r))  # of the factorials
            fit = (total > r - 1) & (r > 1)
            if fit.any():
                r, total, logs = r[fit], total[fit], logs[fit]
                most = max(most, float((total - (r - 1) * np.log(total) + 2 * logs - np.log(r) - r * math.log(2)).max()))
        return max(0.0, most)

    def probability(self, evidence: float) -> float:
        if not self.scores:
            return self.base_rate
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * math.log1p(evidence)))))


def maximal_segments(at: list[int], values: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence whose elements at the
    ascending places ``at`` have the positive ``values`` and all others ``rest`` <= 0.

    Linear-time stack scan: each segment keeps the running total before and after it."""
    stack: list[list] = []  # first, last, total before, total after
    total, behind = 0.0, 0
    for place, value in zip(at, values):
        total += rest * (place - behind)
        behind = place + 1
        new = [place, place, total, total + value]
        total += value
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append(new)
    return [(a, b, after - before) for a, b, before, after in stack]


class Scorer:
    """Scores texts with a model; word scores are memoised up to a bound."""

    def __init__(self, model: ToxicModel):
        self.model, self.memo = model, {}

    def words(self, text: str | None) -> list[str]:
        return _WORD.findall((text or "").lower())

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        memo = self.memo
        fresh = set(words).difference(memo)
        if fresh:
            if len(memo) > _MEMO_WORDS:
                memo.clear()
                fresh = set(words)
            score = self.model.word_score
            memo.update((w, score(w)) for w in fresh)
        values = np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))
        at = np.flatnonzero(values > 0)
        return maximal_segments(at.tolist(), values[at].tolist(), self.model.rest) if len(at) else []

    def score(self, text: str | None) -> tuple[float, int, float]:
        """(score, significant segments, joint evidence)."""
        words = self.words(text)
        found = self.segments(words)
        n = len(words)
        evidence = self.model.joint_evidence([s for _, _, s in found], n)
        cut = -math.log(SIGNIFICANT)
        return self.model.probability(evidence), sum(self.model.evidence(s, n) >= cut for _, _, s in found), evidence

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant passages as (begin, end, score, evidence), in code points of the text."""
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # lowering changed lengths: keep places of the original
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans = [m.span() for m in _WORD.finditer(low)]
        found = self.segments([low[a:b] for a, b in spans])
        cut = -math.log(SIGNIFICANT)
        scored = ((spans[a][0], spans[b][1], s, self.model.evidence(s, len(spans))) for a, b, s in found)
        return [x for x in scored if x[3] >= cut]


def sample_labels(labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows outside the held-out fold, those of smallest hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    return known.select("doc_id", F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(rows)


def _sketch():
    """Pandas UDF: the least hash of three words in a row, of the whole text below three words."""

    @F.pandas_udf("long")
    def sketch(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = _WORD.findall((text or "").lower())
            out.append(min((zlib.crc32(" ".join(t).encode()) for t in zip(words, words[1:], words[2:])), default=zlib.crc32(" ".join(words).encode()) + (1 << 32)))
        return pd.Series(out, dtype="int64")

    return sketch


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on the labelled rows whose fold is not held out."""
    picked = sample_labels(labels, "toxic", 5, 0, SAMPLE_ROWS)
    # bounded by SAMPLE_ROWS ids: small enough to be sent to every executor
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked.distinct()), "doc_id")
    texts = texts.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)
    texts = texts.select("text", "_label", calibrate.alias("_back")).persist()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], int] = Counter()

        def flush() -> pd.DataFrame:
            rows = pd.DataFrame([(u, n if t else 0, 0 if t else n) for (u, t), n in total.items()], columns=["unit", "n1", "n0"])
            total.clear()
            return rows

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["_label"]):
                total["\x00docs", toxic] += 1
                total.update((u, toxic) for u in {u for w in set(_WORD.findall((text or "").lower())) for u in units(w)})
                if len(total) >= COUNTED_UNITS:  # counts are summed later: a task holds no more than these
                    yield flush()
        if total:
            yield flush()

    counts = texts.where(~F.col("_back")).withColumn("_s", _sketch()("text")).dropDuplicates(["_s", "_label"]).select("text", "_label").mapInPandas(count, "unit string, n1 long, n0 long").groupBy("unit").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    kept = counts.where((F.col("n1") >= LEAST_COUNT) | F.col("unit").startswith("\x00")).toPandas()  # bounded by the sample
    docs_seen = kept[kept["unit"] == "\x00docs"][["n1", "n0"]].sum()
    kept = kept[~kept["unit"].str.startswith("\x00")].sort_values("unit")
    model = ToxicModel(base_rate=float(docs_seen["n1"] / max(1, docs_seen.sum())))
    big1, big0 = float(docs_seen["n1"]), float(docs_seen["n0"])
    if big1 == 0 or big0 == 0 or kept.empty:
        texts.unpersist()
        return model
    n1, n0 = kept["n1"].to_numpy(float), kept["n0"].to_numpy(float)
    tested = max(2, len(kept))
    background = PRIOR[1] * (big1 + big0)
    alpha = PRIOR[0] + background * (n1 + n0) / (big1 + big0)
    odds = np.log((n1 + alpha) / (big1 + background + 1 - n1)) - np.log((n0 + alpha) / (big0 + background + 1 - n0))
    spread = np.sqrt(1 / (n1 + alpha) + 1 / (n0 + alpha))
    share = big1 / (big1 + big0)
    ratio = 2 * (n1 * np.log(np.maximum(n1, 1e-9) / ((n1 + n0) * share)) + n0 * np.log(np.maximum(n0, 1e-9) / ((n1 + n0) * (1 - share))))
    strong = np.flatnonzero((ratio >= 2 * math.log(tested) + 2) & (odds - spread >= LEAST_ODDS))
    strong = strong[np.argsort(-ratio[strong], kind="stable")]
    if not len(strong):
        texts.unpersist()
        return model
    names = kept["unit"].to_numpy()
    left = {names[i]: [n1[i], n0[i]] for i in strong}
    for i in sorted(strong, key=lambda i: (-len(names[i]), names[i])):
        # a prefix is judged by what its longer units leave; one that only they made toxic goes
        name = names[i]
        toxic, clean = left[name]
        if clean > 0 and (toxic + alpha[i]) * (big0 + 1) < math.exp(LEAST_ODDS) * (clean + alpha[i]) * (big1 + 1):
            continue
        model.scores[name] = float(odds[i] - spread[i])
        for k in PREFIXES:
            above = left.get(name[:k]) if len(name) > k else None
            if above is not None:
                above[0], above[1] = max(0.0, above[0] - toxic), max(0.0, above[1] - clean)
    _calibrate(model, texts.where("_back"), texts)
    texts.unpersist()
    return model


def _calibrate(model: ToxicModel, back: DataFrame, texts: DataFrame) -> None:
    """Extreme-value law of clean rows and the logistic link, on the rows kept back."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["_label"]):
                words = scorer.words(text)
                found = scorer.segments(words)
                hits = sum(scorer.memo[w] > 0 for w in words)
                gain = sum(max(0.0, scorer.memo[w]) for w in words)
                out.append((toxic, len(words), max((s for _, _, s in found), default=0.0), hits, gain))
            yield pd.DataFrame(out, columns=["toxic", "n", "best", "hits", "gain"])

    # both collections are bounded by the sample: a few numbers for each of its rows
    seen = back.select("text", "_label").mapInPandas(best, "toxic int, n long, best double, hits long, gain double").toPandas()
    seen = seen.sort_values(["toxic", "n", "best", "hits"]).reset_index(drop=True)
    clean = seen[(seen["toxic"] == 0) & (seen["n"] > 0)]
    words, hits, gain = float(clean["n"].sum()), float(clean["hits"].sum()), float(clean["gain"].sum())
    # words of clean rows: a share of hits with their mean gain, all others at the rest score
    share = max(hits, 0.5) / max(words, 1.0)
    mean = gain / hits if hits else max(model.scores.values())
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        value = (1 - share) * math.exp(mid * model.rest) + share * math.exp(min(mid * mean, 700.0))
        low, high = (mid, high) if value < 1 else (low, mid)
    model.lam = (low + high) / 2
    with_hits = float((clean["best"] > 0).sum())
    model.k = max(with_hits, 0.5) / max(float((clean["n"] * np.exp(-model.lam * clean["best"])).sum()), 1.0)

    def joint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame([(toxic, scorer.score(text)[2]) for text, toxic in zip(batch["text"], batch["_label"])], columns=["toxic", "evidence"])

    fitted = back.select("text", "_label").mapInPandas(joint, "toxic int, evidence double").toPandas().sort_values(["toxic", "evidence"])
    x, y = np.log1p(fitted["evidence"].to_numpy(float)), fitted["toxic"].to_numpy(float)
    model.intercept, model.slope = _logistic(x, y)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic fit by damped Newton steps with a weak ridge."""
    a = b = 0.0
    ridge = 1e-2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(p - y).sum() + ridge * a, ((p - y) * x).sum() + ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def scoring_udf(model: ToxicModel):
    """Pandas UDF text -> struct(score, predicted, n_segments, evidence)."""

    @F.pandas_udf("score double, predicted int, n_segments long, evidence double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            rows = [scorer.score(t) for t in texts]
            yield pd.DataFrame({"score": [r[0] for r in rows], "predicted": np.array([r[0] >= 0.5 for r in rows], dtype=np.int32), "n_segments": np.array([r[1] for r in rows], dtype=np.int64), "evidence": [r[2] for r in rows]})

    return score


def passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row per significant toxic passage: doc_id, begin, end (code points), score, evidence."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame([(d, *p) for d, t in zip(batch["doc_id"], batch["text"]) for p in scorer.passages(t)], columns=["doc_id", "begin", "end", "score", "evidence"])

    return docs.select("doc_id", "text").mapInPandas(find, "doc_id long, begin long, end long, score double, evidence double")


def score_documents(docs: DataFrame, model: ToxicModel, column: str = "_toxicity") -> DataFrame:
    """``docs`` with all their columns and the struct of the score as the last one."""
    return docs.withColumn(fresh(docs, column), scoring_udf(model)(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "_toxicity.score", "_toxicity.predicted", "_toxicity.n_segments")
