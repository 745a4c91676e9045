"""Personal data by weak supervision: voting labelers, expectation-maximisation, span classifier.

Candidates are the matches of the four base patterns and of looser ones (telephone and
card numbers that the base rules lose in longer runs of digits or for want of a plus sign,
spelt-out e-mail addresses). Five labelers vote +1, -1 or 0 on each: base
rule with its checks, form, gazetteer, context words, neighbouring characters. Votes are counted
by pattern over the whole corpus (3^5 patterns a kind at most), expectation-maximisation
estimates each labeler's reliability and every pattern's posterior, and a logistic span classifier
is trained on the votes with those posteriors as soft labels. Base spans stay; a looser candidate
that overlaps none is added if its classifier probability reaches ``ADD``.

Only DataFrame and SQL functions touch the texts; the model is fitted on the bounded table of
vote patterns. Patterns use possessive quantifiers and look-behinds, so that scanning is linear
and the stack stays flat on long runs of digits or letters; they match as the base rules do.

Defined results: a null text is empty and has no spans; equal rows give equal rows; an empty
table gives an empty result; without any candidate the classifier adds nothing. Only doc_id
and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import store, table, text_column

KINDS = ("email", "ip", "card", "phone")
#: Least probability for a span that is no base span.
ADD = 0.5
ROUNDS = 50

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LOOSE_PHONE = r"(?<![0-9+(.-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"
_LOOSE_CARD = r"(?<![0-9])[0-9]{12,19}(?![0-9])"
#: Grouped cards of 12 to 19 digits at a group's start, the longest first.
_GROUPED = [rf"^[0-9]{{4}}([\x20-])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}\1?[0-9]{{{k}}}(?![0-9])" for k in (3, 2, 1)]
_GROUPED += [rf"^[0-9]{{4}}([\x20-])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{{k}}}(?![0-9])" for k in (4, 3, 2, 1)]
_GROUPED += [rf"^[0-9]{{4}}([\x20-])[0-9]{{6}}\1[0-9]{{{k}}}(?![0-9])" for k in (5, 4)] + [r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}(?![0-9])"]
_LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\])\x20?[A-Za-z]{2,12}"

# Top-level domains, card issuer prefixes, and context words of the gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "eu", "de", "fr", "es", "uk", "us", "it", "nl", "ch", "at", "be", "ca", "au", "jp", "cn", "in", "br", "mx", "ru", "pl", "se", "no", "fi", "dk")
ISSUERS = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|6011|64[4-9]|65|35)"
CONTEXT = {"email": "mail|contact|write|address|kontakt|correo|courriel", "ip": "\\bip\\b|host|server|address|from|client", "card": "card|visa|master|credit|carte|karte|tarjeta|pay", "phone": "tel|phone|call|fax|mobile|cell|anruf|appel|llam"}
AGAINST = "version|licen|token|password|secret|isbn|\\bkey\\b|\\bv\\.?$|=\\s*\"?$|\\bno\\.?\\s*$"
VOTES = 5


def _valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(s, r"\."), lambda x: F.when(F.length(part(x)) > 3, F.lit(False)).otherwise(part(x).try_cast("int") <= 255))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    # every second digit from the right is doubled, nines cast out
    at = F.sequence(F.lit(1), F.length(digits))
    one = lambda k: F.substring(digits, k, F.lit(1)).try_cast("int")
    double = lambda k: F.when((F.length(digits) - k) % 2 == 1, F.when(one(k) > 4, one(k) * 2 - 9).otherwise(one(k) * 2)).otherwise(one(k))
    luhn = F.aggregate(at, F.lit(0), lambda acc, k: acc + double(k)) % 10 == 0
    return F.when(~F.length(digits).between(12, 19), F.lit(False)).otherwise(luhn)


_FOUND = "array<struct<start:int,kind:int,end:int,s:string,base:boolean,ok:boolean>>"


def _matches(text: Column, pattern: str, kind: int, base: bool, gate: Column, keep=None) -> Column:
    """Matches of a pattern with their places in code points: the gaps between matches come
    from splitting the text at the same pattern. ``keep`` drops matches that can be no candidate."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    name = KINDS[kind]

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        ok = _valid(name, x["hit"]) if base else F.lit(True)
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("s"), F.lit(base).alias("base"), ok.alias("ok"))
        use = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"])
        return F.struct(end.alias("at"), F.when(use, F.concat(acc["out"], F.array(one).cast(_FOUND))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_FOUND)
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(gate, found).otherwise(none)


def _grouped_cards(runs: Column) -> Column:
    """Grouped cards inside the base card runs that fail their check: at every group's start the
    longest form that passes, so a run may hold any number of others before and after."""

    def inside(x: Column) -> Column:
        digit = lambda i: F.substring(x["s"], i, F.lit(1)).between("0", "9")
        starts = F.filter(F.sequence(F.lit(1), F.length(x["s"])), lambda i: digit(i) & ((i == 1) | ~digit(i - 1)))

        def at(i: Column) -> Column:
            piece = F.substring(x["s"], i, F.lit(24))
            forms = F.array(*(F.regexp_extract(piece, form, 0) for form in _GROUPED))
            hit = F.get(F.filter(forms, lambda s: (s != "") & _valid("card", s)), F.lit(0))
            start = x["start"] + i - 1
            return F.struct(start.alias("start"), F.lit(2).alias("kind"), (start + F.length(hit)).alias("end"), hit.alias("s"), F.lit(False).alias("base"), F.lit(True).alias("ok"))

        return F.filter(F.transform(starts, at), lambda c: c["s"].isNotNull())

    return F.flatten(F.transform(F.filter(runs, lambda x: ~x["ok"]), inside)).cast(_FOUND)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the array ``found`` of all candidates with their votes, for each row."""
    text = F.col("_text")
    digits = text.rlike(r"[0-9]\.[0-9]")
    # runs of fewer than 12 digits can be no card; they are the bulk of all numbers
    long_run = lambda s: F.length(F.regexp_replace(s, "[^0-9]", "")) >= 12
    cards = _matches(text, _CARD, 2, True, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), long_run)
    parts = [
        _matches(text, _EMAIL, 0, True, text.contains("@")),
        _matches(text, _IP, 1, True, digits),
        cards,
        _matches(text, _PHONE, 3, True, text.contains("+")),
        _matches(text, _LOOSE_PHONE, 3, False, text.rlike(r"[0-9]{3}[-.\x20][0-9]{4}")),
        _matches(text, _LOOSE_CARD, 2, False, text.rlike(r"[0-9]{12}"), lambda s: _valid("card", s)),
        _grouped_cards(cards),
        _matches(text, _LOOSE_EMAIL, 0, False, text.contains("(at)") | text.contains("[at]")),
    ]
    rows = docs.select("doc_id", text_column().alias("_text"))
    rows = rows.select("doc_id", "_text", F.concat(*parts).alias("_found"))

    def vote(x: Column) -> Column:
        kind, s = x["kind"], x["s"]
        digits = F.regexp_replace(s, "[^0-9]", "")
        before = F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))
        left, right = F.substring(before, -1, 1), F.substring(text, x["end"] + 1, F.lit(1))
        yes = lambda c: F.when(c, 1).otherwise(-1)
        rule = F.when(~x["base"], 0).otherwise(yes(x["ok"]))
        form = (
            F.when(kind == 0, yes(s.rlike(r"(?:\.|\bdot[\])]\x20?)[A-Za-z]{2,12}$")))
            .when(kind == 1, yes(~s.rlike(r"(?:^|\.)0[0-9]")))
            .when(kind == 2, yes(s.rlike(r"^[0-9]{13,16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$")))
            .otherwise(yes(s.rlike(r"\([0-9]{2,4}\)|^\+|^[0-9]{3}-[0-9]{3}-[0-9]{4}$")))
        )
        top = F.lower(F.regexp_extract(s, r"([A-Za-z]+)$", 1))
        area = F.substring(F.regexp_replace(digits, "^1(?=[0-9]{10}$)", ""), 1, 1)
        gazetteer = (
            F.when(kind == 0, yes(top.isin(*TOP_DOMAINS)))
            .when(kind == 1, F.when(s.rlike(r"^(?:0|10|127|192\.168|22[4-9]|2[3-5][0-9])\."), 0).otherwise(1))
            .when(kind == 2, yes(digits.rlike(ISSUERS)))
            .otherwise(F.when(F.length(digits).isin(10, 11), yes(area.between("2", "9"))).otherwise(0))
        )
        words = F.element_at(F.array(*(F.when(before.rlike(CONTEXT[k]), 1).otherwise(0) for k in KINDS)), kind + 1)
        context = F.when(before.rlike(AGAINST), -1).otherwise(words)
        beside = yes(~left.rlike(r"[\p{L}0-9_]") & ~right.rlike(r"[\p{L}0-9_]"))
        votes = F.array(*(v.cast("int") for v in (rule, form, gazetteer, context, beside)))
        return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), x["base"].alias("base"), x["ok"].alias("ok"), votes.alias("votes"))

    return rows.select("doc_id", F.transform("_found", vote).alias("found"))


@dataclass
class SpanModel:
    """Reliabilities by kind and labeler, and the classifier's weights."""

    prior: dict[int, float]
    reliability: dict[tuple[int, int], float]
    weights: list[float]  # one for each kind, then one for each labeler's vote
    usable: bool = True


def fit(patterns: list[tuple[int, tuple[int, ...], int]]) -> SpanModel:
    """From (kind, votes, count): reliability = chance that a vote is right, tied over classes."""
    prior = {k: 0.5 for k in range(len(KINDS))}
    good = {(k, j): 0.8 for k in range(len(KINDS)) for j in range(VOTES)}
    post: list[float] = []
    for _ in range(ROUNDS):
        post = []
        for kind, votes, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(v * math.log(good[kind, j] / (1 - good[kind, j])) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for k in range(len(KINDS)):
            own = [(v, n, p) for (kind, v, n), p in zip(patterns, post) if kind == k]
            total = sum(n for _, n, _ in own)
            # weak priors keep every estimate inside (0, 1), and labelers better than chance
            prior[k] = (sum(n * p for _, n, p in own) + 1) / (total + 2)
            for j in range(VOTES):
                right = sum(n * (p if v[j] > 0 else 1 - p) for v, n, p in own if v[j])
                cast = sum(n for v, n, _ in own if v[j])
                good[k, j] = max(0.55, (right + 8) / (cast + 10))
    weights = _logistic([([1.0 if kind == k else 0.0 for k in range(len(KINDS))] + [float(v) for v in votes], p, n) for (kind, votes, n), p in zip(patterns, post)])
    return SpanModel(prior, good, weights, bool(patterns))


def _logistic(rows: list[tuple[list[float], float, int]]) -> list[float]:
    """Soft-label logistic regression by gradient steps with a ridge; weights by square root of
    the count, so that rare patterns are heard."""
    size = len(KINDS) + VOTES
    w = [0.0] * size
    mass = sum(math.sqrt(n) for _, _, n in rows) or 1.0
    for _ in range(3000):
        g = [1e-3 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            d = math.sqrt(n) / mass * (p - y)
            for k, v in enumerate(x):
                if v:
                    g[k] += d * v
        w = [a - 1.0 * b for a, b in zip(w, g)]
        if max(map(abs, g)) < 1e-7:
            break
    return w


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the arrays ``base`` and ``spans`` of (start, kind, end) in order, for each row."""
    found, _ = store(candidates(docs), "pii-candidates")
    one = found.select(F.explode("found").alias("x"))
    counted = one.groupBy("x.kind", "x.votes").agg(F.count(F.lit(1)).alias("n"))  # 4 * 3^5 rows at most
    model = fit(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted.toLocalIterator()))
    kind_weight = F.array(*map(F.lit, model.weights[: len(KINDS)]))

    def score(x: Column) -> Column:
        votes = sum((F.lit(w) * x["votes"][j] for j, w in enumerate(model.weights[len(KINDS) :])), F.lit(0.0))
        return F.element_at(kind_weight, x["kind"] + 1) + votes

    least = math.log(ADD / (1 - ADD))
    short = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda x: x["base"] & x["ok"]), short))
    rows = found.withColumn("base", base)
    free = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    added = F.transform(F.filter("found", lambda x: ~x["base"] & (score(x) >= least) & free(x)), short)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _joined(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
