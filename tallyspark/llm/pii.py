"""Personal data by candidate boosting (operator 10), in DataFrame operations only.

* *Base spans* are what fixed patterns and checks find: emails, IPv4 addresses,
  card numbers that pass Luhn's test, international phone numbers.
* *Candidates* come from broad generators that overlap freely: anything with a
  sign for "at" between names, dotted numbers, and any row of digits with
  separators.  Each is described by small whole numbers: its form (digits,
  separators, groups, Luhn, signs in it) and its context (the word before it,
  what touches it).
* *Boosted trees* of depth two tell candidates that coincide with a base span from
  the others.  Every candidate of every document counts: Spark counts equal
  descriptions by label, and the trees are grown from those counts, whose number
  is bounded by the product of the features' ranges, not by the documents.
* The *thresholds* are calibrated on documents kept out of the trees (crc32 of the
  id modulo 5 is 0), one for each generator and kind: scores are pooled until the
  share that coincides with base spans falls with the score (isotonic), and the
  threshold is the lowest score of the last pool that reaches ``PRECISION`` by
  itself, so that many sure candidates cannot carry a few poor ones.  Candidates at
  or above it that overlap no base span are added; base spans always stay.  A
  generator and kind without a held-out candidate adds nothing.

The trees become one SQL expression, so scoring is part of the row's projection.
Patterns are written so that they cannot back-track over long runs: quantifiers
are possessive, and a pattern that begins with a run starts only where the run does.

Null and empty texts have no spans; without any candidate nothing is added.
Rows that repeat an id are judged each for itself, extra columns are ignored (kept
by ``redacted``), and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

_NAMED = r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[a-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[a-z0-9-]++)++"
_DOTTED = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){2,}+"
_DIGITS = r"(?:(?<![0-9])|\G)[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
_WORDS_BEFORE = r"(?i)(?:mail|e-mail|contact|write|to|call|tel|phone|fax|mobile|cell|card|visa|iban|account|ip|host|server|from)[\x20:=.]{0,3}$"
PRECISION, ROUNDS, RATE = 0.95, 24, 0.3


def _found(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<start, end, t>> of a pattern's matches, in code points."""
    kind = "array<struct<start:int,end:int,t:string>>"
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda t, g: F.struct(t.alias("t"), F.char_length(g).alias("g")))
    out = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all")), lambda a, s: F.struct(
        (a["at"] + s["g"] + F.char_length(s["t"])).alias("at"),
        F.array_append(a["all"], F.struct((a["at"] + s["g"]).alias("start"), (a["at"] + s["g"] + F.char_length(s["t"])).alias("end"),
                                          s["t"].alias("t"))).cast(kind).alias("all")), lambda a: a["all"])
    return F.when(when, out).otherwise(F.array().cast(kind))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    d = F.reverse(F.split(digits, ""))
    value = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(
        F.when(x.try_cast("int") > 4, x.try_cast("int") * 2 - 9).otherwise(x.try_cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>>, kinds numbered as in ``KINDS``, sorted."""
    n = lambda t: F.length(_digits(t))
    some = text.rlike("[0-9]")
    by_kind = (
        _found(text, _EMAIL, F.contains(text, F.lit("@"))),
        F.filter(_found(text, _IP, some), lambda s: F.forall(F.split(s["t"], r"\."), lambda p: p.rlike(_OCTET))),
        F.filter(_found(text, _CARD, some), lambda s: n(s["t"]).between(14, 19) & _luhn(_digits(s["t"]))),
        F.filter(_found(text, _PHONE, F.contains(text, F.lit("+"))), lambda s: n(s["t"]).between(10, 15)))

    def of(kind: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    return F.array_sort(F.concat(*[F.transform(a, of(k)) for k, a in enumerate(by_kind)]))


def _features(text: Column, s: Column, generator: int) -> dict[str, Column]:
    """Small whole numbers that describe a candidate."""
    t = s["t"]
    before = F.substring(text, F.greatest(s["start"] - 11, F.lit(1)), F.least(s["start"], F.lit(12)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    groups = F.size(F.split(t, "[^0-9]+"))
    digits = _digits(t)
    return {
        "generator": F.lit(generator), "digits": F.least(F.length(digits), F.lit(20)), "groups": F.least(groups, F.lit(7)),
        "luhn": F.when(F.length(digits) >= 12, _luhn(digits).cast("int")).otherwise(0), "plus": t.startswith("+").cast("int"),
        "brackets": t.rlike(r"[()\[\]]").cast("int"), "blanks": t.rlike(r"\x20").cast("int"), "dots": F.least(F.size(F.split(t, r"\.")) - 1, F.lit(4)),
        "dashes": t.rlike("-").cast("int"), "at": F.contains(t, F.lit("@")).cast("int"), "octets": F.forall(F.split(t, r"\."), lambda p: p.rlike(_OCTET)).cast("int"),
        "word": before.rlike(_WORDS_BEFORE).cast("int"), "touches": F.when(before.rlike(r"[\p{L}0-9_=\"'/]$"), 1).otherwise(0)
        + F.when(after.rlike(r"[\p{L}0-9_\"'/@]"), 2).otherwise(0)}


FEATURES = ("generator", "digits", "groups", "luhn", "plus", "brackets", "blanks", "dots", "dashes", "at", "octets", "word", "touches")


def candidates(text: Column) -> Column:
    """array<struct<start, end, features...>> of all generators."""
    some = text.rlike("[0-9]")
    generators = ((_NAMED, F.contains(text, F.lit("@")) | F.lower(text).rlike(r"[\[(\x20]at[\])\x20]")), (_DOTTED, some), (_DIGITS, some))

    def of(generator: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                  *[c.cast("int").alias(k) for k, c in _features(text, s, generator).items()])

    return F.concat(*[F.transform(_found(text, pattern, when), of(g)) for g, (pattern, when) in enumerate(generators)])


def _kind(c: Column) -> Column:
    """The kind that a candidate's form is nearest to."""
    return F.when(c["generator"] == 0, 0).when((c["generator"] == 1) & (c["octets"] == 1), 1).when(c["digits"] > 13, 2).otherwise(3)


@dataclass(frozen=True)
class PiiModel:
    """Trees (feature, cut, two sides of (feature, cut, value below, value from it)) and thresholds on their sum:
    ((generator, kind), threshold) where there is one, ``threshold`` for all others."""

    bias: float
    trees: tuple
    threshold: float
    thresholds: tuple = ()

    def picks(self, c: Column) -> Column:
        least = F.lit(self.threshold)
        for (generator, kind), own in self.thresholds:
            least = F.when((c["generator"] == generator) & (_kind(c) == kind), F.lit(own)).otherwise(least)
        return self.score(c) >= least

    def score(self, c: Column) -> Column:
        out = F.lit(self.bias)
        for feature, cut, below, above in self.trees:
            side = lambda s: F.when(c[s[0]] < s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
            out = out + F.when(c[feature] < cut, side(below)).otherwise(side(above))
        return out


def _split(rows: list[tuple], grad: list[float], hess: list[float]) -> tuple[float, int, int, float, float]:
    """The best (gain, feature, cut, value below, value from it) over weighted rows."""
    total_g, total_h = sum(grad), sum(hess)
    leaf = lambda g, h: -RATE * g / (h + 1.0)
    best = (0.0, 0, 0, leaf(total_g, total_h), leaf(total_g, total_h))
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = {}
        for r, g, h in zip(rows, grad, hess, strict=True):
            s = sums.setdefault(r[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        g = h = 0.0
        values = sorted(sums)
        for v, w in zip(values, values[1:], strict=False):
            g, h = g + sums[v][0], h + sums[v][1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, w, leaf(g, h), leaf(total_g - g, total_h - h))
    return best


def _grow(counts: list[tuple[tuple, int, int]]) -> tuple[float, tuple, list[float]]:
    """Bias, trees and the score of each description, from (description, negatives, positives)."""
    rows = [r for r, _, _ in counts]
    bias = math.log((sum(p for _, _, p in counts) + 1) / (sum(n for _, n, _ in counts) + 1))
    scores, trees = [bias] * len(rows), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in scores]
        grad = [(neg + pos) * q - pos for (_, neg, pos), q in zip(counts, p, strict=True)]
        hess = [(neg + pos) * q * (1 - q) for (_, neg, pos), q in zip(counts, p, strict=True)]
        _, f, cut, _, _ = _split(rows, grad, hess)
        sides = []
        for below in (True, False):
            own = [i for i, r in enumerate(rows) if (r[f] < cut) == below]
            _, g, c, low, high = _split([rows[i] for i in own], [grad[i] for i in own], [hess[i] for i in own])
            sides.append((FEATURES[g], c, low, high))
            for i in own:
                scores[i] += low if rows[i][g] < c else high
        trees.append((FEATURES[f], cut, *sides))
    return bias, tuple(trees), scores


def _threshold(rows: list[tuple[float, int, int]]) -> float:
    """The lowest score of the last pool of held-out (score, misses, hits) with ``PRECISION``."""
    by_score: dict[float, list[int]] = {}
    for score, misses, hits in rows:
        both = by_score.setdefault(round(score, 9), [0, 0])
        both[0] += misses
        both[1] += hits
    pools: list[tuple[float, int, int]] = []  # from high scores to low, shares of hits falling
    for score in sorted((s for s, both in by_score.items() if sum(both)), reverse=True):
        misses, hits = by_score[score]
        while pools and pools[-1][2] * (hits + misses) <= hits * (pools[-1][1] + pools[-1][2]):
            _, n, p = pools.pop()
            misses, hits = misses + n, hits + p
        pools.append((score, misses, hits))
    return min((s - 1e-6 for s, n, p in pools if p >= PRECISION * (n + p)), default=math.inf)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> PiiModel:
    """Trees and thresholds from every candidate of every document."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select((F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(1)) % 5 == 0).alias("held"),
                       base_spans(plain).alias("base"), candidates(plain).alias("c")).where("size(c) > 0")
    rows = rows.select("held", F.explode("c").alias("c"), "base").select(
        "held", *[F.col("c")[f].alias(f) for f in FEATURES],
        F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start"))).alias("hit"))
    counts = rows.groupBy(*FEATURES).agg(*[F.count_if((F.col("held") == held) & (F.col("hit") == hit)).alias(f"{held}{hit}".lower())
                                           for held in (False, True) for hit in (False, True)]).collect()
    counts = sorted((tuple(r[: len(FEATURES)]), *r[len(FEATURES):]) for r in counts)
    if not counts:
        return PiiModel(0.0, (), math.inf)
    bias, trees, scores = _grow([(r, n, p) for r, n, p, _, _ in counts])
    by_kind: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for score, (r, _, _, n, p) in zip(scores, counts, strict=True):
        c = dict(zip(FEATURES, r, strict=True))
        kind = 0 if c["generator"] == 0 else 1 if c["generator"] == 1 and c["octets"] else 2 if c["digits"] > 13 else 3  # as _kind
        by_kind.setdefault((c["generator"], kind), []).append((score, n, p))
    least = {k: _threshold(rows) for k, rows in sorted(by_kind.items())}
    return PiiModel(bias, trees, math.inf, tuple((k, t) for k, t in least.items() if t < math.inf))


def _all_spans(text: Column, base: Column, model: PiiModel) -> Column:
    """Base spans and those that the model adds, sorted; an added one takes the kind its form is nearest to."""
    if model.threshold == math.inf and not model.thresholds:
        return base
    picked = F.filter(candidates(text), lambda c: model.picks(c)
                      & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    return F.array_sort(F.array_distinct(F.concat(base, F.transform(picked, lambda c: F.struct(
        c["start"].alias("start"), _kind(c).alias("kind"), c["end"].alias("end"))))))


def detected(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, kind, end)."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("base", base_spans(plain))
    return df.withColumn("spans", _all_spans(plain, F.col("base"), model))


def printed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    plain = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    own = plain[docs.columns.index(text)]
    found = detected(docs.toDF(*plain).withColumn("_text", F.col(own).cast("string")), model, "_text")
    whole = F.col("_text")
    out = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("all")), lambda a, s: F.when(
        s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["all"], F.array(
            F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).alias("all"))).otherwise(
        F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["all"].alias("all"))),
        lambda a: F.concat(F.array_join(a["all"], ""), F.substring(whole, a["at"] + 1, F.char_length(whole))))
    return found.withColumn(own, F.when(F.size("spans") > 0, out).otherwise(whole)).select(*plain).toDF(*docs.columns)
