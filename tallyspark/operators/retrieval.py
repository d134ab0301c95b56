"""Ranking document chunks and checking that answers stay within them.

A question is one string, so its terms and its vector are literals: corpora are
scanned, scored row by row and cut to the best k without any shuffle of text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.functions.numbers import ratio

CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_MIN = 1200, 200, 20
TOP_K, WHOLE_CORPUS_CHARS = 8, 300_000
K1, B = 1.5, 0.75
DIMENSIONS = 256
_UNITS_PER_BLOCK = 4096
SNIPPET = 220


# -------------------------------------------------------------- chunking ---

def _pieces(body: Column, size: int, overlap: int, least: int) -> Column:
    """Chunks of one text: whole paragraphs packed up to ``size`` characters with
    the tail of the last chunk carried over; a longer paragraph is cut by a sliding window."""
    trimmed = F.transform(F.split(body, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    paragraphs = F.filter(trimmed, lambda p: F.length(p) > 0)
    empty = F.array().cast("array<string>")
    hop = size - overlap

    def flushed(s: Column) -> Column:
        joined = F.regexp_replace(s["open"], r"^\s+|\s+$", "")
        return F.when(F.length(joined) >= least, F.concat(s["done"], F.array(joined))).otherwise(s["done"])

    def windows(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(p) - 1) / hop).cast("int"))
        return F.filter(F.transform(starts, lambda i: F.substring(p, i * hop + 1, F.lit(size))),
                        lambda w: F.length(w) >= least)

    def state(done: Column, held: Column, length: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("open"), length.cast("int").alias("length"))

    def step(s: Column, p: Column) -> Column:
        tail = F.when(F.lit(overlap) > 0, F.right(s["open"], F.lit(overlap))).otherwise(F.lit(""))
        full = (s["length"] + F.length(p) > size) & (s["open"] != "")
        carried = F.when(tail != "", F.concat(tail, F.lit("\n\n"), p)).otherwise(p)
        grown = F.when(s["open"] != "", F.concat(s["open"], F.lit("\n\n"), p)).otherwise(p)
        return (F.when(F.length(p) > size, state(F.concat(flushed(s), windows(p)), F.lit(""), F.lit(0)))
                .when(full, state(flushed(s), carried, F.length(tail) + F.length(p)))
                .otherwise(state(s["done"], grown, s["length"] + F.length(p))))

    return F.aggregate(paragraphs, state(empty, F.lit(""), F.lit(0)), step, flushed)


def chunk(units: DataFrame, dataset: str = "dataset_id", order: str = "unit", locator: str = "locator",
          body: str = "text", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_MIN
          ) -> DataFrame:
    """Chunks of every unit (page, file, turn), numbered densely within a document
    by the unit's number, a column of whole numbers.

    Positions need only the number of chunks of earlier units, so the text is
    never sorted by document: a document with most of the corpus does not meet
    in one task."""
    cut = units.withColumn("_pieces", _pieces(F.col(body), size, overlap, least))
    block = F.floor(F.col(order) / _UNITS_PER_BLOCK).alias("_block")
    counts = cut.groupBy(dataset, block, order).agg(F.sum(F.size("_pieces")).alias("held"))
    # running sums in two levels: over the blocks of a document, then within a block
    ahead = Window.unboundedPreceding, -1
    blocks = counts.groupBy(dataset, "_block").agg(F.sum("held").alias("held")).select(
        dataset, "_block", F.coalesce(F.sum("held").over(Window.partitionBy(dataset).orderBy("_block").rowsBetween(
            *ahead)), F.lit(0)).alias("base"))
    within = Window.partitionBy(dataset, "_block").orderBy(order).rowsBetween(*ahead)
    starts = counts.join(blocks, [dataset, "_block"]).select(
        dataset, order, (F.col("base") + F.coalesce(F.sum("held").over(within), F.lit(0))).alias("start"))
    placed = cut.join(starts, [dataset, order]).select(
        F.col(dataset).cast("string").alias("dataset_id"), F.col(locator).alias("locator"), "start",
        F.posexplode("_pieces").alias("piece", "text"))
    at = (F.col("start") + F.col("piece") + 1).cast("long")
    return placed.select(F.format_string("%s_c%05d", "dataset_id", at).alias("chunk_id"), "dataset_id",
                         at.alias("position"), "locator", "text")


def chunk_texts(units: DataFrame, key: str, body: str = "text", **sizes: int) -> DataFrame:
    """Chunks of one-unit documents: no numbering across units, so no shuffle."""
    args = {"size": CHUNK_CHARS, "overlap": CHUNK_OVERLAP, "least": CHUNK_MIN, **sizes}
    cut = units.select(F.col(key).cast("string").alias("dataset_id"),
                       F.posexplode(_pieces(F.col(body), **args)).alias("piece", "text"))
    at = (F.col("piece") + 1).cast("long")
    return cut.select(F.format_string("%s_c%05d", "dataset_id", at).alias("chunk_id"), "dataset_id",
                      at.alias("position"), "text")


def corpus_mode(chunks: DataFrame) -> DataFrame:
    """Total characters, and whether the whole corpus can be handed over."""
    row = chunks.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return row.withColumn("mode", F.when(F.col("chars") <= WHOLE_CORPUS_CHARS, "whole").otherwise("retrieve"))


# --------------------------------------------------------------- scoring ---

def terms(question: str) -> list[str]:
    return sorted(set(re.findall(text.TOKEN, question.lower())))


def _counted(chunks: DataFrame, question: str, *keep: str) -> tuple[DataFrame, Column]:
    """Each text's length and its counts of the question's terms, row by row, and the corpus'
    figures as one value: texts, mean length, texts with each term."""
    asked, body, edge = terms(question), F.lower("text"), text.TOKEN[:-1]
    pattern = f"(?<!{edge})(?:{'|'.join(asked)})(?!{edge})" if asked else "(?!)"
    # a generator of one row is where expressions end: nothing above repeats the patterns
    found = chunks.select(*keep, F.inline(F.array(F.struct(
        F.regexp_count(body, F.lit(text.TOKEN)).alias("length"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("found")))))
    rows = found.select(*keep, F.inline(F.array(F.struct("length", F.array(*[_times(t) for t in asked]).cast("array<int>").alias("tf")))))
    corpus = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.array(
        *[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(asked))]).cast("array<bigint>").alias("df")))
    return rows, corpus.scalar()


def _times(term: str) -> Column:
    return F.size(F.filter("found", lambda w: w == term))


def _bm25(tf: Column, length: Column, corpus: Column, k1: float, b: float) -> Column:
    """The score of a row: a sum over the terms, in their order."""
    long = k1 * (1 - b + b * length / corpus["mean"])

    def part(times: Column, df: Column) -> Column:
        idf = F.log(1 + (corpus["n"] - df + 0.5) / (df + 0.5))
        return F.when(times > 0, idf * times * (k1 + 1) / (times + long)).otherwise(0.0)

    return F.aggregate(F.zip_with(tf, corpus["df"], part), F.lit(0.0), lambda s, x: s + x)


def bm25(chunks: DataFrame, question: str, key: str = "chunk_id", k1: float = K1, b: float = B) -> DataFrame:
    """``score`` of the chunks that share a term with the question.

    Texts are scored where they lie: a first pass reduces them to the corpus'
    figures, a second scores each row.  Nothing is shuffled but those figures."""
    rows, corpus = _counted(chunks, question, key)
    scored = rows.where(F.exists("tf", lambda n: n > 0)).withColumn("_c", corpus)
    score = _bm25(F.col("tf"), F.col("length"), F.col("_c"), k1, b)
    return scored.select(key, F.inline(F.array(F.struct(score.alias("score"))))).where("score > 0")


def embed(chunks: DataFrame, key: str = "chunk_id", body: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``key``, ``embedding``, see ``_vectors``."""
    return chunks.select(key, _vectors(F.col(body), dimensions).alias("embedding"))


def _vectors(body: Column, dimensions: int) -> Column:
    """Hashed character trigrams of ``#word#``, of unit
    length (all zero for a text without letters or digits).  The md5 of a trigram
    gives its bucket (first four bytes, little-endian) and sign (parity of the fifth).

    A Pandas UDF: trigrams repeat, and remembering their hashes beats computing
    md5 for each of them in the JVM several times over.  Nothing is shuffled."""

    @F.pandas_udf("array<double>")
    def vectors(lines: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}

        def votes(word: str) -> list[int]:
            padded, codes = f"#{word}#", []
            for i in range(len(word)):
                gram = padded[i:i + 3]
                code = seen.get(gram)
                if code is None:
                    digest = md5(gram.encode(), usedforsecurity=False).digest()
                    code = seen[gram] = int.from_bytes(digest[:4], "little") % dimensions * 2 + (digest[4] & 1)
                codes.append(code)
            return codes

        def unit(line: str) -> np.ndarray:
            codes = np.array([c for word in line.split() for c in votes(word)], dtype=np.int64)
            v = np.bincount(codes >> 1, weights=1.0 - 2.0 * (codes & 1), minlength=dimensions)
            return v / (np.linalg.norm(v) or 1.0)

        return lines.map(unit)

    plain = F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    # marked non-deterministic so that filters and projections above do not repeat the call
    return vectors.asNondeterministic()(plain)


def missing_embeddings(chunks: DataFrame, embedded: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.join(embedded.select(key), key, "left_anti")


def embed_question(spark, question: str, dimensions: int = DIMENSIONS) -> list[float]:
    row = embed(spark.createDataFrame([("q", question)], "chunk_id string, text string"), dimensions=dimensions)
    return list(row.first()["embedding"])


def cosine(vectors: DataFrame, query: Sequence[float], key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Cosine similarity with one query vector; a zero norm counts as 1, and
    vectors of another size give no result."""
    q = F.array(*[F.lit(float(v)) for v in query])
    size = sum(float(v) ** 2 for v in query) ** 0.5 or 1.0
    same = vectors.where(F.size(vector) == len(query)).select(key, F.transform(
        vector, lambda v: v.cast("double")).alias("v"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return same.select(key, (dot(F.col("v"), q) / (F.when(norm == 0, F.lit(1.0)).otherwise(norm) * size)).alias("score"))


def normalized(scores: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Scores on 0..1; all 1 when they do not differ."""
    ends = scores.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    return scores.withColumn("e", ends).select(key, F.coalesce(ratio(
        F.col("score") - F.col("e")["lo"], F.col("e")["hi"] - F.col("e")["lo"]), F.lit(1.0)).alias("score"))


def top_k(scores: DataFrame, k: int = TOP_K, key: str = "chunk_id") -> DataFrame:
    return scores.orderBy(F.desc("score"), key).limit(k)


def hybrid(word_scores: DataFrame, vector_scores: DataFrame, k: int = TOP_K, key: str = "chunk_id") -> DataFrame:
    """Half words, half vectors, after bringing both to 0..1.

    The ends of both scales are taken from the joined scores: the subquery
    shares the join's shuffles, so that no text is scored twice."""
    both = word_scores.select(key, F.col("score").alias("w")).join(
        vector_scores.select(key, F.col("score").alias("v")), key, "full_outer")
    return _blended(both, k, key)


def _blended(both: DataFrame, k: int, key: str) -> DataFrame:
    """The best of (key, w, v), a missing score being 0 on the scale."""
    ends = both.agg(F.struct(*[f(c).alias(f"{c}_{n}") for c in "wv" for n, f in (("lo", F.min), ("hi", F.max))])).scalar()

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"e.{c}_lo"), F.col(f"e.{c}_hi")
        return F.when(F.col(c).isNull(), 0.0).otherwise(F.coalesce(ratio(F.col(c) - lo, hi - lo), F.lit(1.0)))

    scores = both.withColumn("e", ends).select(key, scaled("w").alias("word_score"), scaled("v").alias("vector_score"))
    return top_k(scores.withColumn("score", 0.5 * F.col("word_score") + 0.5 * F.col("vector_score")), k, key)


def hybrid_texts(chunks: DataFrame, question: str, k: int = TOP_K, key: str = "chunk_id") -> DataFrame:
    """``hybrid`` of texts that have no stored vectors: words and vectors are scored in one pass
    over the texts, and only keys and scores move, once for the ends of the scales and the ranking."""
    spark = chunks.sparkSession
    query = embed_question(spark, question)
    rows, _ = _counted(chunks.select(key, "text", _vectors(F.col("text"), DIMENSIONS).alias("_v")), question, key, "_v")
    norm = sum(v * v for v in query) ** 0.5 or 1.0
    dot = F.aggregate(F.zip_with("_v", F.array(*[F.lit(v) for v in query]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    _, figures = _counted(chunks, question, key)
    word = F.when(F.exists("tf", lambda n: n > 0), _bm25(F.col("tf"), F.col("length"), F.col("_c"), K1, B))
    scored = rows.withColumn("_c", figures).select(key, F.when(word > 0, word).alias("w"), (dot / norm).alias("v"))
    return _blended(scored.repartition(key), k, key)


def sourced(ranked: DataFrame, chunks: DataFrame, *columns: str, key: str = "chunk_id") -> DataFrame:
    """Ranked hits with columns of their chunk, such as title, locator and text; ``ranked`` is a top-k."""
    return chunks.select(key, *columns).join(F.broadcast(ranked), key)


# -------------------------------------------------------- offline answers ---

def _overlap(body: Column, wanted: Sequence[str], stop: bool) -> Column:
    has = text.stems(body) if stop else text.prefixes(body)
    return F.size(F.array_intersect(has, F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))


def _asked_stems(question: str, stop: bool) -> list[str]:
    found = re.findall(text.WORD, question.lower())
    return sorted({w[:5] for w in found if len(w) >= 3 and not (stop and w in text.STOP_WORDS)})


def preview(chunks: DataFrame, question: str, k: int = 2, key: str = "chunk_id") -> DataFrame:
    """The closest evidence to show when a question cannot be answered."""
    shared = _overlap(F.col("text"), _asked_stems(question, False), False)
    return chunks.select(key, shared.alias("overlap"), F.substring("text", 1, 150).alias("excerpt")).orderBy(
        F.desc("overlap"), key).limit(k)


def extractive_answer(chunks: DataFrame, question: str, k: int = 3, key: str = "chunk_id") -> DataFrame:
    """Up to three chunks quoted as the answer; no row means: abstain."""
    shared = _overlap(F.col("text"), _asked_stems(question, True), True)
    best = chunks.select(key, "text", shared.alias("overlap")).where("overlap > 0").orderBy(
        F.desc("overlap"), key).limit(k)
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    head = F.substring(body, 1, SNIPPET)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return best.select(key, "overlap", F.when(F.length(body) > SNIPPET, F.concat(cut, F.lit("..."))).otherwise(
        body).alias("snippet"))


# ----------------------------------------------------------------- gates ---

def citation_gate(claims: DataFrame, supplied: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Every claim (``claim_id``, ``text``, ``evidence``) with ``accepted``: it has
    text, cites at least one chunk, and cites none that was not supplied."""
    cited = claims.select("claim_id", F.explode("evidence").alias(key))
    known = supplied.select(key).distinct().withColumn("known", F.lit(1))
    per_claim = cited.join(known, key, "left").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("cited"), F.count("known").alias("known"))
    ok = (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.coalesce("cited", F.lit(0)) > 0) & (
        F.col("cited") == F.col("known"))
    return claims.join(per_claim, "claim_id", "left").select(
        "claim_id", "text", "evidence", F.coalesce(ok, F.lit(False)).alias("accepted"))


def number_gate(claims: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Every claim with the numerals that none of its own cited chunks contains."""
    said = claims.select("claim_id", "evidence", F.explode(F.array_distinct(text.numerals(F.col("text")))).alias("raw"))
    wanted = said.select("claim_id", "raw", text.canonical_number(F.col("raw")).alias("number"),
                         F.explode_outer(F.array_distinct("evidence")).alias(key))
    present = chunks.select(key, F.explode(F.array_distinct(text.numerals(F.col("text")))).alias("n")).select(
        key, text.canonical_number(F.col("n")).alias("number")).distinct().withColumn("hit", F.lit(1))
    # joined on chunk and number: a chunk cited by many claims does not multiply its numerals with them
    checked = wanted.join(present, [key, "number"], "left").groupBy("claim_id", "raw").agg(F.count("hit").alias("hits"))
    bad = checked.where("hits = 0").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("raw")).alias("unsupported"))
    return claims.join(bad, "claim_id", "left").select(
        "claim_id", F.coalesce("n", F.lit(0)).alias("unsupported_count"), F.col("n").isNull().alias("passed"),
        F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported"))


def unverified_numbers(narrative: DataFrame, facts: DataFrame) -> DataFrame:
    """Numerals of a narrative (``text``) that no fact (``fact``) contains."""
    said = narrative.select(F.explode(text.numerals(F.col("text"))).alias("raw")).distinct().withColumn(
        "number", text.canonical_number(F.col("raw")))
    known = facts.select(F.explode(text.numerals(F.col("fact"))).alias("raw")).select(
        text.canonical_number(F.col("raw")).alias("number")).distinct()
    return said.join(known, "number", "left_anti").select("raw")
