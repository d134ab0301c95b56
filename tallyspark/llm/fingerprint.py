"""Document fingerprints by a threshold-scaled sketch (operator 4), in DataFrame operations only.

A text's shingles are its distinct runs of five words (of fewer words: all of
them as one).  A fingerprint keeps every shingle whose 64-bit hash is among the
lowest ``1 / SCALE`` of all values, sorted, in hexadecimal.  So it grows with the
text, two fingerprints of unequal size can be held against each other, and the
fingerprint of several documents together is the union of theirs.  A text with
words of which nothing is kept keeps its least hash; that too can be merged.

Likeness is containment: the share of the one fingerprint that the other has too,
an unbiased estimate of the share of the one text's shingles; 1 if both are
empty, 0 if one is.

A null text is an empty one, and a text without words has the empty fingerprint.
Rows that repeat an id follow each other in the order of their texts; a row
without an id comes first.  A single row is followed by itself.  Extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, SCALE = 5, 16
_BELOW = -(2**63) + 2**64 // SCALE
_RANGES = 64


def kept(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the sorted hashes that the fingerprint of ``text`` keeps."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    df = df.withColumn("_h", hashes)
    n = F.size("_h")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WORDS)]))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_s", F.when(n == 0, none).when(n < WORDS, F.array(F.xxhash64("_h"))).otherwise(runs))
    low = F.array_sort(F.array_distinct(F.filter("_s", lambda x: x < _BELOW)))
    df = df.withColumn("_k", low).withColumn(into, F.when((F.size("_k") == 0) & (n > 0), F.array(F.array_min("_s"))).otherwise(F.col("_k")))
    return df.drop("_h", "_s", "_k")


def printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def likeness(one: Column, other: Column) -> Column:
    """Share of ``one`` that stands in ``other``."""
    return F.when((F.size(one) == 0) | (F.size(other) == 0), (F.size(one) == F.size(other)).cast("double")).otherwise(
        F.size(F.array_intersect(one, other)) / F.size(one))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of each whole text."""
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return kept(plain, "text", "k").select("id", printed(F.col("k")).alias("fingerprint"))


def with_next(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` (id, text, ...) with ``next_<column>`` from the row with the next id, after the last from the first.

    Ids are dealt to ranges, and each range gets the first row of the range after it as its last."""
    ranges = max(_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # more for more data
    cuts = df.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    edges = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]).cast("array<bigint>")
    ranged = df.withColumn("range", F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.size(F.filter(edges, lambda e: e < F.col("id")))))
    order = [F.col("id").asc_nulls_first(), F.col("text").asc()]
    # the least id of each range, and of several rows with it the least text: as many rows as ranges
    heads = ranged.groupBy("range").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("least"))
    turn = Window.orderBy("range")
    heads = heads.select("least", F.coalesce(F.lag("range").over(turn), F.max("range").over(
        turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to_range"))
    first = ranged.withColumn("least", F.coalesce("id", F.lit(-(2**63)))).join(F.broadcast(heads), "least")
    first = first.withColumn("turn", F.row_number().over(Window.partitionBy("to_range", "least").orderBy(*order))).where("turn = 1")
    ranged = ranged.select(*df.columns, "range", F.lit(0).alias("extra")).union(
        first.select(*df.columns, F.col("to_range"), F.lit(1)))
    follow = Window.partitionBy("range").orderBy("extra", *order)
    return ranged.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns]).where("extra = 0").drop("extra", "range")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text (its second half replaced by
    the start of the next document) and that of the next document."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    df = with_next(kept(plain, "text", "kept"), "text", "kept").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.select("id", "n_chars", "kept", "next_kept", F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)).alias("edited"))
    df = kept(df, "edited", "edited_kept")
    return df.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("kept")).alias("fingerprint"),
        printed(F.col("edited_kept")).alias("edited_fingerprint"), likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"))
