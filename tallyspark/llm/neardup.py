"""Near-duplicate detection by fast similarity sketching (operator 2).

A text's set is its distinct 5-word shingles.  The sketch has ``COORDINATES``
bins; in round i every shingle is thrown into one bin with a hash of its own,
and a bin keeps the least (round, value).  A later round cannot lower what an
earlier one filled, so the rounds stop once all bins are full; if bins are
still empty after as many rounds as there are bins, round ``t + j`` throws
everything into bin j.  So every coordinate fills, two coordinates agree with
the probability of the Jaccard similarity, and their mean is concentrated as
with independent hashes.

1. Documents with equal sets are one class, named by the smallest id.
2. Classes whose sketches agree in all rows of a band are candidates.  The
   leader of each bucket is verified against the members on full sets; the
   links found give components.
3. What the leaders left apart is done pair by pair: open texts (of buckets with
   several components) that are in different components.  A pair is tried if the
   texts share a shingle that fewer than ``RARE`` open texts have; or if they
   share a bucket, and the shingles of each that ``RARE`` or more open texts have
   would alone be enough for 0.75.  A pair that fits neither cannot reach it, so
   a large group of copies with many changes each is not paired out.  Pairs that
   the sketches rule out (two bits of every coordinate) are left out too.
4. The second round's links join the components of the first.

With 32 bands of 4 rows a pair at similarity 0.75 shares no band with
probability (1 - 0.75^4)^32 = 5e-6; the filter of step 3 adds 4e-7.
Nulls, empty texts and texts without words have an empty set and stand alone.
Rows that repeat a document id are rows of one document class each; extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import components, mapped
from tallyspark.llm.shared import frugal, written
from tallyspark.llm.words import U, mix, pieces, shingles

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Differing bits of 256 at which a pair is ruled out: 32 coordinates are expected to differ at 0.75, in a bit each
#: on average; 61 is five standard deviations above.
MOST_BITS = 61
#: A shingle of fewer open texts is rare: its texts are paired.
RARE = 64
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * U(0xA24BAED4963EE407))
_VALUE = U((1 << 55) - 1)


def sketch(members: np.ndarray) -> np.ndarray:
    """The ``COORDINATES`` least (round << 55 | value) of a set of 64-bit hashes."""
    out = np.full(COORDINATES, U(2**64 - 1), np.uint64)
    if not len(members):
        return out
    at, together = 0, max(1, 700 // len(members))
    while at < COORDINATES:
        rounds = np.arange(at, min(at + together, COORDINATES))
        h = mix(members[None, :] ^ _SEEDS[rounds][:, None])
        value = (rounds.astype(np.uint64) << U(55))[:, None] | (h & _VALUE)
        np.minimum.at(out, (h >> U(57)).astype(np.int64).ravel(), value.ravel())
        if (out != U(2**64 - 1)).all():
            return out
        at += together
    for j in range(COORDINATES):
        h = mix(members ^ _SEEDS[COORDINATES + j]) & _VALUE
        out[j] = min(out[j], (U(COORDINATES + j) << U(55)) | h.min())
    return out


def _bands(s: np.ndarray) -> np.ndarray:
    rows = mix(s).reshape(BANDS, ROWS)
    h = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        h = mix(h * U(3) + rows[:, j])
    return h.view(np.int64)


def _bits(s: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate as four 64-bit values."""
    two = (mix(s) & U(3)).astype(np.uint8)
    bits = np.stack([two & 1, two >> 1]).ravel()
    return np.packbits(bits).view(">i8").astype(np.int64)


_SKETCHED = "id long, n_shingles long, set_hash binary, bands array<long>, bits array<long>"


@frugal
def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, words in pieces(batch.column(1)):
            sets = shingles(words, words.hashes(lower=True))
            sketches = [sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, hi - lo),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                         pa.binary()),
                pa.array([None if s is None else _bands(s) for s in sketches], pa.list_(pa.int64())),
                pa.array([None if s is None else _bits(s) for s in sketches], pa.list_(pa.int64())),
            ], names=["id", "n_shingles", "set_hash", "bands", "bits"])


@frugal
def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those with 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for lo, hi, words in pieces(batch.column(2)):  # the sets of some pairs at a time
            left = shingles(words, words.hashes(lower=True))
            right = (s for _, _, w in pieces(batch.column(3).slice(lo, hi - lo)) for s in shingles(w, w.hashes(lower=True)))
            for x, y in zip(left, right, strict=True):
                common = 0
                if len(x) and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                keep.append(common > 0 and 100 * common >= 75 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


@frugal
def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in pieces(batch.column(1)):
            sets = shingles(words, words.hashes(lower=True))
            ids = batch.column(0).slice(lo, hi - lo).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(s) for s in sets])),
                                              pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "shingle"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        _verify_batches, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``: the size of its
    set and the smallest id that it reaches by links of similarity 0.75 or more."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketched = written(source.mapInArrow(_sketch_batches, _SKETCHED))
    classes = sketched.where("set_hash IS NOT NULL").groupBy("set_hash").agg(
        F.min("id").alias("rep"), F.min_by("n_shingles", "id").alias("n_shingles"),
        F.min_by("bands", "id").alias("bands"), F.min_by("bits", "id").alias("bits"))
    classes = written(classes.where("rep IS NOT NULL"))

    rows = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "value"))
    spread = F.xxhash64("rep", F.col("band") % 8)  # eight different choices of leaders
    leaders = rows.groupBy("band", "value").agg(F.min_by("rep", spread).alias("leader"), F.count("*").alias("size"),
                                                F.min_by("n_shingles", spread).alias("n_leader")).where("size > 1")
    near_size = F.col("n_leader") * 4 >= F.col("n_shingles") * 3, F.col("n_shingles") * 4 >= F.col("n_leader") * 3
    members = written(rows.join(leaders, ["band", "value"]).select("rep", "n_shingles", "band", "value", "leader", "n_leader"))
    pairs = members.where((F.col("rep") != F.col("leader")) & near_size[0] & near_size[1]).select(
        F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    texts = written(source.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
                    .dropDuplicates(["id"]))
    first = written(_verified(pairs, texts))
    labels = components(first)

    # what the leaders left apart: members of different components of one bucket
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "n_shingles", "band", "value", F.coalesce("component", "rep").alias("component"))
    shares = named.groupBy("band", "value", "component").agg(F.count("*").alias("size"))
    split = shares.groupBy("band", "value").agg(F.max_by("component", F.struct("size", "component")).alias("main"),
                                                F.count("*").alias("parts")).where("parts > 1")
    open_ = written(named.join(split, ["band", "value"]).join(classes.select("rep", "bits", "bands"), "rep").select(
        "rep", "n_shingles", "band", "value", "component", "main", "bands", *[F.col("bits")[i].alias(f"s{i}") for i in range(4)]))
    # how many open texts have each shingle
    one = open_.dropDuplicates(["rep"]).drop("band", "value", "main", "bands")
    rows = texts.join(one.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(_shingle_rows, "rep long, shingle long")
    rows = written(rows.join(rows.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1"), "shingle"))
    enough = rows.groupBy("rep").agg(F.count("*").alias("shared"), F.count_if(F.col("texts") >= RARE).alias("common"))
    open_ = written(open_.join(enough, "rep"))
    rare = rows.where(F.col("texts") < RARE).select("rep", "shingle").join(one.join(enough, "rep"), "rep")

    def alike(bound: str) -> Column:
        differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(4)), F.lit(0))
        return ((F.col("x.component") != F.col("y.component"))
                & (F.least(f"x.{bound}", f"y.{bound}") * 7 >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * 3)
                & (F.col("x.n_shingles") * 4 >= F.col("y.n_shingles") * 3)
                & (F.col("y.n_shingles") * 4 >= F.col("x.n_shingles") * 3) & (differ <= MOST_BITS))

    pair = F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")
    by_shingle = rare.alias("x").join(rare.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") < F.col("y.rep"))
                                      & alike("shared")).select(*pair)
    # of the buckets that two texts share, the first pairs them
    once = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.col("x.band") + 1
    by_bucket = open_.where("component <> main").alias("x").join(
        open_.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & alike("common") & once).select(*pair)
    rest = written(by_shingle.union(by_bucket).distinct().join(first, ["a", "b"], "left_anti"))
    second = _verified(rest, texts)
    # the second round's links join components of the first
    joined = components(mapped(second, labels))
    named_classes = classes.select("set_hash", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("node")).join(joined, "node", "left").select(
        "set_hash", F.coalesce("component", "node").alias("component"))
    return sketched.select("id", "n_shingles", "set_hash").join(named_classes, "set_hash", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
