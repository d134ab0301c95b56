"""Target-distribution importance resampling (operator 11).

Features are hashed runs of one to three words.  The words come from the
tokenizers library: an untrained ``Split`` on a regular expression over text
whose A to Z are lower-cased returns words with offsets, and a window of
consecutive offset pairs is a feature.  Its CRC-32 is put together from those
of its words: appending n bytes is a linear map of the first CRC's bits, kept
as four tables of 256 entries per n.

1. Every document's buckets are written once, three 16-bit numbers a word.
2. Both tables' buckets are counted: a task sends at most ``buckets`` rows.
3. The gain of every bucket goes back to the tasks (``buckets`` numbers, a
   parameter, whatever the input), and a document's weight is their sum.
4. Gumbel noise from a hash of the id makes the highest scores a draw without
   replacement.  Ranks come from a range partitioning of narrow rows: rows
   before the partition plus the place within it.

Null and empty texts have no features and weight 0, and are never drawn, having
under ``least`` words; a null id hashes like an empty one and loses ties.
Repeated rows are ranked one by one.  Extra columns are ignored; an empty table
gives an empty result, an empty target gives gains by its smoothing alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import written
from tallyspark.llm.words import PIECE, buffers

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, PERCENT, LEAST, SEED = 10_000, 3, 5, 20, 42
#: Bytes of a word whose CRC is taken side by side with the others'; longer words are taken one by one.
_SIDE = 48
_NO = 0xFFFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c.astype(np.uint32)


_TABLE = _crc_table()


def _linear(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The map of ``tables`` (4 x 256) applied to CRCs."""
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@lru_cache(maxsize=4096)
def shift(n: int) -> np.ndarray:
    """Tables of what appending n bytes does to the CRC of what stands before them."""
    if n == 0:
        return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if n == 1:
        low = np.arange(256, dtype=np.uint32)
        return np.stack([_TABLE, low, low << np.uint32(8), low << np.uint32(16)])
    half = shift(n // 2)
    out = _linear(half, half.ravel()).reshape(4, 256)
    return _linear(shift(1), out.ravel()).reshape(4, 256) if n % 2 else out


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts made of two parts, from the parts' CRCs and the second's length."""
    lengths, which = np.unique(length, return_inverse=True)
    tables = np.stack([shift(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
    moved = np.zeros(len(first), np.uint32)
    for k in range(4):
        moved ^= tables[which, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return moved ^ second


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for each pair of offsets."""
    length = end - start
    order = np.argsort(-np.minimum(length, _SIDE + 1), kind="stable")
    begin, size = start[order], length[order]
    n_long = int((size > _SIDE).sum())
    begin, size = begin[n_long:], size[n_long:]
    crc = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -j, "left"))
        c = crc[:m]
        crc[:m] = _TABLE[(c ^ data[begin[:m] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order[n_long:]] = ~crc
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]])
    return out


def word_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the words of lower-cased UTF-8 texts, and how many words each text has.

    Texts are handed to the library in parts of about ``PIECE`` bytes that end beside a byte no word has."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
    starts, ends, counts = [], [], np.zeros(len(offsets) - 1, np.int64)
    for k, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
        while a < b:
            to = b
            if b - a > PIECE:
                free = np.flatnonzero(~_WORD_BYTE[data[a + PIECE:b]])
                to = a + PIECE + int(free[0]) + 1 if len(free) else b
            part = data[a:to]
            found = split.pre_tokenize_str(part.tobytes().decode("utf-8", "replace"))
            pairs = np.fromiter(itertools.chain.from_iterable([at for _, at in found]), np.int64, 2 * len(found))
            if pairs.size:
                lead = np.flatnonzero((part & 0xC0) != 0x80)
                if len(lead) < len(part):  # characters of several bytes: offsets become those of bytes
                    pairs = np.append(lead, len(part))[pairs]
                starts.append(pairs[0::2] + a)
                ends.append(pairs[1::2] + a)
                counts[k] += len(found)
            a = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    return np.concatenate(starts), np.concatenate(ends), counts


def window_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3) buckets of the windows of 1, 2 and 3 words that start at a word, ``_NO``
    where the text ends before; and the number of words of each text."""
    start, end, counts = word_offsets(data, offsets)
    n = len(start)
    out = np.full((n, LONGEST), _NO, np.uint16)
    doc = np.repeat(np.arange(len(counts)), counts)
    word, size = crcs(data, start, end), end - start
    crc = word
    for k in range(LONGEST):
        if k:  # one more word after a space
            crc = crc[:-1] if len(crc) else crc
            space = _TABLE[(crc ^ np.uint32(0xFFFFFFFF) ^ np.uint32(32)) & np.uint32(255)] ^ (
                (crc ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
            crc = joined(space, word[k:], size[k:])
        inside = doc[k:] == doc[:n - k] if n > k else np.zeros(len(crc), bool)
        out[:len(crc), k][inside] = (crc % np.uint32(buckets)).astype(np.uint16)[inside]
    return out, counts


def _bucketed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            lo, n = 0, batch.num_rows
            while lo < n:
                hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1))
                out, counts = window_buckets(_LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo], buckets)
                at = np.concatenate(([0], np.cumsum(counts))) * out.itemsize * LONGEST
                held = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), held.cast(pa.binary())],
                                                 names=["id", "n_words", "buckets"])
                lo = hi

    return run


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    some = np.frombuffer(data, np.uint16) if data is not None and data.size else np.zeros(0, np.uint16)
    return some, offsets // 2


def _counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_NO + 1, np.int64)
        for batch in batches:
            some, offsets = _features(batch.column(0))
            held += np.bincount(some[offsets[0]:offsets[-1]], minlength=_NO + 1)
        used = np.flatnonzero(held[:buckets])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(held[used])], names=["bucket", "held"])

    return run


def _weighed(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.zeros(_NO + 1, np.int64)
        of[:len(gains)] = gains
        seq = TaskContext.get().partitionId() << 33
        for batch in batches:
            some, offsets = _features(batch.column(2))
            first, some = offsets - offsets[0], some[offsets[0]:offsets[-1]]
            sums = np.concatenate(([0], np.cumsum(of[some])))
            real = np.concatenate(([0], np.cumsum(some != _NO)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(real[first[1:]] - real[first[:-1]]), pa.array(sums[first[1:]] - sums[first[:-1]]),
                pa.array(np.arange(seq, seq + batch.num_rows))], names=["id", "n_words", "n_features", "weight", "seq"])
            seq += batch.num_rows

    return run


def histogram(bucketed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, held) over all texts; every task counts its own first."""
    return bucketed.select("buckets").mapInArrow(_counted(buckets), "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket from both histograms; ``buckets`` numbers come to the driver."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("held", "s"), "bucket", "left").join(
        target.withColumnRenamed("held", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = {r["bucket"]: (r["s"], r["t"]) for r in both.collect()}  # one row per bucket
    total_s, total_t = (sum(r[k] for r in rows.values()) for k in (0, 1))
    one = np.array([rows[b] for b in range(buckets)], np.float64)
    return np.floor(1000 * np.log((one[:, 1] + 1) * (total_s + buckets) / ((one[:, 0] + 1) * (total_t + buckets)))).astype(np.int64).tolist()


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) by ``order`` (SQL, down to a unique column).

    Rows are dealt to ranges of the order and written; a rank is the rows of the ranges
    before plus the place within the range, so no task sees more than its range."""
    spark, by = rows.sparkSession, [F.expr(o.split()[0]).desc_nulls_last() if o.endswith(" desc") else F.expr(o).asc_nulls_last() for o in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()))
    before = dealt.groupBy("range").agg(F.count("*").alias("held")).select(  # one row per range
        "range", (F.sum("held").over(Window.orderBy("range")) - F.col("held")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    return dealt.withColumn("place", place).join(F.broadcast(before), "range").withColumn("rank", F.col("place") + F.col("before")).drop(
        "range", "place", "before")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT,
              least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document: the draw of ``percent``
    of the documents with ``least`` words that are likeliest under ``target``; others have no rank."""
    if not 0 < buckets < _NO:
        raise ValueError(f"buckets must be under {_NO}")

    def of(df: DataFrame, id_: str | None) -> DataFrame:
        source = df.select((F.col(id_).cast("long") if id_ else F.lit(None).cast("long")).alias("id"), F.col(text).cast("string").alias("text"))
        return source.mapInArrow(_bucketed(buckets), "id long, n_words long, buckets binary")

    mine = written(of(docs, key))
    gain = np.array(gains(histogram(mine, buckets), histogram(of(target, None), buckets), buckets), np.int64)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")

    def scored(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_weighed(gain), "id long, n_words long, n_features long, weight long, seq long").withColumn(
            "score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296))))

    able = F.col("n_words") >= least
    n_drawn = mine.where(able).agg(F.expr(f"count(*) * {int(percent)} div 100")).scalar()
    placed = ranked(scored(mine.where(able)), "score desc", "id", "seq").withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank").cast("long")))
    others = scored(mine.where(~able)).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).drop("seq")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **how: object) -> DataFrame:
    """The rows of ``docs`` whose id was drawn; rows that share an id are drawn together."""
    ids = resampled(docs, target, key, **how).where("rank IS NOT NULL").select(F.col("id").alias("_drawn")).distinct()
    return docs.join(ids, docs[key].cast("long").eqNullSafe(ids["_drawn"]), "left_semi")
