"""Phrase collocation mining with counting quotient filters (operator 13).

Texts (A to Z lower-cased) are split at ``.,;:!?`` and line breaks into pieces and
those at spaces and tabs into words; counts are per language.

1. Chunks of text are split once and kept as numbers of their own words.  The words'
   counts are added up in Spark; those that occur ``least`` times are numbered
   (no phrase that often has a rarer word), and the chunks' numbers replaced by joins.
2. Per length, every task packs runs of word numbers into 64 or 128 bits and permutes
   them invertibly.  A counting quotient filter holds the sorted results: the first
   16 bits (the quotient) by how many entries each value has, the other bits (the full
   remainder) and a counter each, so nothing is lost.  Filters are cut into shards by
   quotient, and a shard's filters are merged where they meet; inverting the
   permutation gives the phrases back.
3. A run of n words counts only if both its runs of n - 1 words are frequent.  Tasks
   ask a bitmap of those, at most ``BITS`` bits: one set too often lets through
   a run that the exact count then drops.
4. Cuts, containment and ranks are joins and aggregates over the frequent phrases.

Null and empty texts have no words; a null language is ``und``.  Repeated rows count
each time, extra columns are ignored, and an empty table gives an empty result.
More than 2**32 - 1 different frequent words are refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import frugal, written
from tallyspark.llm.words import U, buffers, mix

LEAST, WORDS, TOP, WITHIN = 30, 4, 2000, 80
#: Bytes of text in a chunk (a longer text is one by itself), entries a task holds before it sends its filter on.
CHUNK, HELD = 1 << 19, 1 << 21
#: Entries of filters merged at a time, bytes of filters sent on at a time.
SLICE, SENT = 1 << 16, 1 << 20
#: Rows of chunks are large: Parquet's pages, which are compressed whole, end by size after any row, not after 100 rows.
_PAGES = {"parquet.page.size.row.check.min": "1"}
#: Most bits of the bitmap of frequent runs that tasks are given: 16 MiB.
BITS = 1 << 27
_QUOTIENT = 16
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_G = ["g1", "g2", "g3", "g4"]


# ------------------------------------------------------------- words ---

def split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased texts, and for each the number of its piece (rising, different for each text)."""
    kind = _KIND[data]
    word = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | edge[1:])) + 1 if len(data) else start
    piece = np.cumsum(kind == 2)[start] + np.searchsorted(offsets, start, "right") if len(start) else start
    at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[word].tobytes())])
    return words, piece


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            data, offsets = buffers(batch.column(1).filter(pc.equal(langs, lang)))
            lo, n = 0, len(offsets) - 1
            while lo < n:
                hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1))
                words, piece = split(_LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo])
                lo = hi
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                ids = coded.indices.to_numpy()
                stream = np.full(len(ids) + int(np.count_nonzero(np.diff(piece))), -1, np.int32)  # -1 between pieces
                stream[np.arange(len(ids)) + np.concatenate(([0], np.cumsum(np.diff(piece) != 0)))] = ids
                held = np.bincount(ids, minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([
                    pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([lang]), pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.large_string()).cast(pa.string())),
                    pa.array([held], pa.list_(pa.int64())), pa.array([stream.tobytes()], pa.binary())],
                    names=["chunk", "lang", "n", "words", "counts", "ids"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' streams in numbers of frequent words; 0 for rare ones and between pieces."""
    for batch in batches:
        for ids, known in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int32)
            of = np.zeros(int(ids.max()) + 2, np.uint32)
            if known.is_valid:
                pairs = known.values.to_numpy()
                of[pairs >> 32] = pairs & 0xFFFFFFFF
            stream = of[ids]  # -1 takes the last, which is 0
            keep = (stream != 0) | np.concatenate((stream[1:] != 0, [False]))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array([stream[keep].tobytes()], pa.binary())], names=["ids"])


def numbered(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` with ``word_id`` from 1 without gaps: rows of the files before plus the place in the file."""
    placed = written(vocabulary.withColumn("_seq", F.monotonically_increasing_id()))
    part = F.shiftright("_seq", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("held"))  # one row per task
    before = sizes.select("_part", (F.sum("held").over(Window.orderBy("_part")) - F.col("held")).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        "word_id", F.col("_before") + F.col("_seq") - F.shiftleft("_part", 33) + 1)
    return out.drop("_seq", "_part", "_before")


# ----------------------------------------------------------- filters ---

def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> U(31)) ^ (x >> U(62))
    x = x * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U(27)) ^ (x >> U(54))
    x = x * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


def permuted(keys: np.ndarray) -> np.ndarray:
    """A bijection of rows of one or two 64-bit values."""
    if keys.shape[1] == 1:
        return mix(keys)
    a, b = keys[:, 0], keys[:, 1]
    a = a ^ mix(b + U(1))
    b = b ^ mix(a + U(2))
    return np.stack([a ^ mix(b + U(3)), b], axis=1)


def restored(keys: np.ndarray) -> np.ndarray:
    """The inverse of ``permuted``."""
    if keys.shape[1] == 1:
        return _unmix(keys)
    a, b = keys[:, 0], keys[:, 1]
    a = a ^ mix(b + U(3))
    b = b ^ mix(a + U(2))
    return np.stack([a ^ mix(b + U(1)), b], axis=1)


class Filter:
    """Sorted permuted keys with their counters."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        """Equal keys become one; ``keys`` are permuted already."""
        order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
        keys, counts = keys[order], counts[order]
        if not len(keys):
            return cls(keys, counts)
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        return cls(keys[first], np.add.reduceat(counts, first))

    @classmethod
    def slices(cls, filters: list[Filter], bits: int = _QUOTIENT) -> Iterator[Filter]:
        """``filters`` merged, rising, about ``SLICE`` entries at a time; what shares its first ``bits`` bits stays together."""
        cut = min(bits, (sum(map(len, filters)) // SLICE).bit_length())
        heads = np.arange(1, 1 << cut, dtype=np.uint64) << U(64 - cut) if cut else np.zeros(0, np.uint64)
        edges = [[0, *np.searchsorted(f.keys[:, 0], heads).tolist(), len(f)] for f in filters]
        for k in range(1 << cut):
            yield cls.of(np.concatenate([f.keys[e[k]:e[k + 1]] for f, e in zip(filters, edges, strict=True)]),
                         np.concatenate([f.counts[e[k]:e[k + 1]] for f, e in zip(filters, edges, strict=True)]))

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        if len(filters) == 1:
            return filters[0]
        total, n = sum(map(len, filters)), 0
        keys, counts = np.empty((total, filters[0].keys.shape[1]), np.uint64), np.empty(total, np.int64)
        for f in cls.slices(filters):
            keys[n:n + len(f)], counts[n:n + len(f)] = f.keys, f.counts
            n += len(f)
        keys.resize((n, keys.shape[1]), refcheck=False)
        counts.resize(n, refcheck=False)
        return cls(keys, counts)

    def __len__(self) -> int:
        return len(self.keys)

    def shards(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(shard, encoded part) for each shard of the first ``bits`` bits that has entries."""
        of = self.keys[:, 0] >> U(64 - bits)
        edges = [*np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist(), len(self)] if len(self) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(of[a]), Filter(self.keys[a:b], self.counts[a:b]).encoded(int(of[a]), bits)

    def encoded(self, shard: int, bits: int) -> bytes:
        """Entries per quotient of the shard, counters (255 and more apart), remainders."""
        span = 1 << (_QUOTIENT - bits)
        quotient = (self.keys[:, 0] >> U(64 - _QUOTIENT)).astype(np.int64) - shard * span
        held = np.bincount(quotient, minlength=span).astype(np.uint32)
        big = self.counts >= 255
        small = np.where(big, 255, self.counts).astype(np.uint8)
        rest = np.ascontiguousarray(self.keys.astype(">u8")).view(np.uint8).reshape(len(self), -1)[:, _QUOTIENT // 8:]
        return b"".join([held.tobytes(), small.tobytes(), self.counts[big].astype(np.int64).tobytes(), rest.tobytes()])

    @classmethod
    def decoded(cls, data: bytes, shard: int, bits: int, width: int) -> Filter:
        span = 1 << (_QUOTIENT - bits)
        held = np.frombuffer(data, np.uint32, span)
        n, at = int(held.sum()), 4 * span
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        big = np.flatnonzero(counts == 255)
        counts[big] = np.frombuffer(data[at + n:at + n + 8 * len(big)], np.int64)
        whole = np.empty((n, 8 * width), np.uint8)
        quotient = (np.repeat(np.arange(span), held) + shard * span).astype(">u2")
        whole[:, :2] = quotient.view(np.uint8).reshape(n, 2)
        whole[:, 2:] = np.frombuffer(data, np.uint8, offset=at + n + 8 * len(big)).reshape(n, -1)
        return cls(whole.view(">u8").astype(np.uint64).reshape(n, width), counts)


def packed(stream: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Rows of one (two words) or two 64-bit values from the runs of n word numbers at ``at``."""
    part = [stream[at + j].astype(np.uint64) for j in range(n)]
    if n == 2:
        return ((part[0] << U(32)) | part[1])[:, None]
    if n == 3:
        return np.stack([part[0], (part[1] << U(32)) | part[2]], axis=1)
    return np.stack([(part[0] << U(32)) | part[1], (part[2] << U(32)) | part[3]], axis=1)


def unpacked(keys: np.ndarray, n: int) -> list[np.ndarray]:
    flat = [half for k in range(keys.shape[1]) for half in (keys[:, k] >> U(32), keys[:, k] & U(0xFFFFFFFF))]
    return [x.astype(np.int64) for x in (flat[1:] if n == 3 else flat)]


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a bitmap of ``bits`` bits that stands for a run."""
    return (permuted(keys)[:, 0] >> U(32)) & U(bits - 1)


def _filters(n: int, shard_bits: int, known: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Filters of the runs of n words of a task's chunks, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if known is None else known.value
        waiting: list[Filter] = []

        def sent() -> Iterator[pa.RecordBatch]:
            parts, size = [], 0

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())],
                                                  names=["shard", "filter"])

            for f in Filter.slices(waiting, shard_bits):
                for part in f.shards(shard_bits):
                    parts.append(part)
                    size += len(part[1])
                    if size >= SENT:
                        yield batch()
                        parts, size = [], 0
            if parts:
                yield batch()
            waiting.clear()

        for batch in batches:
            for ids in batch.column(0):
                stream = np.frombuffer(ids.as_buffer(), np.uint32)
                real, m = stream != 0, len(stream) - n + 1
                if m <= 0:
                    continue
                inside = real[:m].copy()
                for j in range(1, n):
                    inside &= real[j:j + m]
                at = np.flatnonzero(inside)
                if bitmap is not None and len(at):
                    ok = []
                    for shifted in (at, at + 1):
                        slot = _slot(packed(stream, n - 1, shifted), 8 * len(bitmap))
                        ok.append(bitmap[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8) & 1)
                    at = at[(ok[0] & ok[1]).astype(bool)]
                if len(at):
                    waiting.append(Filter.of(permuted(packed(stream, n, at)), np.ones(len(at), np.int64)))
                    if sum(map(len, waiting)) > HELD:
                        waiting[:] = [Filter.merged(waiting)]
                        if len(waiting[0]) > HELD // 2:
                            yield from sent()
        if waiting:
            yield from sent()

    return run


def _merge(n: int, shard_bits: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Filters sorted by shard, merged; the runs that reach ``least``."""
    width = 1 if n == 2 else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if waiting:
                whole = Filter.merged(waiting)
                often = whole.counts >= least
                ids = unpacked(restored(whole.keys[often]), n)
                ids += [np.zeros(int(often.sum()), np.int64)] * (4 - n)
                yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(whole.counts[often])], names=[*_G, "f"])

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != at:
                    yield from done()
                    at, waiting = shard, []
                waiting.append(Filter.decoded(data.as_buffer().to_pybytes(), shard, shard_bits, width))
                if len(waiting) > 64:
                    waiting = [Filter.merged(waiting)]
        yield from done()

    return run


def _bits(n: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy() for k in range(n)], axis=1).astype(np.uint32)
            slot = _slot(packed(ids.ravel(), n, np.arange(len(ids)) * n), bits)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> U(6)).astype(np.int64)),
                                              pa.array((U(1) << (slot & U(63))).view(np.int64))], names=["word", "bits"])

    return run


def _bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the runs: 16 bits a run, from 2**16 up to ``BITS`` bits in all."""
    bits = min(BITS, max(1 << 16, 1 << (16 * frequent.count() - 1).bit_length()))
    words = frequent.select(*_G[:n]).mapInArrow(frugal(_bits(n, bits)), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()  # at most BITS / 64 rows
    return out.view(np.uint8)


# ----------------------------------------------------------- phrases ---

def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, sizes): ``phrases`` of 1 to ``longest`` (at most 4) words with f >= ``least``
    as word numbers g1 to g4 (0 where there is none), ``n`` and ``f``; ``vocabulary`` (lang,
    word, f, word_id); ``sizes`` (lang, n), all occurrences of words."""
    if not 1 <= longest <= 4:
        raise ValueError("phrases have 1 to 4 words")
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    chunks = written(source.mapInArrow(frugal(_chunks), "chunk binary, lang string, n long, words array<string>, counts array<long>, ids binary"), _PAGES)
    often = chunks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("held")))).toDF(
        "lang", "word", "held").groupBy("lang", "word").agg(F.sum("held").alias("f")).where(F.col("f") >= least)
    vocabulary = written(numbered(often))
    if vocabulary.count() >= 1 << 32:
        raise ValueError("more than 2**32 - 1 frequent words")
    of = chunks.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).join(vocabulary.drop("f"), ["lang", "word"]).groupBy("chunk").agg(
        F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("word_id"))).alias("known"))  # as many as a chunk has words
    streams = written(chunks.select("chunk", "ids").join(of, "chunk").select("ids", "known").mapInArrow(frugal(_numbered), "ids binary"), _PAGES)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard_bits = min(_QUOTIENT, max(1, (8 * parts - 1).bit_length()))
    phrases = [vocabulary.select(F.col("word_id").alias("g1"), *[F.lit(0).cast("long").alias(g) for g in _G[1:]], "f", F.lit(1).alias("n"))]
    known = None
    for n in range(2, longest + 1):
        filters = streams.mapInArrow(frugal(_filters(n, shard_bits, known)), "shard int, filter binary")
        merged = filters.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(
            frugal(_merge(n, shard_bits, least)), ", ".join(f"{g} long" for g in [*_G, "f"]))
        found = written(merged)
        phrases.append(found.withColumn("n", F.lit(n)))
        if n < longest:
            known = spark.sparkContext.broadcast(_bitmap(found, n))
    out = phrases[0]
    for p in phrases[1:]:
        out = out.unionByName(p)
    return out, vocabulary, chunks.groupBy("lang").agg(F.sum("n").alias("n"))


def _run(first: Column, size: Column) -> list[Column]:
    """``size`` word numbers from position ``first`` (1 on) as g1 to g4."""
    ids = F.slice(F.array(*_G), first, size)
    return [F.coalesce(F.get(ids, F.lit(j)), F.lit(0).cast("long")).alias(f"p{j + 1}") for j in range(4)]


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS, top: int = TOP,
                 within: int = WITHIN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the ``top`` phrases of 2 to ``longest`` words by
    their weakest cut, without those that a longer phrase mostly holds (``within`` percent of f)."""
    phrases, vocabulary, sizes = frequent_phrases(docs, text, lang, least, longest)
    phrases = written(phrases)
    longer = phrases.where("n > 1")
    mine, same = [F.col(g) for g in _G], ["p1", "p2", "p3", "p4"]
    known = phrases.select(*[F.col(g).alias(p) for g, p in zip(_G, same, strict=True)], F.col("f").alias("part_f"))

    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    sides = [cuts.select(*mine, "f", "k", F.lit(side).alias("side"), *_run(first, size)) for side, first, size in (
        (0, F.lit(1), F.col("k")), (1, F.col("k") + 1, F.col("n") - F.col("k")))]
    both = sides[0].unionByName(sides[1]).join(known, same).groupBy(*_G, "f", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part_f"))).alias("r"))
    # decimals: the product and the sum may pass 64 bits
    score = F.expr("(CAST(f AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = both.groupBy(*_G, "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = longer.where("n > 2").select("*", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("at"))
    held = inner.select(*_run(F.col("at"), F.col("m")), "f").groupBy(*same).agg(F.max("f").alias("longer_f")).toDF(*_G, "longer_f")
    kept = scored.join(held, _G, "left").where(F.col("longer_f").isNull() | (F.col("longer_f") * 100 < F.col("f") * within))
    words = kept.select(*mine, "f", "cut", F.posexplode(F.array_compact(F.transform(F.array(*_G), lambda g: F.when(g > 0, g)))).alias("pos", "word_id"))
    named = words.join(vocabulary.select("word_id", "lang", "word"), "word_id").groupBy(*_G, "f", "cut").agg(
        F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = named.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
                        F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    final = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return final.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
