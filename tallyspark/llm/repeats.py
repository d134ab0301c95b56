"""Removal of repeated passages by recompression (operator 5).

Words are the first symbols.  In a round every symbol is a left or a right one
by a bit of its name, and a left symbol with a right one after it becomes one
symbol, named by a hash of both: the name is the same wherever the pair stands,
in any document on any executor.  Equal neighbours are never joined, so a run
of one symbol looks alike inside however it is cut, and is told once per document.

After two rounds a symbol has at most four words, and a border between symbols
is settled by the three words on either side of it.  So in every window of 13
words the middle seven hold at least one whole symbol, cut the same way wherever
the window's words occur.  Of these the window chooses one by its name; the
chosen symbol with three words on either side (7 to 10 words) is the window's
*anchor*.  Two equal windows have the same anchor, thus:

1. Spark groups the anchors of all documents; those in one document only are
   done with, and their windows are unique.
2. The windows of shared anchors are verified: grouped by anchor and the hash of
   all 13 words (128 bits together), each is repeated unless its document has
   the smallest id of its group.
3. The words that repeated windows cover are removed.

Both groupings are shuffles of packed arrays by ranges of the anchor's name.  A
task first settles what repeats within its own stretch of text, so a passage in
a third of all documents sends one row per stretch, not one per document.

Null or empty texts have no words.  A row without an id keeps all its words
and is no one's source; rows that repeat an id don't repeat each other.  Extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import written
from tallyspark.llm.words import U, Words, _power, mix, pieces

WINDOW = 13
#: Bytes of text whose anchors or windows a task settles among themselves before it sends them.
STRETCH = 16 << 20
_REACH = 3  # words on either side that settle a border of the second round
_NO = U(2**64 - 1)


def _round(names: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """One round: a left symbol and the right symbol after it become one symbol."""
    left = (mix(names ^ U(salt)) & U(1)).astype(bool)
    joined = np.zeros(len(names), bool)  # with the symbol before it
    joined[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~joined)
    pair = np.zeros(len(names), bool)
    pair[:-1] = joined[1:]
    name = names[first].copy()
    two = pair[first]
    name[two] = mix(names[first[two]] * U(3) + names[first[two] + 1] + U(salt))
    last = first + two
    return name, start[first], end[last], doc[first]


def parse(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, word after) of the symbols after two rounds, at most four words each."""
    at = np.arange(len(h))
    name, start, end, doc = _round(h, at, at + 1, words.doc, 0x51ED270B)
    name, start, end, doc = _round(name, start, end, doc, 0x2545F491)
    return name, start, end


def windows(words: Words, n: int = WINDOW) -> np.ndarray:
    """First words of all windows of n words."""
    if len(words.doc) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[: len(words.doc) - n + 1] == words.doc[n - 1 :])


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of word spans, from sums over powers as for the bytes of a word."""
    power, inverse = _power(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))
    return mix(((sums[end] - sums[start]) * inverse[start]) ^ ((end - start).astype(np.uint64) << U(56)))


def anchors(words: Words, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the symbol chosen in it, and the hash of that symbol with its surroundings."""
    name, start, end = parse(words, h)
    order = mix(name)
    lo = np.searchsorted(start, at + _REACH)
    hi = np.searchsorted(end, at + WINDOW - _REACH, "right")
    best, chosen = np.full(len(at), _NO), lo.copy()
    for k in range(WINDOW - 2 * _REACH):
        i = lo + k
        inside = i < hi
        value = np.where(inside, order[np.minimum(i, len(order) - 1)], _NO)
        take = inside & (value <= best)
        best[take], chosen[take] = value[take], i[take]
    return chosen, spans(h, start[chosen] - _REACH, end[chosen] + _REACH)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number in that order) of rows sorted by the keys, the first foremost."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def _packed(by: np.ndarray, buckets: int, settled: bool, **columns: np.ndarray | None) -> pa.RecordBatch:
    """A row for each range of ``by`` that occurs, with its values as bytes in their order.
    What is settled already goes to ranges of its own."""
    bucket = ((by >> U(40)).astype(np.int64) * buckets) >> 24
    order = np.argsort(bucket, kind="stable")
    present, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(order))[: len(first)]
    out = [pa.array((present + settled * buckets).astype(np.int32))]
    for c in columns.values():
        out.append(pa.array([b"" if c is None else c[order[a:b]].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *columns])


def _values(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _stretches(batches: Iterator[pa.RecordBatch], one: Callable[[pa.RecordBatch], Iterator[tuple[int, tuple]]],
               settle: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for read, found in one(batch):
            held.append(found)
            size += read
            if size >= STRETCH:
                yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])
                held, size = [], 0
    if held:
        yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])


_ANCHORS = "bucket int, name binary, doc binary, known binary"


def _anchor_rows(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct (anchor, document); an anchor with several documents in the stretch is known
    to be shared and sends one more row with ``known``, which stands for the others."""

    def one(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        ids = batch.column(0).to_numpy()
        for lo, _, words in pieces(batch.column(1)):
            at = windows(words)
            if len(at):
                _, name = anchors(words, words.hashes(), at)
                yield len(words.data), (name, ids[lo + words.doc[at]])

    def settle(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name, doc = found
        order, pair = _groups(name, doc)
        order = order[np.flatnonzero(np.diff(pair, prepend=-1))]
        name, doc = name[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        several = np.repeat(np.diff(np.append(first, len(name))), np.diff(np.append(first, len(name)))) > 1
        lead = np.zeros(len(name), bool)
        lead[first] = True
        send = ~several | lead
        yield _packed(name[send], buckets, False, name=name[send], doc=doc[send], known=several[send].astype(np.uint8))
        yield _packed(mix(doc[several].view(np.uint64)), buckets, True, name=name[several], doc=doc[several], known=None)

    return lambda batches: _stretches(batches, one, settle)


def _pairs(name: np.ndarray, doc: np.ndarray) -> pa.Table:
    """(id, names): the shared anchors of each document, as bytes."""
    order = np.argsort(doc, kind="stable")
    ids, first = np.unique(doc[order], return_index=True)
    ends = np.append(first[1:], len(order))[: len(first)]
    return pa.table({"id": pa.array(ids, pa.int64()), "names": pa.array([name[order[a:b]].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})


def _shared(table: pa.Table) -> pa.Table:
    name, doc, known = _values(table, "name", np.uint64), _values(table, "doc", np.int64), _values(table, "known", np.uint8)
    if not len(known):
        return _pairs(name, doc)
    order, group = _groups(name)
    shared = (np.bincount(group)[group] > 1) | (np.bincount(group, weights=known[order])[group] > 0)
    keep = order[shared & (known[order] == 0)]
    return _pairs(name[keep], doc[keep])


_WINDOWS = "bucket int, name binary, words binary, doc binary, at binary"
_RANGES = "id long, ranges binary"


def _ranges(doc: np.ndarray, at: np.ndarray) -> pa.Table:
    """(id, ranges): first and last of consecutive repeated windows, pairs of 32 bits."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.int64)
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    both = np.stack([at[first], at[last]], axis=1).astype(np.int32)
    ids, start = np.unique(doc[first], return_index=True)
    ends = np.append(start[1:], len(first))[: len(start)]
    return pa.table({"id": pa.array(ids, pa.int64()), "ranges": pa.array([both[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary())})


def _repeated(name: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same window."""
    order = np.lexsort((doc, words, name))
    n, w = name[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
    low = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    repeated = np.zeros(len(doc), bool)
    repeated[order] = low < doc[order]
    return repeated


def _window_rows(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows with a shared anchor; those with the same words in a smaller document of the stretch are settled."""

    def one(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        ids = batch.column(0).to_numpy()
        shared = batch.column(2).to_pylist()
        for lo, _, words in pieces(batch.column(1)):
            at = windows(words)
            if not len(at):
                continue
            h = words.hashes()
            _, name = anchors(words, h, at)
            doc = words.doc[at]
            cut = np.searchsorted(doc, np.arange(len(words.first)))
            keep = np.zeros(len(at), bool)
            for d in np.unique(doc).tolist():
                own = slice(cut[d], cut[d + 1])
                keep[own] = np.isin(name[own], np.frombuffer(b"".join(shared[lo + d]), np.uint64))
            at, name, doc = at[keep], name[keep], doc[keep]
            yield len(words.data), (name, spans(h, at, at + WINDOW), ids[lo + doc], (at - words.first[doc]).astype(np.int32))

    def settle(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name, words, doc, at = found
        repeated = _repeated(name, words, doc)
        send = ~repeated
        yield _packed(name[send], buckets, False, name=name[send], words=words[send], doc=doc[send], at=at[send])
        yield _packed(mix(doc[repeated].view(np.uint64)), buckets, True, name=None, words=None, doc=doc[repeated], at=at[repeated])

    return lambda batches: _stretches(batches, one, settle)


def _verified(table: pa.Table) -> pa.Table:
    name, words = _values(table, "name", np.uint64), _values(table, "words", np.uint64)
    doc, at = _values(table, "doc", np.int64), _values(table, "at", np.int32)
    repeated = _repeated(name, words, doc) if len(name) else np.ones(len(doc), bool)
    return _ranges(doc[repeated], at[repeated])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, n_words, n_removed): the kept words joined by one space."""
    for batch in batches:
        texts, counts, gone = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            if ranges:
                cover = np.zeros(len(words) + 1, np.int64)
                both = np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 2)
                np.add.at(cover, both[:, 0], 1)
                np.add.at(cover, both[:, 1] + WINDOW, -1)
                keep = np.cumsum(cover[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            gone.append(counts[-1] - len(words))
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                                         names=["id", "text", "n_words", "n_removed"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_words, n_removed) of each row: its kept words joined by one space."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    source = every.where("id IS NOT NULL")

    found = source.mapInArrow(_anchor_rows(buckets), _ANCHORS).groupBy("bucket").applyInArrow(_shared, "id long, names binary")
    names = written(found).groupBy("id").agg(F.collect_list("names").alias("names"))
    rows = source.join(names, "id").select("id", "text", "names").mapInArrow(_window_rows(buckets), _WINDOWS)
    found = rows.groupBy("bucket").applyInArrow(_verified, _RANGES)
    ranges = written(found).groupBy("id").agg(F.collect_list("ranges").alias("ranges"))
    schema = "id long, text string, n_words long, n_removed long"
    return source.join(ranges, "id", "left").select("id", "text", "ranges").mapInArrow(_removed, schema).union(
        every.where("id IS NULL").withColumn("ranges", F.lit(None).cast("array<binary>")).mapInArrow(_removed, schema))
