"""Benchmark decontamination by spaced seeds (operator 6).

A document overlaps an item if some 13 consecutive words of the item stand in
the document, in place, with at most 3 of them substituted; an item of fewer
than 13 words must stand there whole and unchanged.  Words are runs other than
white space, compared with A-Z lowered.

``MASKS`` look at 5 of at most 9 word positions and ignore the others.  They were
chosen so that every choice of up to 3 substituted words among 13 leaves at
least one of them untouched somewhere (a test goes through all of them), so
joining the masked hashes of items and documents misses no overlap.  Each hit
fixes a shift between item and document, along which the words are compared.

Items are taken in blocks of about ``BLOCK`` bytes by a hash of their id and text
(equal rows once), so copies of one text are spread over the blocks too; a block's
masked hashes are broadcast, and each document is met where it lies: no document
is shuffled, whatever the number of items.

Null or empty texts and items overlap nothing; rows that repeat an id are judged
each for itself; items of one id count together; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import frugal, written
from tallyspark.llm.words import U, Words, grams, pieces

WINDOW, SUBSTITUTED = 13, 3
MASKS = ((0, 3, 5, 6, 7), (0, 1, 3, 4, 5), (0, 3, 4, 6, 7), (0, 1, 3, 7, 8))
BLOCK = 4 << 20
_FILTER_BITS = 22
_FOUND = "array<struct<item_id:long,matched:int,words:int,at:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("words", pa.int32()), ("at", pa.int32())]))


class Seeds:
    """The masked hashes of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        words = [w for _, _, w in pieces(pa.array(texts, pa.string()))]
        hashes = np.concatenate([w.hashes(lower=True) for w in words] or [np.zeros(0, np.uint64)])
        lengths = np.concatenate([np.diff(w.first) for w in words] or [np.zeros(0, np.int64)])
        self.ids, self.first, self.hashes = ids, np.concatenate(([0], np.cumsum(lengths))), hashes
        owner = np.repeat(np.arange(len(ids)), lengths)
        self.tables = []
        short = [tuple(range(int(n))) for n in np.unique(lengths) if 0 < n < 9]
        for mask in (*MASKS, *short):
            g = grams(hashes, 0, mask)
            own = np.flatnonzero(owner[: len(g)] == owner[mask[-1] : mask[-1] + len(g)])
            if mask in short:
                own = own[lengths[owner[own]] == len(mask)]
            order = own[np.argsort(g[own], kind="stable")]
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[g[order] >> U(64 - _FILTER_BITS)] = True
            self.tables.append((mask, g[order], order, owner[order], seen))

    def overlaps(self, words: Words) -> list[list[dict]]:
        """For each text the items it overlaps, with the best shift of each."""
        h = words.hashes(lower=True)
        hits = []
        for mask, values, at, owner, seen in self.tables:
            g = grams(h, 0, mask)
            maybe = np.flatnonzero(seen[g >> U(64 - _FILTER_BITS)])
            maybe = maybe[words.doc[maybe] == words.doc[maybe + mask[-1]]]
            lo, hi = np.searchsorted(values, g[maybe], "left"), np.searchsorted(values, g[maybe], "right")
            times = hi - lo
            place = np.repeat(maybe, times)
            entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            shift = place - words.first[words.doc[place]] - (at[entry] - self.first[owner[entry]])
            hits.append(np.stack([words.doc[place], owner[entry], shift], axis=1))
        out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, shift in np.unique(np.concatenate(hits), axis=0).tolist():
            text = h[words.first[doc] : words.first[doc + 1]]
            own = self.hashes[self.first[item] : self.first[item + 1]]
            a, b = max(0, -shift), min(len(own), len(text) - shift)
            span = min(WINDOW, len(own))
            need = WINDOW - SUBSTITUTED if len(own) >= WINDOW else len(own)
            if b - a < span:
                continue
            same = own[a:b] == text[a + shift : b + shift]
            sums = np.concatenate(([0], np.cumsum(same)))
            inside = np.flatnonzero(sums[span:] - sums[:-span] >= need)
            if len(inside):
                covered = np.zeros(b - a + 1, np.int64)
                np.add.at(covered, inside, 1)
                np.add.at(covered, inside + span, -1)
                covered = np.cumsum(covered)[:-1] > 0
                found = (int((same & covered).sum()), int(covered.sum()), int(a + shift + inside[0]))
                if (doc, item) not in best or (-found[0], found[2]) < (-best[doc, item][0], best[doc, item][2]):
                    best[doc, item] = found
        for (doc, item), (matched, covered, at) in best.items():
            out[doc].append({"item_id": self.ids[item], "matched": matched, "words": covered, "at": at})
        return out


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
           into: str = "overlaps") -> DataFrame:
    """``docs`` with ``into`` as last column (in place of one of that name): item_id, equal words,
    words of the overlap and its first word, for each item the whole text overlaps."""
    docs, spark = docs.drop(into), docs.sparkSession
    items = written(items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
                    .distinct())  # equal rows have equal hashes, and would all meet in one block
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // BLOCK + 1
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text)
    out = docs.toDF(*names).withColumn("found", F.lit(None).cast(_FOUND))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK bytes
        shared = spark.sparkContext.broadcast(Seeds([r["id"] for r in part], [r["text"] for r in part]))

        @frugal
        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, words in pieces(batch.column(place)):
                    some = batch.slice(lo, hi - lo)
                    old = some.column(len(names)).to_pylist()
                    both = [(a or []) + b for a, b in zip(old, shared.value.overlaps(words), strict=True)]
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(both, _FOUND_TYPE)], names=[*names, "found"])

        out = out.mapInArrow(found, out.schema)
    return out.toDF(*docs.columns, into)


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """A row (id, item_id, matched, words, at) for each document and item that overlap."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return marked(plain, items, "text", item_key, item_text).select("id", F.explode("overlaps").alias("o")).select("id", "o.*")
