"""Encoding and decoding by byte-pair merges of a given vocabulary (operator 9).

A text over ``LEAF`` bytes goes through tree concatenation: it is cut at code
points into leaves, wherever in a word that may be, the leaves are encoded each
for itself (the words of many leaves together, by as many threads as the
library has), and neighbours are joined, halves of halves up to the whole.  A
join re-encodes a window of some words on either side of the seam and doubles
it until its first and last word come out as they were (or it reaches the end).
The vocabulary's splitting drops white space and never looks across it, so what
lies outside such a window cannot change.  A bounded memory holds words met before.

A word over ``LEAF`` bytes is cut further, into leaves of its normalised pieces,
which become rows of their own and are encoded in parallel tasks; their joins
compare tokens in place of words.  Then every adjacent pair of
tokens is one that occurs in an encoding, and a sequence all of whose adjacent
pairs encode to themselves is the encoding of its text, because merges run in
the order of their ranks and a merge across a seam would also happen in the pair.

Only vocabularies that lower-case, drop white space and mark the end of a word
are taken; others are refused with a ``ValueError``.

Null texts are empty; an empty text has no tokens.  Rows that repeat an id are
encoded each for itself; extra columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import frugal, written

LEAF = 1024
_KEPT_WORDS, _TOGETHER = 250_000, 200_000
#: Letters of which lower() and NFC change nothing but the case, then signs other than the apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_SIGNS = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_SIGNS |= {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - _SIGNS.keys()))}  # bytes as letters, as the vocabulary has them
#: Normalisation and splitting that the words' memory relies on.
_RULES = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
_loaded: dict[str, "Encoder"] = {}


class _LongWord(Exception):
    """A word over ``LEAF`` bytes has come together at a seam."""


def _byte_form(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_SIGNS)


class Part(NamedTuple):
    """Neighbouring words of a text and their ids; ``open``: the last word may go on behind it."""

    words: list[bytes]
    ids: list[bytes]
    open: bool


def leaves(data: bytes) -> list[tuple[list[bytes], bool]]:
    """The words of every ``LEAF`` bytes of a text, cut at code points, and whether the last one is cut."""
    at, out = 0, []
    while at < len(data):
        to = at + LEAF
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append((data[at:to].split(), to < len(data) and not data[to - 1 : to].isspace() and not data[to : to + 1].isspace()))
        at = to
    return out


def blocks(texts: pa.Array) -> Iterator[list[tuple[bytes, list[tuple[list[bytes], bool]]]]]:
    """Consecutive texts and their leaves, about ``_TOGETHER`` words at a time: the
    words of a whole batch would be several times as large as its texts."""
    some, size = [], 0
    for text in texts:
        data = (text.as_py() or "").encode()
        cuts = leaves(data)
        some.append((data, cuts))
        size += max(sum(len(words) for words, _ in cuts), len(data) // 8)  # long words count as several
        if size > _TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


class Encoder:
    """One vocabulary file, and the words met so far in this task."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        model = spec["model"]
        rules = tuple([x["type"] for x in (spec[k] or {}).get(several, [])]
                      for k, several in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if rules != _RULES or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a vocabulary of lower-case words with a mark at their end")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        make = lambda suffix: BPE(vocab=model["vocab"], merges=merges, **({"end_of_word_suffix": suffix} if suffix else {}))
        self.inner, self.last = make(None), make(model.get("end_of_word_suffix"))
        self.suffix = model.get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in self.whole.get_vocab().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.decimal = {str(i).encode(): t.encode() for i, t in self.token.items()}
        self.letters = Tokenizer(self.last)  # for lower-case letters in their byte form
        # two generations of each: what was not met since the last change is forgotten with the next
        self.words: dict[bytes, bytes] = {}
        self.roots: dict[str, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_roots: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> "Encoder":
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def learn(self, new: list[bytes]) -> None:
        """Encode words of at most ``LEAF`` bytes and keep the decimal ids of each.  Most are
        letters and then signs, two pieces; the others are left to the whole tokenizer."""
        still = [w for w in new if w in self.old_words]
        self.words.update((w, self.old_words[w]) for w in still)
        if still:
            new = [w for w in new if w not in self.words]
        if len(self.roots) + len(new) > _KEPT_WORDS:
            self.roots, self.old_roots = {}, self.roots
        split, rest, roots, signs = [], [], set(), set()
        known, old = self.roots, self.old_roots
        for w in new:
            m = _PLAIN.fullmatch(w.decode())
            if m is None:
                rest.append(w)
                continue
            root, sign = m[1].lower(), m[2]
            first = known.get(root)
            if first is None:
                first = old.get(root)
                if first is None:
                    roots.add(root)
                else:
                    known[root] = first
            if sign and sign not in known:
                signs.add(sign)
            elif first is not None:
                self.words[w] = first + b" " + known[sign] if sign else first
                continue
            split.append((w, root, sign))
        for some, tokenizer, form in ((list(roots), self.letters, _byte_form), (list(signs), self.whole, str), (rest, self.whole, bytes.decode)):
            found = tokenizer.encode_batch_fast([form(x) for x in some], add_special_tokens=False)
            (self.words if some is rest else self.roots).update(
                (x, " ".join(map(str, e.ids)).encode()) for x, e in zip(some, found, strict=True))
        for w, root, sign in split:
            self.words[w] = self.roots[root] + b" " + self.roots[sign] if sign else self.roots[root]

    def meet(self, words: set[bytes]) -> None:
        """Have the encodings of all these words at hand."""
        new = words - self.words.keys()
        if new and len(self.words) + len(new) > _KEPT_WORDS:
            self.words, self.old_words, new = {}, self.words, words
        if new:
            self.learn(list(new))

    def forget(self) -> None:
        """Drop the words met so far: other stages may use this process next."""
        self.words, self.old_words, self.roots, self.old_roots = {}, {}, {}, {}

    def each(self, words: list[bytes]) -> list[bytes]:
        """Decimal ids of every short word."""
        try:
            return [*map(self.words.__getitem__, words)]
        except KeyError:
            self.meet(set(words))
        return [*map(self.words.__getitem__, words)]

    def ids(self, words: list[bytes]) -> bytes:
        """Decimal ids of short words, joined by one space."""
        return b" ".join(filter(None, self.each(words)))

    def seam(self, left: "Part", right: "Part") -> "Part":
        """Two neighbouring parts of a text as one, from their encodings."""
        width = 1
        while True:
            a, b = left.words[-width:], right.words[:width]
            if left.open and a and b:  # the word that was cut
                again = [*a[:-1], a[-1] + b[0], *b[1:]]
                if len(again[len(a) - 1]) > LEAF:
                    raise _LongWord
            else:
                again = a + b
            ids = self.each(again)
            if (len(a) == len(left.words) or ids[0] == left.ids[-width]) and (len(b) == len(right.words) or ids[-1] == right.ids[width - 1]):
                break
            width *= 2
        n = len(left.words) - len(a)
        return Part(left.words[:n] + again + right.words[len(b):], left.ids[:n] + ids + right.ids[len(b):], right.open)

    def concatenated(self, parts: list["Part"]) -> "Part":
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        return self.seam(self.concatenated(parts[:half]), self.concatenated(parts[half:]))

    def parts(self, word: str) -> Iterator[tuple[bool, int | str]]:
        """(is text, piece) of a long word: ids of added tokens and split pieces."""
        for k, part in enumerate(self.added_at.split(word) if self.added_at else [word]):
            if k % 2:
                yield False, self.added[part]
            elif part:
                for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part)):
                    yield True, piece

    def merge(self, piece: str, last: bool) -> list[int]:
        return [t.id for t in (self.last if last else self.inner).tokenize(piece)]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of two neighbours' text from their encodings; ``last``: the right one ends the piece."""
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            end = last and len(b) == len(right)
            text = "".join(self.token[i] for i in a + b)
            if end and self.suffix:
                text = text.removesuffix(self.suffix)
            again = self.merge(text, end)
            if (len(a) == len(left) or again[0] == a[0]) and (len(b) == len(right) or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b):]
            width *= 2

    def tree(self, leaves: list[list[int]], last: bool = True) -> list[int]:
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        return self.join(self.tree(leaves[:half], False), self.tree(leaves[half:], last), last)

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)


_FIRST = "row string, id long, ids binary, n long, tokens binary, at int, run int, leaf int, last boolean, piece string"


def _first(path: str, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole documents, and of those with a long word the pieces in order: ``at``, for leaves also ``run`` and ``leaf``."""

    def cut(encoder: Encoder, words: list[bytes]) -> Iterator[dict]:
        for w in words:
            if len(w) <= LEAF:
                yield {"ids": encoder.ids([w])}
                continue
            for is_text, piece in encoder.parts(w.decode()):
                if not is_text:
                    yield {"ids": str(piece).encode()}
                elif len(piece) <= LEAF:
                    yield {"ids": " ".join(map(str, encoder.merge(piece, True))).encode()}
                else:
                    run = uuid.uuid4().int % 2**31
                    for k in range(0, len(piece), LEAF):
                        yield {"run": run, "leaf": k // LEAF, "last": k + LEAF >= len(piece), "piece": piece[k : k + LEAF]}

    @frugal
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        schema = pa.schema([("row", pa.string()), ("id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()),
                            ("at", pa.int32()), ("run", pa.int32()), ("leaf", pa.int32()), ("last", pa.bool_()), ("piece", pa.string())])
        for batch in batches:
            out, held, at = [], 0, 0
            for block in blocks(batch.column(1)):
                some = set()  # the words of these texts, learnt together
                for _, cuts in block:
                    for n, (words, is_open) in enumerate(cuts):
                        some.update(words)
                        if is_open:
                            some.add(words[-1] + cuts[n + 1][0][0])
                encoder.meet({w for w in some if len(w) <= LEAF})
                for data, cuts in block:
                    key, k = batch.column(0)[at].as_py(), at
                    at += 1
                    try:
                        whole = encoder.concatenated([Part(words, encoder.each(words), is_open) for words, is_open in cuts]) if cuts else None
                    except _LongWord:
                        row = uuid.uuid4().hex
                        some = [{"row": row, "id": key, "at": k} | x for k, x in enumerate(cut(encoder, data.split()))]
                    else:
                        ids = b" ".join(filter(None, whole.ids)) if whole else b""
                        tokens = b" ".join(map(encoder.decimal.__getitem__, ids.split())) if digests else b""
                        some = [{"id": key, "n": ids.count(b" ") + 1 if ids else 0, "ids": _digest(ids) if digests else ids,
                                 "tokens": _digest(tokens) if digests else None}]
                    out += some
                    held += sum(len(x.get("ids") or b"") + len(x.get("piece") or "") for x in some)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)
        encoder.forget()

    return first


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def _encoded(docs: DataFrame, path: str, key: str, text: str, digests: bool) -> DataFrame:
    """(id, n, ids, tokens): ids in decimal, or digests of ids and decoded text."""

    @frugal
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            ids = [None if p is None else " ".join(map(str, encoder.merge(p, last))).encode()
                   for p, last in zip(batch.column("piece").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            merged = [a if b is None else b for a, b in zip(batch.column("ids").to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "id", "at", "run")] + [pa.array(merged, pa.binary())],
                                             names=["row", "id", "at", "run", "ids"])

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        encoder = Encoder.of(path)
        ids: list[int] = []
        held: list[list[int]] = []
        parts = parts.sort_values("at")
        runs = parts["run"].fillna(-1).astype("int64").tolist()
        for k, (run, data) in enumerate(zip(runs, parts["ids"], strict=True)):
            some = [int(x) for x in data.split()]
            if run < 0:
                ids += some
                continue
            held.append(some)
            if k + 1 == len(runs) or runs[k + 1] != run:
                ids += encoder.tree(held)
                held = []
        data = " ".join(map(str, ids)).encode()
        tokens = encoder.decode(ids).encode() if digests else None
        return pd.DataFrame({"id": [parts["id"].iloc[0]], "n": [len(ids)], "ids": [_digest(data) if digests else data],
                             "tokens": [_digest(tokens) if digests else None]}).astype({"id": "Int64"})

    cut = written(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _first(path, digests), _FIRST))
    done = cut.where("row IS NULL").select("id", "n", "ids", "tokens")
    spread = cut.where("row IS NOT NULL").select("row", "id", "at", "run", "ids", "piece", "last").repartition("row", "at")
    long_ = spread.mapInArrow(leaves, "row string, id long, at int, run int, ids binary").groupBy("row").applyInPandas(
        join, "id long, n long, ids binary, tokens binary")
    return done.union(long_)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    texts = F.col("ids").cast("string")
    return _encoded(docs, path, key, text, False).select(
        "id", F.when(texts == "", F.array().cast("array<int>")).otherwise(F.split(texts, " ").cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of rows (id, ids)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([encoder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())],
                                             names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(texts, "id long, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text: it
    is encoded, and its ids decoded, in one pass."""
    return _encoded(docs, path, key, text, True).select(
        "id", F.col("n").alias("n_tokens"), F.col("ids").cast("string").alias("ids_sha256"), F.col("tokens").cast("string").alias("decoded_sha256"))
