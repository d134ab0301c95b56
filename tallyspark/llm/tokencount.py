"""Token counts of every prefix by dynamic programming (operator 12).

Byte-level BPE encodes the pieces of a text one by one, and a row of tokens is the
encoding of its bytes exactly if each token and the next are that of theirs.  So the
last token of a prefix is the one token ending there that fits behind the encoding of
what stands before it, and one pass over a piece gives the count of all its prefixes.
Pieces are found for a whole batch of texts by vector operations over classes of
characters (asked of the library itself, once for each character that turns up), each
different piece is worked out once and remembered, and sums over pieces
give the counts at every character of a text.

A count at a prefix is what the library gives for the prefix as a text by itself:
where cutting changes the pieces (within white space before a word, within ``'re``,
``'ve``, ``'ll``, within a special token) the changed pieces are counted.

Null and empty texts have no tokens.  Special strings inside texts are their tokens,
as by the library's default.  Rows are counted one by one, repeated or not; extra
columns are ignored; an empty table gives an empty result.  Files of another kind
than plain byte-level BPE are refused.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import buffers

LIMIT = 1024
#: Bytes of text worked on at a time (a longer text by itself), and remembered pieces of each of two generations.
PIECE, REMEMBERED = 1 << 21, 200_000
_HEAD = 4
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = 0, 1, 2, 3, 255


def _plain_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    ones for themselves, the others for characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class Counter:
    """Prefix counts under one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not (plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                and file["normalizer"] is None):
            raise ValueError(f"{path} is not plain byte-level BPE")
        special = [t for t in file["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special tokens that take what stands around them are not known here")
        self.special = sorted((t["content"].encode() for t in special), key=len, reverse=True)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        byte = _plain_bytes()

        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token)

        vocabulary = {raw(t) for t in model["vocab"] if all(c in byte for c in t)}
        if any(bytes([b]) not in vocabulary for b in range(256)):
            raise ValueError("the vocabulary lacks some bytes")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        #: Every ending of a token, and whether it is one itself.
        self.ending = {t[k:]: False for t in vocabulary for k in range(len(t))} | dict.fromkeys(vocabulary, True)
        #: For a token (none at the start of a piece): which endings of tokens fit behind it.
        self.behind: dict[bytes, dict] = {}
        self.n_behind = 0
        #: The state after the first bytes of a piece, which many pieces share.
        self.heads: dict[bytes, tuple[list[int], list[dict]]] = {}
        self.young: dict[bytes, Sequence[int]] = {}
        self.old: dict[bytes, Sequence[int]] = {}
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> Counter:
        return Counter(path)

    # ------------------------------------------------- one piece ---

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes, by merging."""
        parts = [data[k:k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, first: bytes, second: bytes) -> bool:
        """Whether the tokens are the encoding of their bytes; ``first`` may be empty, and ``second`` may be no token."""
        return self.ending[second] and self.merge(first + second) == [t for t in (first, second) if t]

    def prefixes(self, piece: bytes) -> Sequence[int]:
        """Tokens of ``piece[:1]``, ``piece[:2]``, ... up to the whole."""
        behind, heads = self.behind, self.heads
        if self.n_behind > 1_000_000 or len(heads) > 50_000:
            heads.clear()
            behind.clear()
            self.n_behind = 0
        # ``after``: for each prefix what is known to fit, or not, behind its last token (which stands under None)
        head, at = piece[:_HEAD], 0
        known_head = heads.get(head)
        if known_head is None:
            counts, after = [0], [behind.setdefault(b"", {None: b""})]
        else:
            counts, after = known_head[0].copy(), known_head[1].copy()
            at = len(counts) - 1
        for end in range(at + 1, len(piece) + 1):
            start = end - 1
            while True:
                token = piece[start:end]
                fit = after[start].get(token)
                if fit is None:
                    fit = after[start][token] = self.fits(after[start][None], token)
                    self.n_behind += 1
                if fit:
                    break
                start -= 1
            counts.append(counts[start] + 1)
            nxt = behind.get(token)
            after.append(behind.setdefault(token, {None: token}) if nxt is None else nxt)
            if end == _HEAD and known_head is None:
                heads[head] = counts.copy(), after.copy()
        del counts[0]
        return bytes(counts) if len(piece) < 256 else array("l", counts)

    def learn(self, piece: bytes) -> Sequence[int]:
        """``prefixes``, remembered; what has not been asked for in a while is forgotten."""
        known = self.young.get(piece)
        if known is None:
            known = self.old.get(piece)
            if known is None:
                known = (1,) * len(piece) if piece in self.special else self.prefixes(piece)
            if len(piece) <= 64:
                if len(self.young) >= REMEMBERED:
                    self.young, self.old = {}, self.young
                self.young[piece] = known
        return known

    # ---------------------------------------------------- texts ---

    def kinds(self, chars: np.ndarray) -> np.ndarray:
        out = self.kind[chars]
        for c in np.unique(chars[out == _UNKNOWN]).tolist():
            def one(before: str, c: int = c) -> bool:
                return len(self.library.pre_tokenize_str(before + chr(c))) == 1

            self.kind[c] = _LETTER if one("a") else _NUMBER if one("1") else _OTHER if one("!") else _SPACE
        return self.kind[chars]

    def split(self, data: bytes, texts: np.ndarray) -> Pieces:
        return Pieces(self, data, texts)

    def count(self, data: bytes) -> int:
        return int(Pieces(self, data, np.array([0, len(data)])).totals()[0])


class Pieces:
    """The pieces of some texts: ``start`` (bytes, one more than there are pieces), their
    different values and which of them each is."""

    def __init__(self, counter: Counter, data: bytes, texts: np.ndarray):
        self.counter, self.data, self.texts = counter, data, texts
        raw = np.frombuffer(data, np.uint8)
        chars = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        self.lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        n = len(chars)
        if n != len(self.lead) - 1:
            raise ValueError("the texts are not UTF-8")
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(self.lead, texts)] = True
        self.special = self._special(edge)
        kind = counter.kinds(chars)
        space = kind == _SPACE
        cut = edge[:n].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        # the last white space before a word: a blank belongs to the word, anything else stands alone
        self.before = before = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) if n else np.zeros(0, np.int64)
        self.run = np.zeros(0, np.int64)
        if len(before):
            starts = np.flatnonzero(cut)
            self.run = starts[np.searchsorted(starts, before, "right") - 1]  # where the white space begins
        cut[before] = True
        cut[before[chars[before] == 32] + 1] = False
        self.short = self._contractions(chars, cut, edge)
        for a, b in self.special:
            cut[a + 1:b] = False
        self.first = np.append(np.flatnonzero(cut), n)  # in characters
        self.start = self.lead[self.first]
        values = pa.Array.from_buffers(pa.large_binary(), len(self.start) - 1, [None, pa.py_buffer(self.start.astype(np.int64)), pa.py_buffer(data)])
        coded = values.dictionary_encode()
        self.which = coded.indices.to_numpy()
        self.known = [counter.learn(p) for p in coded.dictionary.to_pylist()]
        total = np.fromiter((k[-1] for k in self.known), np.int64, len(self.known))
        self.sums = np.concatenate(([0], np.cumsum(total[self.which]))) if len(self.which) else np.zeros(1, np.int64)
        self.bank: tuple[np.ndarray, np.ndarray] | None = None

    def _special(self, edge: np.ndarray) -> list[tuple[int, int]]:
        """Special tokens inside the texts, from left to right, the longest first; their ends become edges."""
        found, at = [], 0
        ends = self.texts
        if not any(s in self.data for s in self.counter.special):
            return found
        while True:
            hits = [(self.data.find(s, at), -len(s)) for s in self.counter.special]
            hits = [h for h in hits if h[0] >= 0]
            if not hits:
                return found
            a, size = min(hits)
            b = a - size
            if np.searchsorted(ends, a, "right") != np.searchsorted(ends, b, "left"):
                at = a + 1  # runs over the end of a text
                continue
            first, last = np.searchsorted(self.lead, [a, b]).tolist()
            edge[first] = edge[last] = True
            found.append((first, last))
            at = b

    def _contractions(self, chars: np.ndarray, cut: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Joins 's 't 'm 'd 're 've 'll to one piece; returns the starts of those with two letters."""
        n = len(chars)
        at = np.flatnonzero((chars == 39) & cut)
        at = at[at + 1 < n]
        at = at[~edge[at + 1]]
        one = np.isin(chars[at + 1], [ord(c) for c in "stmd"])
        rest = at[~one & (at + 2 < n)]
        rest = rest[~edge[rest + 2]]
        x, y = chars[rest + 1], chars[rest + 2]
        two = rest[((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))]
        for begin, size in ((at[one], 2), (two, 3)):
            cut[begin + 1] = False
            after = begin + size
            cut[after[after < n]] = True
        return two

    def totals(self) -> np.ndarray:
        """Tokens of each text."""
        at = np.searchsorted(self.start[:-1], self.texts)
        return self.sums[at[1:]] - self.sums[at[:-1]]

    def counts(self, k: int) -> np.ndarray:
        """Tokens of the first 0, 1, 2, ... characters of text k."""
        if self.bank is None:
            begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.known), np.int64, len(self.known)))))
            held = np.frombuffer(b"".join([x if isinstance(x, bytes) else bytes(len(x)) for x in self.known]), np.uint8).astype(np.int64)
            for i, x in enumerate(self.known):
                if not isinstance(x, bytes):
                    held[begin[i]:begin[i + 1]] = x
            self.bank = held, begin
        held, begin = self.bank
        a, b = np.searchsorted(self.lead, self.texts[k:k + 2]).tolist()  # characters
        p, q = np.searchsorted(self.first[:-1], [a, b]).tolist()  # pieces
        piece = np.repeat(np.arange(p, q), np.diff(self.first[p:q + 1]))
        within = self.lead[a + 1:b + 1] - self.start[piece] - 1
        out = np.concatenate(([0], self.sums[piece] - self.sums[p] + held[begin[self.which[piece]] + within]))
        # white space of several characters that ends the prefix is one piece
        i = np.searchsorted(self.before, [a, b])
        for end, run in zip(self.before[i[0]:i[1]].tolist(), self.run[i[0]:i[1]].tolist(), strict=True):
            if run < end:
                white = self.counter.learn(self.data[self.lead[run]:self.lead[end + 1]])
                out[end + 1 - a] = out[run - a] + white[-1]
        i = np.searchsorted(self.short, [a, b])
        out[self.short[i[0]:i[1]] + 2 - a] = out[self.short[i[0]:i[1]] - a] + 2  # "'" and one letter
        end = a
        for first, last in self.special:
            if a <= first < b:  # a part of a special token is text like any other, behind what stands before it
                for stop in range(first + 1, last):
                    out[stop - a] = out[end - a] + self.counter.count(self.data[self.lead[end]:self.lead[stop]])
                end = last
        return out


def _batches(path: str, limit: int | None, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            lo, n = 0, batch.num_rows
            while lo < n:
                hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1))
                pieces = counter.split(data[offsets[lo]:offsets[hi]].tobytes(), offsets[lo:hi + 1] - offsets[lo])
                total = pieces.totals()
                chars = np.diff(np.searchsorted(pieces.lead, pieces.texts))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(pieces.texts)), pa.array(chars), pa.array(total)]
                names = ["id", "n_bytes", "n_chars", "n_tokens"]
                if limit is not None:
                    kept = chars.copy()
                    for k in np.flatnonzero(total > limit).tolist():
                        kept[k] = np.flatnonzero(pieces.counts(k) <= limit)[-1]
                    columns.append(pa.array(kept))
                    names.append("kept_chars")
                if every:
                    columns.append(pa.array([pieces.counts(k) for k in range(hi - lo)], pa.list_(pa.int32())))
                    names.append("counts")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                lo = hi

    return run


def counted(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, kept_chars) of every text: ``kept_chars`` is the
    length of its longest prefix of at most ``limit`` tokens."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_batches(path, limit, False), "id long, n_bytes long, n_chars long, n_tokens long, kept_chars long")


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, counts): ``counts[p]`` is the number of tokens of the first p
    characters.  Written once, it answers questions about any cut without the tokenizer."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_batches(path, None, True), "id long, n_bytes long, n_chars long, n_tokens long, counts array<int>")


def tokens_of(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters (all, if there are fewer)."""
    return F.get(counts, F.least(chars, F.size(counts) - 1).cast("int"))


def longest_within(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fitting = F.transform(counts, lambda c, p: F.when(c <= budget, p))
    return F.coalesce(F.array_max(fitting), F.lit(0))
