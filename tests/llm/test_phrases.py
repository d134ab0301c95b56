"""Phrases and their filters."""
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import phrases
from tests.llm.conftest import ODD

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, held in f.items():
        cand = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        rows_ = []
        for p, a in cand.items():
            if p in inside and 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (held[p[:k]] + held[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.fixture
def corpus(spark):
    def make(rows):
        return spark.createDataFrame([(k, lang, t, "x", 1, 2) for k, (lang, t) in enumerate(rows)],
                                     "doc_id long, lang string, text string, word string, g1 long, n int")
    return make


@pytest.mark.parametrize("least,top,chunk,held,bits", [(30, 2000, 2 << 20, 1 << 21, 1 << 27), (4, 25, 3000, 500, 1 << 10)])
def test_collocations_as_by_brute_force(corpus, prose, monkeypatch, least, top, chunk, held, bits):
    for name, value in (("CHUNK", chunk), ("HELD", held), ("BITS", bits)):
        monkeypatch.setattr(phrases, name, value)
    r = random.Random(5)
    fixed = ["new york city hall", "of the", "in spite of", "Été à Paris", "a a a a a a", "x y x y"]
    rows = [(None if k % 9 == 0 else "en" if k % 3 else "fr", " ".join(
        r.choice([prose(1000 * k + j, 3, 30), r.choice(fixed), r.choice([".", ",\t", "!\r\n", "\x0b", " ? "])]) for j in range(r.randrange(40)))) for k in range(220)]
    rows += [(None, t) for t in ODD] + [("de", "same same " * 60)] + rows[:40]
    got = sorted(map(tuple, phrases.collocations(corpus(rows), least=least, top=top).collect()))
    want = brute(rows, least, top)
    assert got == want and len({x[0] for x in want}) >= 3 and any(len(x[2].split()) == 4 for x in want)


def test_no_texts_or_no_frequent_phrase(corpus):
    assert phrases.collocations(corpus([])).collect() == []
    assert phrases.collocations(corpus([("en", None), (None, ""), ("en", "a b c")])).collect() == []
    assert [tuple(x)[:3] for x in phrases.collocations(corpus([("en", "a b. c")] * 30)).collect()] == [("en", 1, "a b")]


@pytest.mark.parametrize("n", [2, 3, 4])
def test_filters_lose_nothing(n):
    r = np.random.default_rng(n)
    ids = r.choice(np.array([1, 2, 3, 70_000, 2**32 - 1], np.uint32), 6000)
    keys = phrases.packed(ids, n, np.arange(5000))
    assert (phrases.restored(phrases.permuted(keys)) == keys).all()
    f = phrases.Filter.of(phrases.permuted(keys), r.integers(1, 400, 5000))
    for bits in (1, 5, 16):
        parts = [phrases.Filter.decoded(d, s, bits, keys.shape[1]) for s, d in f.shards(bits)]
        whole = phrases.Filter.merged([*parts, *parts])
        assert (whole.keys == f.keys).all() and (whole.counts == 2 * f.counts).all()
    back = phrases.unpacked(phrases.restored(f.keys), n)
    assert set(zip(*[x.tolist() for x in back], strict=True)) == {tuple(ids[i:i + n].tolist()) for i in range(5000)}


def test_a_task_merges_and_sends_its_filters_in_parts():
    r = np.random.default_rng(8)
    streams = [r.integers(1, 1 << 20, 1 << 17).astype(np.uint32) for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in streams], pa.binary())], names=["ids"])
    sent, largest = Counter(), 0
    tracemalloc.start()
    for out in phrases._filters(3, 6, None)(iter([batch])):
        largest = max(largest, out.nbytes)
        sent.update({shard: len(phrases.Filter.decoded(data, shard, 6, 2)) for shard, data in zip(*[c.to_pylist() for c in out.columns], strict=True)})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    runs = np.unique(np.concatenate([np.stack([s[:-2], s[1:-1], s[2:]], axis=1) for s in streams]), axis=0)
    assert sum(sent.values()) == len(runs) > 1_300_000 and len(sent) == 64
    assert largest < 4 << 20 and peak < 40 * len(runs)  # a run held takes 24 bytes


@pytest.mark.parametrize("n", [2, 4])
def test_merged_slices_are_the_whole(monkeypatch, n):
    monkeypatch.setattr(phrases, "SLICE", 50)
    r = np.random.default_rng(n)
    filters = []
    for size in (0, 1, 700, 3000):
        ids = r.integers(1, 30, size * n).astype(np.uint32)
        filters.append(phrases.Filter.of(phrases.permuted(phrases.packed(ids, n, np.arange(size) * n)), r.integers(1, 400, size)))
    whole = phrases.Filter.of(np.concatenate([f.keys for f in filters]), np.concatenate([f.counts for f in filters]))
    got = phrases.Filter.merged(filters)
    assert (got.keys == whole.keys).all() and (got.counts == whole.counts).all()
    for bits in (1, 3, 16):
        parts = list(phrases.Filter.slices(filters, bits))
        assert len(parts) > 1 and (np.concatenate([f.keys for f in parts]) == whole.keys).all()
        heads = [set((f.keys[:, 0] >> np.uint64(64 - bits)).tolist()) for f in parts]
        assert sum(map(len, heads)) == len(set().union(*heads))
