import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tallyspark.llm import neardup, words
from tallyspark.llm.components import components
from tests.llm.conftest import ODD


def brute(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    moved = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def found(df):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}


def test_same_groups_as_all_pairs(docs, prose):
    r = random.Random(1)
    rows = [(k, t) for k, t in enumerate(ODD * 2)]
    base = prose(7, 120).split()
    for k in range(160):  # one group with few to many changes: mutual similarities on both sides of the bound
        copy = list(base)
        for _ in range(r.randrange(9)):
            copy[r.randrange(len(copy))] = f"n{r.randrange(40)}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(1000 + k, prose(k % 30, 60) + (" more" if k > 30 else "")) for k in range(60)]
    assert found(docs(rows)) == brute(rows)


def test_repeated_rows_null_ids_and_no_rows(docs, prose):
    t = prose(1, 50)
    rows = neardup.near_duplicates(docs([(5, t), (5, t), (None, t), (None, None), (9, "")])).collect()
    assert sorted((r["id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 9)]
    assert neardup.near_duplicates(docs([])).collect() == []


def test_sketch_estimates_similarity_and_fills_for_any_size():
    r = np.random.default_rng(3)
    for n in (1, 3, 50, 5000):
        assert (neardup.sketch(r.integers(0, 2**63, n, dtype=np.uint64)) < 2**64 - 1).all()
    both, one, two = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    agree = np.mean([(neardup.sketch(np.append(both + np.uint64(k), one)) == neardup.sketch(np.append(both + np.uint64(k), two))).mean() for k in range(20)])
    assert abs(agree - 0.75) < 0.03


def test_pairs_are_verified_some_at_a_time(prose, monkeypatch):
    one = [prose(i, 300) for i in range(100)] * 20
    two = [t if i % 3 else prose(1000 + i, 300) for i, t in enumerate(one)]
    two[1] = " ".join(one[:20])
    batch = pa.record_batch([pa.array(range(2000)), pa.array(range(2000)), pa.array([None, *one[1:]]), pa.array(two)], names=["a", "b", "c", "d"])
    monkeypatch.setattr(words, "PIECE", 1 << 14)
    tracemalloc.start()
    try:
        found = [*neardup._verify_batches(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [a for b in found for a in b.column(0).to_pylist()] == [i for i in range(2000) if i % 3 and i != 1]
    assert peak < 5_000_000  # the sets of all pairs: 2 x 4.8 MB


def test_components_of_chains_stars_and_random_links(spark):
    r = random.Random(9)
    links = [(k, k + 1) for k in range(1, 60)] + [(200, 200 + k) for k in range(1, 30)] + [(300 + r.randrange(90), 300 + r.randrange(90)) for _ in range(70)]
    links += [(500 - k, 501 - k) for k in range(40)] + links[:9] + [(900, 900)]
    r.shuffle(links)
    least = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in found} == least and len(found) == len(least)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
