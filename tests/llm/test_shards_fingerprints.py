import hashlib
import zlib

from tallyspark.llm import fingerprint, shards
from tests.llm.conftest import ODD


def brute_cuts(sizes, n):
    def fill(cap):
        ends, at, start = [], 0, 0
        for s in sizes:
            if s > cap:
                return None
            if at + s - start > cap:
                ends.append(at)
                start = at
            at += s
        return ends + [at] if len(ends) < n else None

    a, b = max(sizes), sum(sizes)
    while a < b:
        m = (a + b) // 2
        a, b = (a, m) if fill(m) else (m + 1, b)
    return fill(a)


def test_shards_are_the_smallest_that_any_cut_allows(docs, prose):
    texts = ODD + [prose(k % 700, 3 + k * k % 90) for k in range(900)] + ["hot copy"] * 400
    df = docs(list(enumerate(texts)))
    for n in (1, 7, 40):
        rows = shards.sharded(df, n).collect()
        size, order = {}, {}
        for t in texts:
            h = hashlib.sha256((t or "").encode()).digest()
            size[h] = size.get(h, 0) + len((t or "").encode()) + 16
        ends = brute_cuts([size[h] for h in sorted(size)], n)
        at, shard = 0, {}
        for h in sorted(size):
            at += size[h]
            shard[h] = sum(at > e for e in ends[:-1])
        for r in rows:
            t = (texts[r["id"]] or "").encode()
            assert r["shard"] == shard[hashlib.sha256(t).digest()] and r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
        for k in {r["shard"] for r in rows}:
            slots = sorted(r["slot"] for r in rows if r["shard"] == k)
            assert slots == list(range(len(slots)))


def test_cuts_are_refined_until_exact(spark, monkeypatch):
    monkeypatch.setattr(shards, "_STRETCHES", 400)
    sizes = [16 + (k * 7919) % 400 for k in range(3000)] + [9000]
    at, rows = 0, []
    for s in sizes:
        at += s
        rows.append((s, at))
    groups = spark.createDataFrame(rows, "bytes long, end long").cache()
    for n in (2, 5, 13):
        assert shards.cuts(groups, n) == brute_cuts(sizes, n)


def test_no_rows_and_null_ids(docs):
    assert shards.sharded(docs([])).collect() == []
    assert sorted(r["slot"] for r in shards.sharded(docs([(None, "a"), (None, "a"), (1, None), (1, "")]), 1).collect()) == [0, 1, 2, 3]
    assert fingerprint.edited(docs([])).collect() == []


def test_edited_texts_and_likeness(docs, prose):
    texts = ODD + [prose(k, 400) for k in range(60)] + [prose(1, 400)]
    rows = sorted(fingerprint.edited(docs([(3 * k, t) for k, t in enumerate(texts)])).collect(), key=lambda r: r["id"])
    prints = {}
    for k, r in enumerate(rows):
        t, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and (not t.split() or r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    near = [r["near_edited"] for r in rows[len(ODD):-2]]
    assert 0.4 < sum(near) / len(near) < 0.65 and sum(r["near_next"] for r in rows[len(ODD):-2]) / len(near) < 0.1


def test_next_row_with_ties_and_null_ids(docs):
    rows = [(1, "b"), (1, "a"), (None, "n"), (7, "c")]
    out = {r["fingerprint"]: r for r in fingerprint.edited(docs(rows)).collect()}
    assert len(out) == 4
    only = fingerprint.edited(docs([(4, "only one row")])).collect()[0]
    assert only["near_next"] == 1.0 and only["n_chars"] == 12


def test_fingerprints_merge(docs, prose):
    a, b = prose(1, 300), prose(2, 300)
    one, two = (set(r["fingerprint"].split(",")) for r in fingerprint.fingerprints(docs([(1, a), (2, b)])).orderBy("id").collect())
    seam = a.split()[-4:] + b.split()[:4]
    both = set(fingerprint.fingerprints(docs([(1, a + " " + b)])).collect()[0]["fingerprint"].split(","))
    assert one | two <= both and len(both - one - two) <= len(seam)
