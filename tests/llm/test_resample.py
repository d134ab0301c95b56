"""Importance resampling."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyspark.llm import resample
from tests.llm.conftest import ODD

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return len(words), [b" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(rows, target, buckets, percent, least, seed):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                held[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out, n = [], 0
    for i, x in rows:
        words, some = features(x)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in some)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        n += words >= least
        out.append([i, words, len(some), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[:n * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def found(df):
    return sorted(((r["id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("buckets,percent", [(10_000, 5), (97, 60)])
def test_draw_as_by_brute_force(spark, docs, prose, buckets, percent, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 700)  # texts in several parts
    r = random.Random(3)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, prose(k, r.randrange(60)).upper() if k % 3 else prose(k % 7, 30)) for k in range(200)]
    rows += [(None, prose(1, 40)), (150, rows[60][1]), (150, rows[60][1]), (7000, "é" * 60 + "-日本x " * 300 + "A1b" * 30), (7001, "x\x00y\x7fz {q} [R] `s`" * 9)]
    target = [None, "", *[prose(900 + k, 50, 40) for k in range(20)]]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = resample.resampled(docs(rows), bench, buckets=buckets, percent=percent)
    assert found(out) == brute(rows, target, buckets, percent, 20, 42)


def test_nothing_to_draw_from(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resampled(docs([]), none).collect() == []
    rows = [(1, "a " * 30), (2, "b c " * 40), (3, None)]
    assert found(resample.resampled(docs(rows), none, percent=50)) == brute(rows, [], 10_000, 50, 20, 42)


def test_drawn_rows_keep_their_columns(spark, docs, prose):
    rows = [(k, prose(k, 40)) for k in range(40)]
    bench = spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string")
    out = resample.drawn(docs(rows), bench, percent=25)
    assert out.columns == docs(rows).columns and out.count() == 10
    assert 3 in {r["doc_id"] for r in out.collect()}  # the text that is the target


def test_crcs_of_parts_make_the_whole():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 48, 49, 300):
        a, b = bytes(r.randrange(256) for _ in range(9)), bytes(r.randrange(256) for _ in range(n))
        got = resample.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)
