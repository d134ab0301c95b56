"""Repeats, decontamination, encoding."""
import hashlib
import itertools
import random
import tracemalloc

import pyarrow as pa
import pytest

from tallyspark.llm import bpe, decontaminate, repeats
from tallyspark.llm.queries import tokenizer_file
from tests.llm.conftest import ODD


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_repeats_as_by_brute_force(docs, prose, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 3000)  # several stretches even here
    r = random.Random(2)
    passages = [prose(500 + k, n) for k, n in enumerate((12, 13, 14, 20, 30, 60))] + ["go " * 40, "a b " * 20, "x y y x " * 9]
    rows = [(k, t) for k, t in enumerate(ODD)]
    for k in range(150):
        parts = [prose(k, r.randrange(20))] + [x for _ in range(r.randrange(4)) for x in (r.choice(passages), prose(1000 + k, r.randrange(6)))]
        rows.append((1000 - k, " ".join(parts)))
    rows += [(2000 + k, rows[40][1]) for k in range(5)] + [(2100, "go " * 17), (2101, "b a " * 9)]
    found = sorted((x["id"], x["n_words"], x["n_removed"], x["text"]) for x in repeats.without_repeats(docs(rows)).collect())
    assert found == brute_repeats(rows)


def test_repeats_without_ids_or_rows(docs, prose):
    t = prose(3, 40)
    assert repeats.without_repeats(docs([])).collect() == []
    found = repeats.without_repeats(docs([(None, t), (4, t), (4, t), (5, t)])).collect()
    assert sorted((x["id"] or 0, x["n_removed"]) for x in found) == [(0, 0), (4, 0), (4, 0), (5, 40)]


def test_masks_meet_every_choice_of_substitutions():
    for gone in itertools.combinations(range(13), 3):
        assert any(all(s + m not in gone for m in mask) for mask in decontaminate.MASKS for s in range(13 - mask[-1]))


def brute_overlaps(rows, items):
    out = set()
    for i, t in rows:
        w = (t or "").lower().encode().split()
        for k, x in items:
            v = (x or "").lower().encode().split()
            n = min(13, len(v))
            if n and any(sum(v[a + j] == w[b + j] for j in range(n)) >= (10 if len(v) >= 13 else n)
                         for a in range(len(v) - n + 1) for b in range(len(w) - n + 1)):
                out.add((i, k))
    return out


def test_overlaps_as_by_brute_force(spark, docs, prose, monkeypatch):
    r = random.Random(4)
    items = [(k, prose(k, n)) for k, n in enumerate((1, 2, 4, 5, 8, 9, 12, 13, 14, 30, 30))] + [(20, None), (21, " "), (22, prose(9, 30)), (None, prose(77, 20))]
    rows = list(enumerate(ODD))
    for k in range(120):
        part = (r.choice(items)[1] or "").split()
        for _ in range(r.randrange(6)):
            if part:
                part[r.randrange(len(part))] = "sub"
        a = r.randrange(3)
        rows.append((100 + k, f"{prose(300 + k, 9)} {' '.join(part[a:]).upper() if k % 2 else ' '.join(part[a:])} {prose(400 + k, 5)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(rows, items)
    for block in (4 << 20, 200):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        found = decontaminate.overlaps(docs(rows), bench).collect()
        assert {(x["id"], x["item_id"]) for x in found} == want and len(found) == len(want)
    assert all(0 < x["matched"] <= x["words"] for x in found)


def test_copies_of_one_item_are_spread_over_blocks(spark, docs, prose, monkeypatch):
    real, sizes = decontaminate.Seeds.__init__, []
    monkeypatch.setattr(decontaminate.Seeds, "__init__", lambda self, ids, texts: (sizes.append(sum(map(len, texts))), real(self, ids, texts))[1])
    monkeypatch.setattr(decontaminate, "BLOCK", 2000)
    items = [(k, prose(1, 20)) for k in range(100)] + [(200, prose(2, 20))] * 100 + [(300 + k, prose(3 + k, 20)) for k in range(20)]
    found = decontaminate.overlaps(docs([(1, f"{prose(50, 9)} {prose(1, 20)}"), (2, prose(2, 20))]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x["id"], x["item_id"]) for x in found) == [(1, k) for k in range(100)] + [(2, 200)]
    assert len(sizes) > 2 and max(sizes) < 3 * 2000 and max(sizes) * 2 < sum(sizes)


def test_overlaps_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs([(1, "a b c")]), none).collect() == []
    assert decontaminate.overlaps(docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
    assert decontaminate.marked(docs([(1, "a")]), none).columns[-1] == "overlaps"


def test_encoding_as_the_library_does(docs, prose, monkeypatch):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_file())
    r = random.Random(6)
    texts = ODD + [prose(k, 50) for k in range(20)] + [
        "It's <|endoftext|>x<|startoftext|> <|endoftext|", "ÀÉÎ straße ΣΑΣ é ẛ̣ İI", "１２3 ½ ²", "don't we'll 'S  a b\u0085c", "a\x1cb",
        "".join(r.choice("enthiao") for _ in range(9000)), "ab" * 3000 + "<|endoftext|>" + "日本語" * 900 + "!" * 2500 + "9" * 1100, "a" * 4097 + " b",
        "é" * 2000, "́" * 5]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "again"), (None, "no id")]
    for leaf in (1024, 64):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        found = sorted(map(tuple, bpe.digests(docs(rows), tokenizer_file()).collect()), key=repr)
        want = []
        for k, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert found == sorted(want, key=repr)
    encoded = bpe.encode(docs(rows[:12]), tokenizer_file())
    assert all(x["text"] == library.decode(library.encode(dict(rows)[x["id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False)
               for x in bpe.decode(encoded, tokenizer_file()).collect() if x["id"] != 3)
    assert bpe.digests(docs([]), tokenizer_file()).collect() == []


def test_joins_of_any_cuts_agree_with_the_whole():
    encoder = bpe.Encoder.of(tokenizer_file())
    r = random.Random(8)
    for k in range(200):
        s = "".join(r.choice(["ab", "aeiouthn", "enthing", "abcdefghijklmnop"][k % 4]) for _ in range(1 + r.randrange(120)))
        n = r.choice((1, 3, 7, 20))
        leaves = [encoder.merge(s[i:i + n], i + n >= len(s)) for i in range(0, len(s), n)]
        assert encoder.tree(leaves) == encoder.merge(s, True)


def test_whole_texts_are_joined_from_leaves(prose, monkeypatch):
    from tokenizers import Tokenizer
    library, encoder, joined = Tokenizer.from_file(tokenizer_file()), bpe.Encoder(tokenizer_file()), []
    seam = encoder.seam
    monkeypatch.setattr(encoder, "seam", lambda a, b: (joined.append(a.open), seam(a, b))[1])
    monkeypatch.setattr(bpe, "LEAF", 40)
    texts = [prose(k, 60) for k in range(20)] + ["\u00e9\u4e2d " * 90, " " * 200 + "a" + " " * 200, "don't <|endoftext|>we'll " * 20, "x\u0301 y " * 50, "", " "]
    for t in texts:
        parts = [bpe.Part(words, encoder.each(words), is_open) for words, is_open in bpe.leaves(t.encode())]
        ids = b" ".join(filter(None, encoder.concatenated(parts).ids)).split() if parts else []
        assert [int(i) for i in ids] == library.encode(t, add_special_tokens=False).ids
    cuts = [is_open for t in texts for _, is_open in bpe.leaves(t.encode())[:-1]]
    assert sorted(joined) == sorted(cuts) and sum(cuts) > 50


def test_words_of_some_texts_are_held_at_a_time(prose, monkeypatch):
    texts = [None, "", *[prose(i, 300) for i in range(100)] * 20, "x" * 3000, "y" * 999 + " z"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    first = bpe._first(tokenizer_file(), True)
    plain = [r for b in first(iter([batch])) for r in b.to_pylist() if r["row"] is None]
    monkeypatch.setattr(bpe, "_TOGETHER", 5_000)
    assert [x for b in bpe.blocks(batch.column(1)) for x, _ in b] == [(t or "").encode() for t in texts]
    encoder = bpe.Encoder.of(tokenizer_file())
    assert not any((encoder.words, encoder.old_words, encoder.roots, encoder.old_roots))  # nothing stays with the worker
    tracemalloc.start()
    try:
        again = [r for b in first(iter([batch])) for r in b.to_pylist() if r["row"] is None]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert again == plain and len(plain) == len(texts) - 1
    assert peak < 12_000_000  # the words of all texts: 600,000, over 20 MB


def test_vocabularies_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="lower-case words"):
        bpe.Encoder(tokenizer_file("byte_bpe_50k.json"))
