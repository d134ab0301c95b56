import hashlib
import random
from pathlib import Path

import pytest

from tallyspark.llm import chat, warc


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_conversations_come_back(spark, limit):
    r = random.Random(1)
    words = ["hi", "<|im_end|>", "<\\|x", "<|im_start|>assistant\nno", "\\", "", "été\n", "<\\\\|", None]
    rows = []
    for c in [*range(60), None]:
        n = r.choice((1, 2, 3, 5)) if c is not None else 2
        for t in range(n):
            text = words[0] if t == 0 and r.random() < 0.7 else r.choice(words) if r.random() < 0.5 else f"{t}{r.choice(words)}"
            rows.append((c, t, r.choice(["assistant", "us\\ner\n", None]) if t % 2 else "user", text, "extra"))
    rows += [(100, 1, "assistant", "same turn number b", "x"), (100, 1, "assistant", "same turn number a", "x"), (100, None, "user", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf string")
    packs, ends = chat.packs(df, limit)
    got = {x["conv"]: x for x in chat.read_back(packs, ends).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r_, t in turns if r_ == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat.formatted(a, b)[0]) for a, b in turns)
    for p in packs.collect():  # shared turns once, positions and attention as along the path alone
        seen = set()
        for n in p["nodes"]:
            path, up = [], n["parent"]
            while up >= 0:
                path.append(p["nodes"][up])
                up = p["nodes"][up]["parent"]
            assert n["position"] == sum(x["end"] - x["start"] for x in path)
            assert {k for a in n["attend"] for k in range(a["start"], a["end"])} == {k for x in path for k in range(x["start"], x["end"])}
            key = (n["parent"], p["text"][n["start"]:n["end"]])
            assert key not in seen
            seen.add(key)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(*chat.packs(none)).collect() == []


@pytest.fixture
def archive(spark, tmp_path):
    def make(rows, **options):
        df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
        return warc.archived(df.coalesce(1), f"file://{tmp_path}/warc", **options)

    return make


def records(df):
    return [r for r in sorted(warc.read(df).collect(), key=lambda r: r["at"])]


def test_pages_come_back(archive):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/é b", big, "x"), (7, None, big, "x"), (None, "u\r\nWARC/1.1\r\n", big, "x"), (3, "u", None, "x"), (4, "u", "", "x"), (5, "u", "small", "x"),
            (6, "u", "small", "x"), (8, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n\x1f", "x"), (7, None, big, "x")]
    got = records(archive(rows))
    assert {r["kind"] for r in got} == {"record"} and len(got) == len(rows)
    for r, (page, _, html, _) in zip(sorted(got, key=lambda r: (r["page_id"] or 0, r["at"])), sorted(rows, key=lambda r: r[0] or 0)):
        data = (html or "").encode()
        assert (r["page_id"], r["size"], r["digest"]) == (page, len(data), hashlib.sha1(data).hexdigest())
        assert (r["type"], r["refers_to"]) == (("revisit", 7) if html == big and page != 7 else ("response", None))
        assert r["type"] == "revisit" or r["payload"] == data
    assert warc.read(archive([])).collect() == []


def test_damage_costs_only_what_it_touches(archive):
    rows = [(k, "u", f"page {k} " + "text " * (300 + k), "x") for k in range(20)]
    files = archive(rows)
    path = Path(files.first()["file"].removeprefix("file://"))
    whole, at = path.read_bytes(), {r["page_id"]: (r["at"], r["length"]) for r in records(files)}
    a, n = at[4]
    cases = {
        "one byte": whole[:a + n // 2] + bytes([whole[a + n // 2] ^ 85]) + whole[a + n // 2 + 1:],
        "magic gone": whole[:a] + b"xxx" + whole[a + 3:],
        "cut out": whole[:a + 20] + whole[a + n:],
        "noise before": whole[:a] + b"\x1f\x8b\x08 noise WARC/1.1\r\n" + whole[a + n:],
    }
    for name, data in cases.items():
        path.write_bytes(data)
        got = records(files)
        assert {r["page_id"] for r in got if r["kind"] == "record"} == set(range(20)) - {4}, name
        gaps = [r for r in got if r["kind"] == "gap"]
        assert len(gaps) == 1 and gaps[0]["at"] == a and gaps[0]["reason"] and gaps[0]["length"] == len(data) - len(whole) + n, name
    path.write_bytes(whole[:a + n - 5])
    got = records(files)
    assert {r["page_id"] for r in got if r["kind"] == "record"} == {k for k, x in at.items() if x[0] < a} and got[-1]["kind"] == "gap"


def test_bare_records_with_a_wrong_length_or_digest(spark, tmp_path):
    def bare(k, html):
        data = html.encode()
        return warc.record(k, "u", data, hashlib.sha1(data).hexdigest(), len(data), None)

    good = [bare(k, f"WARC/1.1\r\n page {k}") for k in range(5)]
    bad = good[2].replace(b"Content-Length: ", b"Content-Length: 9")
    other = good[2].replace(b"page 2", b"page X")
    for name, middle in (("long", bad), ("digest", other), ("header", b"WARC/1.1\r\nno colon here\r\n\r\n")):
        path = tmp_path / f"{name}.warc"
        path.write_bytes(b"".join([*good[:2], middle, *good[3:]]))
        got = records(spark.createDataFrame([(f"file://{path}",)], "file string"))
        assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 1, 3, 4], name
        assert [(r["at"], r["length"]) for r in got if r["kind"] == "gap"] == [(len(good[0] + good[1]), len(middle))], name


def test_several_records_in_a_member_and_long_headers(spark, tmp_path):
    import gzip

    def bare(k, url="u"):
        data = f"page {k}".encode()
        return warc.record(k, url, data, hashlib.sha1(data).hexdigest(), len(data), None)

    bad = bare(7).replace(b"page 7", b"page X")
    members = [gzip.compress(bare(0) + bare(1) + bad + bare(2)), gzip.compress(bare(3))]
    path = tmp_path / "several.warc"
    path.write_bytes(members[0] + bare(4, "http://a/" + "x" * 200_000) + members[1])
    got = warc.read(spark.createDataFrame([(f"file://{path}",)], "file string")).collect()
    assert sorted(r["page_id"] for r in got if r["kind"] == "record") == [0, 1, 2, 3, 4]
    (gap,) = [r for r in got if r["kind"] == "gap"]
    assert (gap["at"], gap["length"]) == (0, len(members[0])) and "another digest" in gap["reason"]


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    names = []
    for k in range(6):
        data = f"page {k}".encode()
        (tmp_path / f"{k}.warc").write_bytes(warc.record(k, "u", data, hashlib.sha1(data).hexdigest(), len(data), None))
        names.append((f"file://{tmp_path}/{k}.warc",))
    found = warc.read(spark.createDataFrame(names, "file string"))
    assert found.rdd.getNumPartitions() > 1 and sorted(r["page_id"] for r in found.collect()) == [*range(6)]
