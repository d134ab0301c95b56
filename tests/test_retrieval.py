import hashlib
import math
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyspark.operators import retrieval


def chunk_by_hand(text, size, overlap, least):
    """The same packing, written as a loop."""
    done, held, length = [], "", 0

    def close():
        if len(held.strip()) >= least:
            done.append(held.strip())

    for p in (x.strip() for x in re.split(r"\n\s*\n+", text)):
        if not p:
            continue
        if len(p) > size:
            close()
            held, length = "", 0
            done += [w for w in (p[i:i + size] for i in range(0, len(p), size - overlap)) if len(w) >= least]
        elif held and length + len(p) > size:
            close()
            tail = held[-overlap:]
            held, length = f"{tail}\n\n{p}", len(tail) + len(p)
        else:
            held, length = (f"{held}\n\n{p}" if held else p), length + len(p)
    close()
    return done


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("x" * rng.randint(1, 90) + str(i) for i in range(rng.randint(1, 12))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = retrieval.chunk_texts(df, "id", size=60, overlap=10, least=5).collect()
    for i, t in enumerate(texts):
        mine = [r["text"] for r in sorted((r for r in out if r["dataset_id"] == str(i)), key=lambda r: r["position"])]
        assert mine == chunk_by_hand(t, 60, 10, 5)


def test_positions_run_through_the_units(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_UNITS_PER_BLOCK", 2)  # several blocks
    units = spark.createDataFrame([("d", 1, "p1", "a" * 90), ("d", 2, "p2", "b" * 30)],
                                  "dataset_id string, unit int, locator string, text string")
    out = retrieval.chunk(units, size=50, overlap=10, least=5).orderBy("position")
    assert rows(out, "chunk_id", "locator") == [("d_c00001", "p1"), ("d_c00002", "p1"), ("d_c00003", "p1"),
                                                ("d_c00004", "p2")]


TEXTS = {"a": "Revenue grew in the north region", "b": "Costs fell while revenue was flat; revenue!", "c": "Nothing here",
         "d": ""}


def test_bm25_against_the_formula(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string")
    got = dict(rows(retrieval.bm25(df, "Revenue in the north")))
    toks = {k: re.findall(r"[a-z0-9']+", v.lower()) for k, v in TEXTS.items()}
    mean = sum(map(len, toks.values())) / len(toks)
    want = {}
    for k, t in toks.items():
        score = 0.0
        for term in {"revenue", "in", "the", "north"}:
            df_, tf = sum(term in x for x in toks.values()), t.count(term)
            if tf:
                score += math.log(1 + (4 - df_ + 0.5) / (df_ + 0.5)) * tf * 2.5 / (
                    tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
        if score:
            want[k] = score
    assert got == pytest.approx(want)
    assert retrieval.bm25(df, "?!").count() == 0


def test_embedding_against_the_definition(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string")
    for dims in (256, 100):
        for key, vector in rows(retrieval.embed(df, dimensions=dims)):
            v = [0.0] * dims
            for word in re.sub(r"[^a-z0-9]", " ", TEXTS[key].lower()).split():
                p = f"#{word}#"
                for i in range(len(p) - 2):
                    d = hashlib.md5(p[i:i + 3].encode()).digest()
                    v[int.from_bytes(d[:4], "little") % dims] += 1 if d[4] % 2 == 0 else -1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            assert vector == pytest.approx([x / norm for x in v])


def test_cosine_and_normalizing(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", [1.0])],
                               "chunk_id string, embedding array<double>")
    got = dict(rows(retrieval.cosine(df, [2.0, 0.0])))
    assert got == pytest.approx({"a": 1.0, "b": 0.0, "c": math.sqrt(0.5)})
    flat = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "chunk_id string, score double")
    assert dict(rows(retrieval.normalized(flat))) == {"a": 1.0, "b": 1.0}
    both = retrieval.hybrid(flat.where("chunk_id = 'a'"), retrieval.cosine(df, [2.0, 0.0])).collect()
    assert {r["chunk_id"]: r["score"] for r in both}["a"] == pytest.approx(1.0)


@pytest.fixture
def evidence(spark):
    return spark.createDataFrame([("c1", "Revenue grew 12% reaching $500,000 total.")], "chunk_id string, text string")


def test_number_gate(spark, evidence):
    claims = spark.createDataFrame([(1, "It reached $500000.", ["c1"]), (2, "It grew 12%.", ["c1"]), (3, "It grew 13%.", ["c1"]),
                                    (4, "It grew 12%.", ["c2"]), (5, "No number.", ["c1"])],
                                   "claim_id int, text string, evidence array<string>")
    got = {r["claim_id"]: r["passed"] for r in retrieval.number_gate(claims, evidence).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_citation_gate(spark, evidence):
    claims = spark.createDataFrame([(1, "ok", ["c1"]), (2, "ok", []), (3, "ok", ["c1", "cX"]), (4, " ", ["c1"]), (5, "ok", None)],
                                   "claim_id int, text string, evidence array<string>")
    got = {r["claim_id"]: r["accepted"] for r in retrieval.citation_gate(claims, evidence).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_answers_and_narratives(spark, evidence):
    assert rows(retrieval.extractive_answer(evidence, "What was the revenue total?"), "overlap") == [(2,)]
    assert retrieval.extractive_answer(evidence, "Who is it for?").count() == 0
    told = spark.createDataFrame([("It was 500000 and 7.",)], "text string")
    assert rows(retrieval.unverified_numbers(told, evidence.select(F.col("text").alias("fact")))) == [("7",)]
    assert retrieval.corpus_mode(evidence).first()["mode"] == "whole"
