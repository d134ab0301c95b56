"""The two operators that learn, and the pipeline."""
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import pii, quality
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.01"

PATTERNS = {  # as the contract has them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [*ODD, "a@b.c_d@e.f g@h x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111-1111 1111 4111111111111112",
         "call +1 (555) 123-4567, +49 30 1234567 89 or +12", "+1+1 555 123 4567+", "é日 joe@mail.example.com é 10.0.0.1", "1" * 60000, "a." * 30000 + "@",
         "1 " * 20000, "+1" + " " * 20000, "79927398713 4 " * 3, "a@b.c " * 300, "4012888888881881é4012888888881881"]


def test_base_spans_as_by_the_plain_patterns(docs):
    got = pii.detected(docs(list(enumerate(TEXTS))), pii.PiiModel(0.0, (), math.inf)).collect()
    for r in got:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == brute_spans(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert r["spans"] == r["base"]


def test_added_spans_keep_the_base_and_are_redacted(docs):
    rows = [(k, f"please call +1 (555) 123-{1000 + k} or mail me{k}@x.example.com from 10.1.1.{k}") for k in range(200)] + [(900 + k, t) for k, t in enumerate(TEXTS)]
    rows += [(1000, "please call 1 (555) 123-4567 now"), (1001, "in 1999 2000 2001 we")]
    df = docs(rows)
    model = pii.fit(df)
    assert model.trees and model == pii.fit(df)
    for r in pii.detected(df, model).collect():
        spans = [tuple(s) for s in r["spans"]]
        assert {tuple(s) for s in r["base"]} <= set(spans) and spans == sorted(spans)
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(df, model).collect()}
    assert texts[3] == "please call [PHONE] or mail [EMAIL] from [IP]" and texts[1001] == rows[-1][1] and texts[900] is None
    assert pii.redacted(df, model).columns == df.columns


def test_candidates_without_an_announcing_word_are_added(docs):
    rows = [(k, f"please call +1 (555) 123-{1000 + k} or mail me{k}@x.example.com, key = \"{10 ** (7 + k % 30)}\"") for k in range(200)]
    rows += [(1000, "reach me: joe7 [at] host [dot] com now"), (1001, "the number is (555) 123-4567"), (1002, "key = \"1234567890123\"")]
    model = pii.fit(docs(rows[:200]))
    added = {r["doc_id"]: r["text"] for r in pii.redacted(docs(rows), model).collect()}
    assert added[1000] == "reach me: [EMAIL] now" and added[1001] == "the number is [PHONE]"
    assert added[1002] == rows[-1][1] and all(added[k].endswith(rows[k][1].split(", ")[1]) for k in range(200))


def test_thresholds_hold_for_the_marginal_candidates():
    # many sure ones do not carry the poor ones below them, nor a score that no held-out candidate has
    assert pii._threshold([(5.0, 0, 1000), (2.0, 9, 1), (1.0, 0, 0)]) == pytest.approx(5.0, abs=1e-5)
    # one miss above hundreds of hits does not hide them; without evidence nothing is added
    assert pii._threshold([(6.0, 1, 0), (5.0, 0, 500), (1.0, 40, 0)]) == pytest.approx(5.0, abs=1e-5)
    assert pii._threshold([(5.0, 0, 0)]) == math.inf


def test_nothing_to_learn_from(docs):
    assert pii.fit(docs([])).trees == () and pii.fit(docs([(1, "plain words")])).trees == ()
    assert pii.detected(docs([]), pii.fit(docs([]))).collect() == []


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))


def test_held_out_documents_are_told_apart(spark, model):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = model.score(spark.read.parquet(f"{SMALL}/documents.parquet")).join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97 and min(good) >= 0.3


def test_scores_of_odd_texts(docs, model):
    got = model.score(docs(list(enumerate(ODD)) + [(0, "again")])).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got) and model.score(docs([])).collect() == []
    odd = {r["text"]: r["score"] for r in got}
    assert odd[None] == odd[""] == odd[" \n\t "] and got[0]["rep"] == 2


def test_held_out_labels_teach_nothing(spark, docs):
    rows = [(k, f"word{k % 7} text") for k in range(100)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    other = spark.createDataFrame([(k, 1 - k % 2 if zlib.crc32(str(k).encode()) % 5 == 0 else k % 2) for k, _ in rows], "doc_id long, quality int")
    assert (quality.fit(docs(rows), labels).weights == quality.fit(docs(rows), other).weights).all()
    none = quality.fit(docs(rows), labels.limit(0)).score(docs(rows[:2])).collect()
    assert [r["score"] for r in none] == [0.5, 0.5]


def test_pipeline_stage_by_stage(spark, docs, prose, tmp_path):
    import corpus_pipeline as pipeline
    item = prose(900, 20)
    rows = [(k, prose(k, 60)) for k in range(60)] + [(100 + k, "junk%%% ### | " * 30 + f"$$$ {k}") for k in range(40)]
    rows += [(200, prose(5, 60)), (201, prose(6, 59) + " end"), (202, f"{prose(70, 30)} {item}"), (203, prose(71, 40) + " me@x.example.com"), (204, None), (204, None), (205, ""), (None, prose(72, 30))]
    docs(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100)) for k, _ in rows if k is not None and k < 200], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, df = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = df.columns
    for name, stage in pipeline.STAGES:
        df = stage(spark, df, str(tmp_path)).cache()
        kept[name] = sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in df.collect()))
        assert name == "tokens" or df.columns == names
        if name == "personal_data":
            texts = {r["doc_id"]: r for r in df.collect()}
    assert not any(100 <= k < 140 for k in kept["quality"]) and set(range(60)) <= set(kept["quality"])
    assert set(kept["quality"]) - set(kept["near_duplicates"]) == {200, 201} and kept["near_duplicates"].count(204) == min(1, kept["quality"].count(204))
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {202}
    assert kept["decontamination"] == kept["personal_data"] == kept["tokens"]
    assert texts[203]["text"].endswith(" [EMAIL]") and texts[203]["n_chars"] == len(texts[203]["text"]) and texts[4]["text"] == prose(4, 60)
    whole = {r["doc_id"]: r["decoded_sha256"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(k if k is not None else -1 for k in whole) == sorted(set(kept["tokens"])) and whole.get(205, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(b"").hexdigest()


def test_pipeline_stages_keep_clashing_columns_and_take_empty_tables(spark, docs, prose, tmp_path):
    import corpus_pipeline as pipeline
    rows = [(k, prose(k, 40)) for k in range(20)] + [(50 + k, f"junk%%% ### {k}") for k in range(10)]
    spark.createDataFrame([(k, int(k < 50)) for k, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = docs(rows, extra=False).selectExpr("*", "doc_id * 2 AS _quality", "'mine' AS _OVERLAPS")
    for name, stage in pipeline.STAGES[:1] + pipeline.STAGES[2:3]:
        out = stage(spark, extra, str(tmp_path))
        assert out.columns == extra.columns, name
        assert all(r["_quality"] == 2 * r["doc_id"] and r["_OVERLAPS"] == "mine" for r in out.collect()), name
    empty = docs(rows, extra=False).limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "tokens" or out.columns == empty.columns), name
