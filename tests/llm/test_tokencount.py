"""Token counts of prefixes."""
import random

import pytest

from pyspark.sql import functions as F

from tallyspark.llm import tokencount
from tallyspark.llm.queries import tokenizer_file
from tests.llm.conftest import ODD

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    out = Tokenizer.from_file(tokenizer_file(FILE))
    return lambda text: len(out.encode(text, add_special_tokens=False).ids)


TRICKY = ["a  b", "\n\n  x", "tab\t\tx \t y z　 q", "don't we'll they're 's ''s 'S 'tis I've'd 'l 'r'e 'v e", " 're '", "x<|endoftext|>y", "  <|endoftext|>  <|endoftext|> <|endof",
          "<|endoftext|><|endoftext|>", "<|endoftext|", "1２3 ½ ²x ٣", "naïve ÀÉ ẛ̣ Σ é ́́ b", "🙂🙂 👩‍👩‍👧 x", "=" * 200 + "-" * 70, " " * 90 + "x", "\r\n\r\n\r\nq", "\x1c\x85 a\x00b﻿",
          "日本語 テキスト、です。", "antidisestablishmentarianism" * 8]


def test_counts_as_by_the_library(docs, prose, library, monkeypatch):
    r = random.Random(7)
    texts = ODD + TRICKY + [prose(k, 30) for k in range(20)] + ["".join(r.choice("ab '\n .<|1étsrel") for _ in range(r.randrange(200))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id")]
    want = sorted(((k, len((t or "").encode()), library(t or "")) for k, t in rows), key=repr)
    for piece, remembered in ((1 << 20, 150_000), (100, 5)):
        monkeypatch.setattr(tokencount, "PIECE", piece)
        monkeypatch.setattr(tokencount, "REMEMBERED", remembered)
        found = tokencount.counted(docs(rows), tokenizer_file(FILE), limit=10).collect()
        assert sorted(((x["id"], x["n_bytes"], x["n_tokens"]) for x in found), key=repr) == want
    one = {x["id"]: x for x in found if x["id"] not in (None, 3)}
    for k, t in rows[:80]:
        if k != 3:
            t = t or ""
            best = len(t) if library(t) <= 10 else max(p for p in range(len(t) + 1) if library(t[:p]) <= 10)
            assert (one[k]["n_chars"], one[k]["kept_chars"]) == (len(t), best)


def test_every_prefix_as_a_text_by_itself(docs, prose, library):
    r = random.Random(8)
    texts = TRICKY + [t for t in ODD if t and len(t) < 2000] + ["".join(r.choice("ab '\n .<|1étsrel") for _ in range(60)) for _ in range(60)] + [prose(5, 60)]
    store = tokencount.prefix_counts(docs(list(enumerate(texts))), tokenizer_file(FILE))
    for x in store.collect():
        t = texts[x["id"]]
        assert x["counts"] == [library(t[:p]) for p in range(len(t) + 1)], t
    asked = store.select("id", tokencount.tokens_of(F.col("counts"), F.lit(7)).alias("seven"), tokencount.longest_within(F.col("counts"), F.lit(4)).alias("four"))
    for x in asked.collect():
        t = texts[x["id"]]
        assert x["seven"] == library(t[:7]) and x["four"] == max(p for p in range(len(t) + 1) if library(t[:p]) <= 4)


def test_no_rows_and_other_files(docs):
    assert tokencount.counted(docs([]), tokenizer_file(FILE)).collect() == []
    with pytest.raises(ValueError):
        tokencount.Counter(tokenizer_file("word_bpe_49k.json"))
