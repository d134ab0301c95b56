from pathlib import Path

import numpy as np
import pyarrow as pa

from tallyspark.llm import bpe, neardup, quality
from tallyspark.llm.shared import frugal
from tallyspark.llm.words import grams, pieces, shingles
from tests.llm.conftest import ODD


def test_words_are_runs_other_than_ascii_white_space():
    for lo, hi, w in pieces(pa.array(ODD)):
        found = [[w.data[a:b].tobytes() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
        assert found == [(t or "").encode().split() for t in ODD[lo:hi]]


def test_hashes_tell_words_apart_and_lower_only_a_to_z():
    (_, _, w), = pieces(pa.array(["Ab aB ab ÀB àb b a"]))
    plain, lower = w.hashes(), w.hashes(lower=True)
    assert len(set(plain.tolist())) == 7
    assert lower[0] == lower[1] == lower[2] and lower[3] != lower[4]


def test_shingles_and_sliced_columns(prose):
    texts = [prose(k, n) for k, n in enumerate((0, 1, 4, 5, 6, 40))]
    (_, _, w), = pieces(pa.array(["skipped", *texts]).slice(1))
    sizes = [len({tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))}) if t.split() else 0 for t in texts]
    assert [len(s) for s in shingles(w, w.hashes())] == sizes
    h = np.arange(9, dtype=np.uint64)
    assert (grams(h, 3) == grams(h, 0, (0, 1, 2))).all() and len(grams(h[:1], 3)) == 0


def test_only_some_rows_of_a_column_are_copied():
    column = pa.array([None, *["word " * 200] * 4000])  # 4 MB, copied to fill the null
    before = pa.total_allocated_bytes()
    assert max(pa.total_allocated_bytes() - before for _ in pieces(column)) < 1 << 20


def test_a_task_gives_its_memory_back():
    def held() -> int:
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    kept = []

    def work(batches):
        for batch in batches:
            some = [bytes(100_000) + b"x" for _ in range(1000)]  # 100 MB of blocks that the allocator keeps
            kept.append(some.pop())  # behind the others
            del some
            yield batch

    before = held()
    assert list(frugal(work)(iter([1]))) == [1]
    assert held() - before < 30 << 20


def test_tasks_of_the_corpus_give_their_memory_back():
    for task in (neardup._sketch_batches, neardup._verify_batches, neardup._shingle_rows, quality._vectors, bpe._first("", True)):
        assert task.__code__ is frugal(task).__code__
