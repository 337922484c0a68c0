"""Top-k search and repeated substrings against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from release_guard.llm import queries, topk
from release_guard.llm.substrings import PART, _runs, without_repeats


def best(rows, wanted, k):
    """rows and wanted: (id, vector); the contract, pair by pair."""
    def whole(pairs):
        good = {
            (i, tuple(math.floor(256 * float(np.float32(x))) for x in v))
            for i, v in pairs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
        }
        return sorted(good)

    found = []
    by_query = defaultdict(dict)
    for q, x in whole(wanted):
        for i, y in whole(rows):
            if i != q and len(x) == len(y):
                score = sum(a * b for a, b in zip(x, y, strict=True))
                by_query[q][i] = max(score, by_query[q].get(i, score))
    for q, scores in by_query.items():
        top = sorted((-s, i) for i, s in scores.items())[:k]
        found += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(top)]
    return sorted(found)


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "STRETCH", 2)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(9)]  # ties
    rows += [rows[0], (0, [0.5] * 6), (300, None), (301, []), (302, [None] * 6), (303, [math.nan] * 6), (304, [math.inf] * 6)]
    rows += [(305, [0.0] * 6), (306, [0.1, 0.2]), (307, [0.3, -0.2]), (None, [0.1] * 6), (308, [1e3] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 as score", "2 as rank", "3 as dims", "4 as v")
    found = topk.top_k(df, df.where("vec_id % 5 = 0"), 5).collect()
    assert sorted(map(tuple, found)) == best(rows, [r for r in rows if r[0] is not None and r[0] % 5 == 0], 5)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_search_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(0)
    vectors = rng.integers(0, 50, (5000, 3))
    vectors[7] = [500, 500, 500]
    lists = topk.SortedLists(np.arange(5000), vectors)
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                looked.append(len(key))
            return np.asarray(super().__getitem__(key))

    lists.vectors = lists.vectors.view(Counted)
    ids, _ = lists.search(-1, np.array([1, 1, 1]), 1)
    assert ids.tolist() == [7] and sum(looked) < 2500


def test_top_k_query(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.op3_threshold_top_k(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == best(rows, [r for r in rows if r[0] % 50 == 0], 5)


def cut(rows, length):
    """The contract on bytes: every place of every string."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    found = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        found.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return found


def compare(frame, rows, length, gram, part=PART):
    found = [tuple(r) for r in without_repeats(frame(rows), length, gram, part_size=part).collect()]
    assert Counter(found) == Counter(cut(rows, length))


@pytest.mark.parametrize("length,gram,part", [(16, 4, 1 << 18), (24, 6, 40), (40, 20, 64)])
def test_short_strings(frame, length, gram, part):
    rng = random.Random(length)

    def text(n):
        return "".join(rng.choices("abé ", k=n))

    common = [text(length), text(length + 9), text(3 * length), text(length - 1)]
    rows = [(i, "".join(rng.choice([text(rng.randint(0, 30)), rng.choice(common), rng.choice(common)[3:]]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100, "a" * 200), (101, "ab" * 90), (102, None), (103, ""), (104, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    compare(frame, rows, length, gram, part)


def test_periodic_texts(frame):
    rng = random.Random(7)
    line = "".join(rng.choices("abcdefgh ", k=61)) + "\n"
    long = "".join(rng.choices("xyz", k=300))
    rows = [
        (1, "a" * 5000), (2, "a" * 199), (3, "a" * 200), (4, "b" * 201), (5, "ab" * 900 + "x" + "ab" * 400), (6, line * 60), (7, "z" + line * 7 + "z"),
        (8, long * 5), (9, long[7:] + long[:9]), (10, "c" * 400 + "d" * 400 + "c" * 250), (11, " " * 3000), (12, " " * 210 + "e" + " " * 205), (13, "f" * 260),
    ]
    compare(frame, rows, 200, 50)
    compare(frame, rows, 40, 20, 64)
    compare(frame, rows[:1], 200, 50)


def test_periodic_text_makes_few_rows(spark):
    for unit in ("a", " ", "ab\n", "a line of a log that comes again and again, without any end\n"):
        df = spark.range(1).select(F.lit(1).cast("long").alias("doc"), F.repeat(F.lit(unit), 1_000_000 // len(unit)).alias("text"))
        df = df.select("doc", F.col("text").cast("binary").alias("text"))
        rows = _runs(df, 200, 50, PART)
        assert rows.count() <= 4 * (2 * len(unit) + 2)
        (whole,) = without_repeats(df.select(F.col("doc").alias("doc_id"), F.col("text").cast("string").alias("text"))).collect()
        assert whole["n_bytes"] == whole["n_removed"] and whole["n_spans"] == 1


def test_whole_documents(frame, documents, odd_rows):
    compare(frame, documents + odd_rows, 200, 50)


def test_kept_bytes_and_empty_table(frame):
    rows = [(1, "x" * 10 + "abcdefghijklmnopqrstuvwxyz"), (2, "abcdefghijklmnopqrstuvwxyz!"), (3, "short")]
    found = {r["doc_id"]: bytes(r["kept"]) for r in without_repeats(frame(rows), 20, 8, keep_bytes=True).collect()}
    assert found == {1: b"xxxxxxxxxx", 2: b"!", 3: b"short"}
    assert without_repeats(frame([]), 20, 8).count() == 0
