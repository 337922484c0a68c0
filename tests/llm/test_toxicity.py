"""Toxicity: held-out accuracy, segments against their definition, odd rows."""

from __future__ import annotations

import zlib
from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from release_guard.llm import queries
from release_guard.llm.toxicity import (
    Calibration, calibrate, evidence, learn_lexicon, maximal_segments, passage_places, score_passages, score_texts, significant,
)

CLEAN = ["the sun is out and we walk", "a quiet day by the sea", "we read old books at home", "rain falls on the green hills"]
RUDE = ["you stupid awful fool", "what a stupid liar", "awful stupid nonsense you fool"]


@pytest.fixture
def labelled(spark):
    rows = [(f"{CLEAN[i % 4]} {i} {CLEAN[(i * 7) % 4]}", 0) for i in range(200)]
    rows += [(f"{CLEAN[i % 4]} {RUDE[i % 3]} {i} {CLEAN[(i * 3) % 4]}", 1) for i in range(60)]
    return spark.createDataFrame(rows, "text string, toxic int")


def by_definition(scores):
    """Maximal segments: the best one, then the same left and right of it."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])

    def go(a, b):
        best = max(((sums[j] - sums[i], i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        return [*go(a, best[1]), (best[1], best[2]), *go(best[2], b)]

    return go(0, len(scores))


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.normal(-0.3, 1, rng.integers(0, 30))
        found = maximal_segments(scores)
        assert [s[:2] for s in found] == by_definition(scores)
        assert all(v == pytest.approx(scores[a:b].sum()) for a, b, v in found)
    assert maximal_segments(np.array([])) == [] and maximal_segments(np.array([-1.0, 0.0])) == []


def test_segments_take_linear_time():
    # Ever lower starts make the search for an earlier segment walk back, ever higher ends make it join.
    n = 200_000
    saw = np.tile([1.0, -1.5], n)
    assert len(maximal_segments(saw)) == n
    assert maximal_segments(np.concatenate([np.tile([1.0, -0.5], n), [1.0]]))[0][:2] == (0, 2 * n + 1)


def test_passages_and_places(spark, labelled):
    lexicon = learn_lexicon(labelled)
    text = "The sun is out. You STUPID awful fool! A quiet day by the sea"
    df = spark.createDataFrame([(1, text), (2, "we read books"), (3, "stupidly awfully")], "id int, text string")
    found = {r["id"]: r for r in score_passages(df, lexicon).collect()}
    (passage,) = [p for p in found[1]["passages"] if p["score"] > 2]
    ((start, end),) = passage_places(text, [(passage["start"], passage["end"])])
    assert "STUPID awful fool" in text[start:end] and "sun" not in text[start:end] and "quiet" not in text[start:end]
    assert not any(p["score"] > 1 for p in found[2]["passages"]) and found[2]["n_words"] == 3
    # Forms that were never seen take the rate of their first characters.
    assert sum(p["score"] for p in found[3]["passages"]) > 1


def test_score_and_significance(spark, labelled):
    lexicon = learn_lexicon(labelled)
    scored = score_passages(labelled, lexicon)
    calibration = calibrate(scored)
    found = score_texts(labelled.withColumn("score", F.lit(9)), lexicon, calibration).collect()
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["toxic"] == 1) for r in found)
    kept = significant(scored, calibration).select("toxic", F.size("passages").alias("n")).collect()
    assert all((r["n"] > 0) == (r["toxic"] == 1) for r in kept)


def test_copies_teach_once(spark, labelled):
    copies = labelled.union(spark.createDataFrame([("the sun is out and rain falls", 1)] * 500, "text string, toxic int"))
    assert learn_lexicon(copies).score("rain") < 0


def test_evidence_grows_with_score_and_falls_with_length():
    assert evidence(100, [5.0], 1, 0.1) > evidence(100, [4.0], 1, 0.1) > evidence(1000, [4.0], 1, 0.1)
    assert evidence(100, [9.0, 9.0], 1, 0.1) > evidence(100, [9.0], 1, 0.1) > evidence(100, [], 1, 0.1)
    one = evidence(100, [8.0], 1.2, 0.1)
    assert exp(-one) == pytest.approx(0.1 * 100 * exp(-1.2 * 8.0))


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = queries.op11_segment_toxicity(spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["score"], toxic[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in toxic]
    rude, clean = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    above = np.mean([(a > b) + (a == b) / 2 for a in rude for b in clean])
    assert above > 0.95 and np.mean(np.array(clean) < 0.5) > 0.98


def test_odd_rows(spark, frame, odd_rows, labelled):
    lexicon = learn_lexicon(labelled)
    rows = [*odd_rows, (1, "stupid " * 100_000), (2, "x" * 200_000)]
    df = frame(rows).withColumn("passages", F.lit(1)).withColumn("evidence", F.lit(2)).withColumn("bin", F.lit(3))
    scored = score_passages(df, lexicon)
    found = score_texts(df.withColumn("score", F.lit("x")), lexicon, Calibration(1.0, 0.1, -2.0, 0.3)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    words = {r["doc_id"]: r["n_words"] for r in scored.collect()}
    assert (words[1000], words[1001], words[1]) == (0, 0, 100_000)
    assert score_passages(frame([]), lexicon).count() == 0


def test_no_labels(spark, labelled, frame):
    assert learn_lexicon(labelled.where("toxic = 0")) is None and learn_lexicon(labelled.limit(0)) is None
    odd = spark.createDataFrame([(None, 1), ("a b", None), ("a", 7)], "text string, toxic int")
    assert learn_lexicon(odd) is None
    assert score_passages(frame([(1, "you stupid")]), None).first()["passages"] == []
    found = score_texts(frame([(1, "you stupid")]), None, None).collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(1, 0.0)]
    lexicon = learn_lexicon(labelled)
    empty = calibrate(score_passages(labelled.limit(0), lexicon))
    assert 0 <= score_texts(frame([(1, "stupid")]), lexicon, empty).first()["score"] <= 1
