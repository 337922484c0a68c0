"""Language identification: held-out accuracy, mixed texts, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from release_guard.llm import queries
from release_guard.llm.language import Labeller, Model, identify, learn, scripts


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_accuracy(spark, sf_dir):
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op7_language(spark, sf_dir).collect()
    assert len(found) == len(given)
    right = []
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and any(c.isalpha() for c in given[r["doc_id"]]["text"] or ""):
            right.append(r["lang_pred"] == given[r["doc_id"]]["lang"])
    assert len(right) > 20 and np.mean(right) > 0.97


def test_spans_of_mixed_text(spark, frame, model):
    english, german = "the thing that was not in the end of the nation and this ", "nicht auch einer Zeit und die schlicht werden ist das "
    df = frame([(1, english * 3 + german * 3), (2, german * 4), (3, None), (4, "12 .. !"), (5, ""), (None, german)])
    found = {r["doc_id"]: r for r in identify(df, model, spans=True).collect()}
    assert [s["lang"] for s in found[1]["spans"]] == ["en", "de"]
    cut = found[1]["spans"][0]["end"]
    assert abs(cut - len(english) * 3) < 30
    assert (found[2]["lang_pred"], found[2]["score"]) == ("de", 1.0) and found[None]["lang_pred"] == "de"
    for odd in (3, 4, 5):
        assert (found[odd]["lang_pred"], found[odd]["score"], found[odd]["spans"]) == ("und", 0.0, [])
    assert set(df.columns) <= set(identify(df, model).columns) and identify(frame([]), model).count() == 0


def test_no_rows_to_learn_from(frame):
    empty = learn(frame([(1, None)]))
    assert empty.languages == []
    assert [(r["lang_pred"], r["score"]) for r in identify(frame([(1, "text"), (2, None)]), empty).collect()] == [("und", 0.0)] * 2


def test_scripts_narrow_the_candidates(spark, frame):
    rows = [("это просто русский текст и ещё слова",), ("das ist nur ein deutscher Text und noch Worte",)]
    known = spark.createDataFrame([(rows[0][0] * 5, "ru"), (rows[1][0] * 5, "de")], "text string, lang string")
    found = learn(known)
    got = [r["lang_pred"] for r in identify(spark.createDataFrame([("шбнъ",), ("xqzw",), ("漢字",)], "text string"), found).collect()]
    assert got[:2] == ["ru", "de"] and got[2] in ("ru", "de")
    assert scripts(np.array([0x41, 0x3B1, 0x416, 0x4E00, 0xAC00, 0xE9])).tolist()[0] == 0


def best_path(scores, penalty):
    n, k = scores.shape
    best, came = scores[0].copy(), []
    for i in range(1, n):
        options = best[:, None] - penalty * (1 - np.eye(k))
        came.append(options.argmax(axis=0))
        best = options.max(axis=0) + scores[i]
    return best.max()


def value(labels, scores, penalty):
    return scores[np.arange(len(labels)), labels].sum() - penalty * np.count_nonzero(np.diff(labels))


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(0)
    labeller = Labeller(Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.ones((1, 3), bool)), 2.0)
    counts = np.array([5, 0, 1, 9, 9, 2, 0, 30])
    scores = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32)
    labels = labeller.viterbi(scores, counts)
    at = 0
    for n in counts:
        if n:
            own = scores[at : at + n]
            assert value(labels[at : at + n], own, 2.0) == pytest.approx(best_path(own, 2.0), abs=1e-4)
        at += n
