"""Benchmark items in documents: as they are, in other capitals, with other numbers and names."""

from __future__ import annotations

import re

import pytest

from release_guard.llm import queries
from release_guard.llm.decontamination import contaminated

ITEM = "A train leaves Boston at 40 mph and another leaves Denver at 60 mph; when the first train has gone 120 miles, how far is Boston?"
FILLER = "some words that stand around the passage and have nothing to do with any question at all"


@pytest.fixture
def tables(spark, frame):
    def make(texts, items):
        rows = [(i, t, 1, 2) for i, t in items]
        return frame(texts), spark.createDataFrame(rows, "item_id long, text string, doc_id int, hash int")

    return make


def found(tables, texts, items, **more):
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(*tables(texts, items), **more).collect()}


def test_kinds_of_copies(tables):
    texts = {
        1: f"{FILLER}. {ITEM} {FILLER}",
        2: f"{FILLER}. {ITEM.upper()} {FILLER}",
        3: f"{FILLER}. {ITEM.replace('Boston', 'Paris').replace('40', '55').replace('120', '99')}",
        4: f"{FILLER}. {ITEM.replace('Boston', 'Paris', 1)}",
        5: FILLER,
        6: None,
        7: "",
        8: " ".join(ITEM.split()[:9]),
        9: re.sub(r"[^\w\s]", "", ITEM.lower()),
    }
    got = found(tables, list(texts.items()), [(70, ITEM), (71, "Entirely different words in this one, none of which are anywhere else here.")])
    assert {1, 2, 3, 9} <= {d for d, _ in got} and not {5, 6, 7, 8} & {d for d, _ in got}
    assert all(i == 70 for _, i in got)
    assert not got[1, 70]["changed"] and got[3, 70]["changed"] and got[3, 70]["consistency"] == 1.0
    assert got[1, 70]["cover"] == 1.0


def test_inconsistent_slots_do_not_count(tables):
    item = "if Anna gives Bob 3 apples and Bob gives Anna 3 pears then Anna and Bob have 3 plums each for Anna"
    steady = item.replace("Anna", "Carla").replace("3", "8")
    loose = "if Karl gives Lena 4 apples and Mike gives Nora 5 pears then Otto and Paul have 6 plums each for Rosa"
    got = found(tables, [(1, steady), (2, loose)], [(1, item)])
    assert set(got) == {(1, 1)}


def test_short_items_and_odd_rows(tables, odd_rows):
    items = [(1, "one short question here"), (2, "two words"), (3, None), (4, ""), (None, ITEM), (5, "one short question here"), (1, "one short question here")]
    texts = [*odd_rows, (1, "before one short question here after"), (1, "before one short question here after"), (None, "one short question here")]
    got = contaminated(*tables(texts, items)).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (0, 5), (1, 1), (1, 5)]
    assert contaminated(*tables([], items)).count() == 0 and contaminated(*tables(texts, [])).count() == 0


def test_query_finds_every_whole_item(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def windows(text, n):
        w = words(text)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    expected = set()
    for doc, text in documents:
        own = windows(text, 8)
        expected |= {(doc, i) for i, t in items if 2 * len(windows(t, 8) & own) >= len(windows(t, 8))}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_template_decontamination(spark, sf_dir).collect()}
    assert got == expected


COUNTS = "we saw 3 red apples on the old table and then 4 red apples on the old table and then 5 red apples on the old table"


def test_each_occurrence_is_judged_for_itself(tables):
    other = ITEM.replace("40", "55").replace("60", "75").replace("120", "99").replace("Boston", "Paris").replace("Denver", "Rome")
    third = ITEM.replace("40", "31").replace("60", "32").replace("120", "33").replace("Boston", "Oslo").replace("Denver", "Bern")
    stray = "another leaves Rome at 7 mph; when the first train has gone 8 miles, how far is Lyon?"
    texts = {
        1: f"{FILLER}. {ITEM} {FILLER}. {other}",
        2: f"{other} {FILLER}. {third}",
        3: f"{ITEM} {' '.join([FILLER] * 20)} {stray}",
        4: COUNTS,
        5: f"{FILLER} {COUNTS.replace('and then 4', 'and just then 4')} {FILLER}",
        6: COUNTS.replace("3", "13").replace("4", "14").replace("5", "15"),
    }
    got = found(tables, list(texts.items()), [(70, ITEM), (71, COUNTS)])
    assert set(got) == {(1, 70), (2, 70), (3, 70), (4, 71), (5, 71), (6, 71)}
    assert not got[1, 70]["changed"] and got[1, 70]["cover"] == 1.0 and not got[4, 71]["changed"]
    assert got[2, 70]["changed"] and got[6, 71]["changed"] and got[6, 71]["consistency"] == 1.0


def test_items_without_templates_and_names_at_the_start(tables):
    items = [
        (1, "What is 12 + 7 * 3?"), (2, "小明有5个苹果，他吃了2个，还剩几个？"), (3, "Tom has 5 apples and eats 2."), (4, "2 + 2 = ?"),
        (5, "two words"), (6, "3 5 8 13 21 34 55 89 144 233"), (7, "ถ้ามีส้มสิบผล"), (8, "???"),
    ]
    texts = {
        1: f"{FILLER}: what is 12 + 7 * 3 {FILLER}", 2: f"{FILLER}: what is 12 * 7 + 3 {FILLER}", 3: "what is 12 + 8 * 3?",
        4: "从前小明有5个苹果，他吃了2个，还剩几个？他说。", 5: "小红有8个苹果，他吃了4个，还剩几个？", 6: "今天天气很好，我们去公园。",
        7: f"{FILLER}. Anna has 7 apples and eats 3. {FILLER}", 8: "so 2 + 2 = 4", 9: "Two words!", 10: f"{FILLER} two words {FILLER}",
        11: "1 2 3 5 8 13 21 34 55 89 144 233 377", 12: "และถ้ามีส้มสิบผลแล้ว", 13: "???", 14: "so 2 + 3 = 4",
    }
    got = found(tables, list(texts.items()), items)
    assert {1, 4, 7, 8, 9, 11, 12} <= {d for d, _ in got} and not {2, 3, 6, 10, 13, 14} & {d for d, _ in got}
    assert set(got) - {(5, 2)} == {(1, 1), (4, 2), (7, 3), (8, 4), (9, 5), (11, 6), (12, 7)}
    assert got[7, 3]["changed"] and not got[4, 2]["changed"] and got[1, 1]["n_slots"] == 0
