"""Source audit: against counters, pointer sort, blocks, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from release_guard.llm import divergence
from release_guard.llm.divergence import batch_counts, sorted_runs, source_divergence, term_counts, word_pointers

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(SMALL))


def audit(rows, least, best):
    """The whole result by counters, from (lang, source, text)."""
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        own = words(text)
        documents[lang or ""].update(set(own))
        counts[lang or "", source or ""].update(own)
    kept = {lang: sorted(t for t, n in found.items() if n >= least) for lang, found in documents.items()}

    def shares(lang, found):
        total = sum(found[t] for t in kept[lang])
        return {t: 1 + 10**9 * (found[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    made = set()
    for (lang, source), found in counts.items():
        p = shares(lang, found)
        both = sum((c for (other, _), c in counts.items() if other == lang), Counter())
        q = shares(lang, both)
        pairs = []
        for (other, item), theirs in counts.items():
            if other == lang and item != source:
                r = shares(lang, theirs)
                pairs.append((-sum(abs(p[t] - r[t]) for t in p), item.encode()))
        terms = sorted((q[t] - p[t], t.encode()) for t in p if found[t] and p[t] > q[t])[:best]
        for part, ranked in (("pair", sorted(pairs)), ("term", terms)):
            made |= {(lang, source, part, i.decode(), -v, n) for n, (v, i) in enumerate(ranked, 1)}
    return made


def random_rows(seed, count):
    rng = random.Random(seed)
    pool = ["The", "the", "a", "sun", "SUN", "Überraschung", "überraschung", "abcdefgh", "abcdefghi", "abcdefghij", "漢字", "x" * 70, "x" * 71, "x" * 70 + "y"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(pool) + rng.choice([" ", "1", "-", "\n", "_", ". "]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None]), rng.choice([text, text, None])))
    return rows


@pytest.fixture
def frame(spark):
    def make(rows, partitions=3):
        columns = "lang string, source string, text string, term string, n long, df long, p long, band int, block long, v int, total int"
        return spark.createDataFrame([(*r, "t", 0, 1, 2, 3, 4, 5, 6) for r in rows], columns).repartition(partitions)

    return make


def test_whole_result(frame):
    rows = random_rows(1, 200)
    found = source_divergence(frame(rows), least_documents=10, best=4)
    assert {tuple(r) for r in found.collect()} == audit(rows, 10, 4)


def test_blocks_change_nothing(frame, monkeypatch):
    rows = [(lang, f"s{i % 7}", text) for i, (lang, _, text) in enumerate(random_rows(2, 150))]
    monkeypatch.setattr(divergence, "ROWS", 2)
    found = [tuple(r) for r in source_divergence(frame(rows), least_documents=5, best=50, cells=9).collect()]
    assert len(found) == len(set(found)) and set(found) == audit(rows, 5, 50)


def test_counts(frame):
    rows = random_rows(3, 120)
    occurrences, documents = Counter(), Counter()
    for lang, source, text in rows:
        own = words(text)
        occurrences.update((lang or "", source or "", t) for t in own)
        documents.update((lang or "", source or "", t) for t in set(own))
    found = {tuple(r)[:3]: tuple(r)[3:] for r in term_counts(frame(rows)).collect()}
    assert found == {key: (n, documents[key]) for key, n in occurrences.items()}


def test_pointer_sort_orders_words_and_keeps_ties():
    rng = random.Random(4)
    texts = ["", *["".join(rng.choice("ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 39, 40, 41, 60]))) for _ in range(400)], "a" * 200, "a" * 200, "a" * 201]
    data, first, length, row = word_pointers(pa.array(texts))
    group = np.array([rng.randint(0, 2) for _ in first])
    order, starts = sorted_runs(data, first, length, group)
    pointed = [(int(group[i]), data[first[i] : first[i] + length[i]].tobytes()) for i in range(len(first))]
    runs = np.split(order, starts[1:])
    assert [pointed[run[0]] for run in runs] == sorted(set(pointed))
    assert all(len({pointed[i] for i in run}) == 1 and (np.diff(row[run]) >= 0).all() for run in runs)


def test_slices_of_a_batch():
    texts = pa.array(["One two", None, "two THREE", "é2é"]).fill_null("")
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 4), pa.array(["s", "s", "t", "t"]), texts], names=["lang", "source", "text"])
    parts = [batch_counts(batch.slice(i, 1)) for i in range(4)]
    assert [p and [(r["source"], r["term"], r["n"]) for r in p.to_pylist()] for p in parts] == [
        [("s", "one", 1), ("s", "two", 1)], None, [("t", "three", 1), ("t", "two", 1)], [("t", "é", 2)],
    ]
    assert sorted((r["source"], r["term"], r["n"], r["df"]) for r in batch_counts(batch).to_pylist()) == [
        ("s", "one", 1, 1), ("s", "two", 1, 1), ("t", "three", 1, 1), ("t", "two", 1, 1), ("t", "é", 2, 1),
    ]


def test_odd_tables(frame):
    assert source_divergence(frame([])).count() == 0
    assert source_divergence(frame([("en", "one", "a b c")] * 40)).where("part = 'pair'").count() == 0
    found = {tuple(r) for r in source_divergence(frame([("en", "a", "x y"), ("en", "b", None), (None, None, "12")])).collect()}
    assert found == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    long = [("en", "a", "word " * 200_000), ("en", "b", "z" * 300_000), ("en", "c", "z" * 300_000), ("en", "c", "z" * 299_999 + "y")]
    assert {tuple(r) for r in source_divergence(frame(long), least_documents=1).collect()} == audit(long, 1, 50)
