"""The parity-sketch join against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from release_guard.llm import jaccard
from release_guard.llm.components import components
from release_guard.llm.jaccard import hamming, jaccard_components, lane_keys, own_schemes, schemes, shingles, sketch


def word_sets(rows, width):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return sets


def expected(rows, width, percent):
    sets = word_sets(rows, width)
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    pairs = {(a, b) for own in by_shingle.values() for a in own for b in own if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            group[root(a)] = root(b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    smallest = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    return Counter((rows[i][0], len(sets[i]), smallest[root(i)]) for i in range(len(rows)))


def planted(seed, n=150, vocabulary=400):
    """Texts with groups of near copies of all degrees, and a passage many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(rng.choices(words, k=25))
    texts = []
    while len(texts) < n:
        base = rng.choices(words, k=rng.choice([3, 6, 9, 14, 30, 60, 200, 500]))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0, 0.01, 0.02, 0.03, 0.04, 0.06]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.2:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.8, 1)))]
            text = " ".join(copy)
            if rng.random() < 0.3:
                text = f"{text}\t{passage}"
            texts.append(text.upper() if rng.random() < 0.1 else text)
    return [(i, t) for i, t in enumerate(texts[:n])]


@pytest.mark.parametrize("width,percent,hot", [(4, 85, 24), (4, 85, 2), (5, 80, 3)])
def test_components_of_planted_groups(frame, odd_rows, width, percent, hot, monkeypatch):
    monkeypatch.setattr(jaccard.jaccard_links, "__defaults__", (hot,))
    rows = planted(width * percent + hot) + odd_rows
    found = Counter(map(tuple, jaccard_components(frame(rows), width, percent).collect()))
    assert found == expected(rows, width, percent)


def test_blocks_find_what_stars_miss(frame, monkeypatch):
    """One hot group in which most pairs do not link, without rounds of stars."""
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    monkeypatch.setattr(jaccard.jaccard_links, "__defaults__", (2,))
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([2, 3, 4, 6])):
            copy[rng.randrange(120)] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(copy)))
    found = Counter(map(tuple, jaccard_components(frame(rows), 4, 85).collect()))
    assert found == expected(rows, 4, 85) and len({c for _, _, c in found}) > 2


def test_documents(frame, documents):
    found = Counter(map(tuple, jaccard_components(frame(documents), 4, 85).collect()))
    assert found == expected(documents, 4, 85)
    assert jaccard_components(frame([])).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_more_keys_than_the_reserve(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(6, 400))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n // 8)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 8)))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(a) == len(b) == common or 100 * common < percent * (len(a) + len(b) - common):
            continue
        scheme = own_schemes(min(len(a), len(b)), percent)[-1]
        assert scheme in own_schemes(max(len(a), len(b)), percent)
        found, counts = lane_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), np.array([scheme] * 2), percent)
        shared = np.intersect1d(found[: counts[0]], found[counts[0] :])
        assert len(shared) > schemes(percent)[scheme][4]
        assert hamming(sketch(a), sketch(b)) <= len(a) + len(b) - 2 * common


def test_shingles_are_the_words_sets():
    rows = [(0, "A b  c d e a B c d"), (1, "x y"), (2, "É é"), (3, " \t")]
    assert [len(shingles(t, 4)) for _, t in rows] == [len(s) for s in word_sets(rows, 4)]
    assert shingles("A b c", 4).tolist() == shingles("a B  c", 4).tolist() != shingles("a b", 4).tolist()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (150, 139)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_go_on_from_those_found_before(frame, monkeypatch):
    from release_guard.llm import components as module

    rounds, keep = [], module.stored

    def counted(df, label):
        rounds[-1] += 1
        return keep(df, label)

    def called(edges):
        rounds.append(0)
        return components(edges)

    monkeypatch.setattr(module, "stored", counted)
    monkeypatch.setattr(jaccard, "components", called)
    # A path: every text links with the next ones only.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 160])) for i in range(40)]
    assert set(map(tuple, jaccard_components(frame(rows), 4, 85).select("doc_id", "component_id").collect())) == {(i, 0) for i in range(40)}
    assert rounds[-1] < rounds[0], rounds
