"""Near duplicates against brute force; trees and bounds."""

import random

import numpy as np
import pytest

import brute
from ward_analytics.llm import ngram_join, sharing
from ward_analytics.llm.graph import components


def corpus(seed, n):
    rng, rows = random.Random(seed), []
    for d in range(n):
        words = [f"w{rng.randrange(rng.choice([2, 5, 300]))}" for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 12, 30, 90]))]
        if rows and rng.random() < 0.6:
            words = brute.words(rng.choice(rows[-40:])[1])
            for _ in range(rng.randrange(1 + max(1, len(words) // 25))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(["W1", "zz", f"q{rng.randrange(99)}"])
        rows.append((d if rng.random() > 0.03 else None, None if rng.random() < 0.03 else " ".join(words)))
    return rows + [(n, rows[9][1]), (n + 1, rows[9][1]), rows[9], (n + 2, "Z  z\tZ z z"), (n + 3, "z z z z z"), (n + 4, " \n ")]


@pytest.mark.parametrize("settings", [{}, {"WIDE": 0, "WIDE_SHARE": 10**6, "MOSTLY": 1.1}])
def test_classes_equal_brute_force(frame, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(sharing, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(ngram_join, "MEET_CHUNKS", 2)
    rows = corpus(3, 130)
    known = [(d, brute.shingles(x)) for d, x in rows if d is not None]
    of = dict(zip([d for d, _ in known], brute.components(known), strict=True))
    want = sorted([(d, len(brute.shingles(x)), of.get(d)) for d, x in rows], key=str)
    got = sorted(map(tuple, ngram_join.classes(frame(rows)).collect()), key=str)
    assert got == want
    assert sum(d != c for d, _, c in want) > 20


def test_empty_table(frame):
    assert ngram_join.classes(frame([(1, "x")]).where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 100, 101])
def test_first_ones_leave_room_for_every_link(n):
    for m in range(1, 3 * n):
        for common in range(min(n, m) + 1):
            if 100 * common >= 80 * (n + m - common) and common:
                assert n - common < ngram_join.first_ones(n)
                assert common >= ngram_join.least_overlap(n, m)


def test_trees_find_all_that_may_link():
    rng = np.random.RandomState(1)
    sets = []
    for _ in range(300):
        own = np.unique(rng.randint(0, 2**62, rng.randint(1, 300)).astype(np.uint64))
        if sets and rng.rand() < 0.6:
            base = sets[rng.randint(len(sets))]
            own = np.unique(np.concatenate((base[rng.rand(len(base)) < 0.95], own[: len(base) // 30])))
        sets.append(own)
    sizes = np.array([len(s) for s in sets])
    forest = ngram_join.Forest([ngram_join.point(s, ngram_join.groups(len(s))) for s in sets], sizes)
    looked = 0
    for i, s in enumerate(sets):
        found = set(forest.search(i).tolist())
        looked += len(found)
        assert {j for j, t in enumerate(sets) if len(t) <= len(s) and ngram_join.linked(s, t)} <= found
    assert looked < 300 * 40


def test_components(workers):
    edges = [(5, 3), (3, 9), (9, 12), (20, 21), (21, 20), (7, 7), *((i, i + 1) for i in range(100, 160))]
    found = dict(map(tuple, components(workers.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {3: 3, 5: 3, 9: 3, 12: 3, 20: 20, 21: 20, **{i: 100 for i in range(100, 161)}}
