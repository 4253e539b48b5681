import random

import numpy as np
import pytest

from colloquy.llm.chosen_path import compare_node, confirm, minwise, near_duplicates, trees_needed

from .conftest import by_id


def shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows, percent, n=3):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        best = least.get(find(k))
        least[find(k)] = doc if best is None else best if doc is None else min(best, doc)
    out = [
        {"doc_id": d, "n_shingles": len(sets[k]), "component_id": least[find(k)], "kept": d is not None and d == least[find(k)]}
        for k, (d, _) in enumerate(rows)
    ]
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def rows_of():
    """Clusters of near copies around the threshold, one of them large, and shared passages."""
    random.seed(9)
    word = lambda: f"w{random.randint(0, 5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for c in range(30):
        base = [word() for _ in range(random.choice([5, 40, 150, 400]))]
        for _ in range(60 if c == 0 else random.randint(1, 6)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                copy[random.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(40)] + passage) for _ in range(30)]
    rows += ["One two THREE", "one  two\tthree", "one two", "ONE two", "é É", "É é", "x" * 400, "same same same same same"]
    random.shuffle(rows)
    return [(1000 - 3 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("bounds", [{}, {"small": 4, "depth": 3, "entries": 300, "work": 2000}])
def test_against_brute_force(make_docs, odd_rows, bounds):
    rows = odd_rows + rows_of()
    got = by_id(near_duplicates(make_docs(rows), recall=0.99999, **bounds))
    assert got == brute(rows, 85)
    assert len({r["component_id"] for r in got}) < len(rows) - 50


def test_no_rows(make_docs):
    assert near_duplicates(make_docs([])).collect() == []


def test_trees_reach_their_recall():
    assert trees_needed(85, 0.999, 1) < trees_needed(85, 0.999, 8) < trees_needed(85, 0.99999, 8)


def test_minwise_estimates_similarity():
    random = np.random.default_rng(1)
    a = random.integers(0, 1 << 63, 12_000, dtype=np.uint64)
    b = np.r_[a[:9_000], random.integers(0, 1 << 63, 3_000, dtype=np.uint64)]
    assert abs((minwise(a) == minwise(b)).mean() - 0.6) < 0.15


def test_forests_of_nodes_and_sets():
    low = np.zeros((70, 128), np.uint8)
    low[:, :] = np.arange(70)[:, None]
    low[40] = low[3]
    assert [x.tolist() for x in compare_node(low, 100)] == [[40], [3]]
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 500, 10)]
    assert [x.tolist() for x in confirm(sets, 85)] == [[1, 3], [0, 0]]
    assert [x.tolist() for x in confirm(sets, 85, split=1)] == [[1], [0]]
