import random

import numpy as np
import pytest
import xxhash

from colloquy.llm import simhash
from colloquy.llm.graph import connected_components

from .conftest import by_id


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, threshold):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(make_docs, odd_rows):
    random.seed(1)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    rows = [r for r in odd_rows if r[0] != 4 and r[0] != 5]
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[random.randrange(120)] = f"other{k}"
        rows.append((200 - k, " ".join(words)))
    got = by_id(simhash.near_duplicates(make_docs(rows)))
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps, 2)
    least = {}
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    want = [
        {"doc_id": d, "fingerprint": f"{f:016x}", "component_id": least.get(r)} for (d, _), f, r in zip(rows, fps, root)
    ]
    assert got == sorted(want, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_neighbours_meet_wherever_they_differ():
    rng = np.random.default_rng(5)
    for bits in [(63,), (62, 63), (0, 22), (22, 23), (45, 60), (61, 3), *rng.integers(0, 64, (60, 2)).tolist()]:
        x = rng.integers(-(1 << 63), 1 << 63, dtype=np.int64)
        y = x
        for b in set(bits):
            y ^= np.int64(np.uint64(1 << b).view(np.int64))
        row, anchor = simhash.anchors(np.array([x, y]))
        assert set(anchor[row == 0]) & set(anchor[row == 1])


def test_large_anchors_link_like_small_ones():
    rng = np.random.default_rng(6)
    centre = rng.integers(-(1 << 62), 1 << 62, dtype=np.int64)
    fps = np.unique(np.r_[[centre ^ (np.int64(1) << np.int64(a)) ^ (np.int64(1) << np.int64(b)) for a in range(0, 60, 5) for b in range(0, 60, 7)]])
    far = rng.integers(-(1 << 62), 1 << 62, size=80, dtype=np.int64)
    all_ = np.unique(np.r_[fps, far])
    u, v = simhash.links_at_anchors(np.zeros(len(all_), np.int64), all_)
    root = {int(f): int(f) for f in all_} | dict(zip(u.tolist(), v.tolist()))
    want = brute_components([int(f) & (1 << 64) - 1 for f in all_], 2)
    groups = {}
    for f, r in zip(all_.tolist(), want):
        groups.setdefault(r, set()).add(root[f])
    assert all(len(g) == 1 for g in groups.values()) and len({*root.values()}) == len(groups)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_one_stays_of_each_group(make_docs):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (9, "quite different words here now"), (None, "a b c d e")]
    kept = [r["doc_id"] for r in by_id(simhash.one_of_each_group(make_docs(rows)))]
    assert kept == [3, 9, None]


def test_no_documents(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_odd_threshold_is_refused(make_docs):
    with pytest.raises(ValueError):
        simhash.near_duplicates(make_docs([(1, "a")]), threshold=3)
