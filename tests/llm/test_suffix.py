import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import suffix

from .conftest import by_id


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.text("ab", max_size=300).map(str.encode), st.integers(0, 90).map(lambda n: b"\0a\0" * n)))
def test_suffix_array_and_prefixes(raw):
    text = np.frombuffer(raw, np.uint8)
    order, rank = suffix.suffix_array(text)
    want = sorted(range(len(raw)), key=lambda k: raw[k:])
    assert order.tolist() == want and (rank[order] == np.arange(len(raw))).all()

    def shared(a, b):
        n = 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n

    lcp = suffix.common_prefixes(text, order, rank)
    assert lcp.tolist() == [shared(want[k - 1], want[k]) if k else 0 for k in range(len(want))]


def brute(rows, length):
    raws = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(r[s : s + length] for _, r in raws for s in range(len(r) - length + 1))
    out = []
    for doc, raw in raws:
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                covered[s : s + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append({
            "doc_id": doc, "n_bytes": len(raw), "n_removed": sum(covered), "n_spans": spans,
            "kept_sha256": hashlib.sha256(kept).hexdigest(),
        })
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def documents(n, seed):
    rng = random.Random(seed)
    common = "".join(rng.choices("abcdé ", k=90))
    rows = []
    for k in range(n):
        own = "".join(rng.choices("abcdefghij ", k=rng.randrange(0, 200)))
        kind = k % 6
        if kind == 0:
            own += common
        elif kind == 1:
            own = common[5:80] + own + common[:60] + own[:50]
        elif kind == 2 and rows:
            own = rng.choice(rows)[1] or ""
        elif kind == 3 and rows:
            other = rng.choice(rows)[1] or ""
            own = other[: len(other) // 2] + "X" + other[len(other) // 2 :]
        elif kind == 4:
            own = "of " * rng.randrange(60) + "anin " * rng.randrange(40)
        rows.append((k, own))
    return rows


@pytest.mark.parametrize("regions", [suffix.SHARD_REGIONS, 3])
def test_against_brute_force(make_docs, odd_rows, monkeypatch, regions):
    monkeypatch.setattr(suffix, "SHARD_REGIONS", regions)  # 3: many grams are cut into shards
    monkeypatch.setattr(suffix, "SHARD_BYTES", 2000)
    rows = documents(240, 5) + [r for r in odd_rows if r[0] not in (4, 5)] + [(None, "n" * 70), (900, None)]
    got = suffix.remove_repeats(make_docs(rows), length=40, gram=10).drop("kept")
    assert by_id(got) == brute(rows, 40)


def test_chunks_of_a_long_text(make_docs, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 64)
    raw = np.frombuffer(("abc" * 50 + "xyzw" * 40 + "abc" * 70).encode(), np.uint8)
    first, windows, *_ = suffix.regions(raw, 40, 10)
    assert first[0] == 0 and (first[1:] == first[:-1] + windows[:-1]).all() and windows.sum() == len(raw) - 39


def test_no_documents(make_docs):
    assert suffix.remove_repeats(make_docs([])).collect() == []
