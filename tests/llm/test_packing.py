import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm.packing import cuts, pack_documents, plan_bins, segments, token_ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 200), max_size=40))
def test_plan_packs_every_piece_once(histogram):
    capacity = 60
    plan = plan_bins(histogram, capacity)
    got = Counter()
    for bins, inside in plan:
        assert sum(n * k for n, k in inside) <= capacity
        assert sum(k for n, k in inside if 3 * n > capacity) <= 2
        for n, k in inside:
            got[n] += bins * k
    assert got == Counter(histogram)
    total = sum(n * c for n, c in histogram.items())
    # First-fit-decreasing's bound holds for any best-fit order of falling lengths.
    assert sum(b for b, _ in plan) <= 2 * max(1, -(-total // capacity))
    at = segments(plan)
    assert len(at["rank"]) == sum(len(i) for _, i in plan)


@given(st.integers(1, 10_000))
def test_only_the_first_piece_is_short(n):
    at = cuts(n, 2048)
    sizes = np.diff(at)
    assert at[0] == 0 and at[-1] == n and (sizes > 0).all() and (sizes[1:] == 2048).all()


def test_ids_equal_the_tokenizers(odd_rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in odd_rows if t] + ["a<|endoftext|>b", "'s 12 ½ ²x   \xa0\x1c y", "日本語 🙂  end ", "a" * 5000]
    for text in texts:
        assert token_ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_every_document_is_packed_whole(make_docs, odd_rows):
    rows = [r.asDict() for r in pack_documents(make_docs(odd_rows)).collect()]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], Counter())[(r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    for doc, text in odd_rows:
        ids = token_ids(text)
        at = cuts(len(ids), 2048)
        copies = sum(d == doc for d, _ in odd_rows)
        for k, (a, b) in enumerate(zip(at, at[1:])):
            assert docs[doc][(k, a, b - a, zlib.crc32(ids[a:b]))] == copies


def test_no_documents(make_docs):
    assert pack_documents(make_docs([])).collect() == []
