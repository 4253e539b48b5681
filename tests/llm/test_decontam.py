import hashlib
import random
import re

import pytest

from colloquy.llm import common
from colloquy.llm.decontam import drop_contaminated, find_leaks

from .conftest import by_id


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items, window=10):
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            v = words(passage)
            n = min(window, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        found.discard("None")
        out.append({
            "doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(found),
            "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit),
        })
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, make_docs, odd_rows, monkeypatch, small):
    if not small:  # all joins shuffle
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(9)] + ["É", "the"]
    passages = [" ".join(random.choices(vocabulary, k=n)) for n in (1, 3, 9, 10, 11, 25, 25)]
    items = [*enumerate(passages), (9, passages[5]), (20, "…!"), (21, None), (22, ""), (100, "Same ROW")]
    rows = [r for r in odd_rows if r[0] not in (4, 5)]
    for k in range(30):
        text = random.choices(vocabulary + [f"x{k}"], k=30)
        text[7:7] = random.choice(passages).upper().split() if k % 2 else []
        rows.append((300 + k, ", ".join(text)))
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, word string")
    try:
        assert by_id(find_leaks(make_docs(rows), bench)) == brute(rows, items)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert find_leaks(make_docs([]), bench).collect() == []
    got = by_id(find_leaks(make_docs([(1, "some words of an item")]), bench.limit(0)))
    assert got[0]["n_words"] == 5 and not got[0]["contaminated"]


def test_drop_keeps_clean_rows(spark, make_docs):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    rows = [(1, "here are Some words, of an item!"), (2, "some words of an"), (None, "clean")]
    assert [r["doc_id"] for r in by_id(drop_contaminated(make_docs(rows), bench))] == [2, None]
