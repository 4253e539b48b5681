import random
import zlib

import numpy as np
import pytest

from colloquy.llm import toxicity

from .conftest import by_id


def test_word_hashes_depend_on_the_word_alone():
    head, word = toxicity.hashed_words(" Éxtraordinary, foo\n(FOO) foo. éx é")
    assert len(head) == len(word) == 6
    assert len({*word[1:4].tolist()}) == 1 and word[0] != word[1]
    assert toxicity.hashed_words("éxtravagant")[0][0] == toxicity.hashed_words("x éxtraneous")[0][1]
    assert toxicity.hashed_words(None)[0].size == toxicity.hashed_words(" ., ")[0].size == 0


def test_window_mean_by_brute_force():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(40)}" for _ in range(200))
    head, word = toxicity.hashed_words(text)
    ratio, check = toxicity._filled(None, toxicity.WORD_BITS)
    values = {}
    for w in np.unique(word):
        slot = int(w >> np.uint64(64 - toxicity.WORD_BITS))
        values[int(w)] = ratio[slot] = rng.uniform(-2, 3)
        check[slot] = int(w & np.uint64(0xFFFF))
    model = {"word": (ratio, check), "head": toxicity._filled(None, toxicity.HEAD_BITS)}
    seen, each = set(), []
    for w in word.tolist():
        each.append(0.0 if w in seen else float(np.float32(values[w])))
        seen.add(w)
    n = toxicity.WINDOW
    want = max(sum(each[k : k + n]) for k in range(len(each) - n + 1)) / n, sum(each) / len(each)
    assert toxicity.evidence(text, model) == pytest.approx(want, rel=1e-6)


@pytest.fixture(scope="module")
def corpus(spark, make_docs, odd_rows):
    rng = random.Random(8)
    words = [f"plain{k % 300}" for k in range(400)]
    rows, labels = list(odd_rows), []
    for doc in range(1000, 1900):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["grumbold", "nastyfoo", "nastybar", f"nasty{doc}"]))
        rows.append((doc, " ".join(text)))
        labels.append((doc, int(toxic), "z"))
    odd = [(None, 1, "z"), (1, None, "z"), (2, 7, "z"), (1000, labels[0][1], "z")]
    return make_docs(rows), spark.createDataFrame(labels + odd, "doc_id long, toxic int, text string"), rows, labels


def test_held_out_accuracy(corpus):
    docs, labels, rows, truth = corpus
    got = by_id(toxicity.score_documents(docs, labels))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    for doc, r in by.items():
        assert r["held_out"] == (None if doc is None else zlib.crc32(str(doc).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    assert by[1]["score"] == by[2]["score"]
    wrong = [d for d, y, _ in truth if by[d]["held_out"] and by[d]["predicted"] != y]
    assert len(wrong) <= 2
    kept = by_id(toxicity.drop_toxic(docs, labels))
    assert [r["doc_id"] for r in kept] == [r["doc_id"] for r in got if not r["predicted"]] and kept[0]["word"] == "c"


@pytest.mark.parametrize("rest_rows, broadcast_bytes", [(1 << 20, 8 << 20), (0, 8 << 20), (0, 0)])
def test_words_without_a_slot_score(corpus, monkeypatch, rest_rows, broadcast_bytes):
    docs, labels, _, _ = corpus
    want = by_id(toxicity.score_documents(docs, labels))
    monkeypatch.setattr(toxicity, "WORD_BITS", 3)
    monkeypatch.setattr(toxicity, "HEAD_BITS", 1)
    monkeypatch.setattr(toxicity, "REST_ROWS", rest_rows, raising=False)  # 0: joined, and below by shuffles
    monkeypatch.setattr("colloquy.llm.common.BROADCAST_BYTES", broadcast_bytes)
    got = by_id(toxicity.score_documents(docs, labels))
    assert [(r["doc_id"], r["predicted"]) for r in got] == [(r["doc_id"], r["predicted"]) for r in want]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], rel=1e-9)


def test_held_out_labels_are_not_learnt(corpus):
    docs, labels, _, _ = corpus
    held = "pmod(crc32(cast(doc_id as string)), 5) = 0"
    other = labels.selectExpr("doc_id", f"if({held}, 1 - toxic, toxic) as toxic")
    assert by_id(toxicity.score_documents(docs, labels)) == by_id(toxicity.score_documents(docs, other))


def test_without_labels_or_documents(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in by_id(toxicity.score_documents(make_docs(odd_rows), none)))
    assert toxicity.score_documents(make_docs([]), none).collect() == []
