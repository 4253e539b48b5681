import math
import random
import re

from colloquy.llm.licenses import SHINGLE, TEMPLATES, scan_licenses

from .conftest import by_id


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)]


def brute(text, share=0.8):
    """Names of the templates of which some passage has enough shingles."""
    found, s = set(), shingles(text)
    for name, template in TEMPLATES.items():
        own = shingles(template)
        width, need = len(own) + len(own) // 4, math.ceil(share * len(set(own)) - 1e-9)
        if any(len(set(own) & set(s[k : k + width])) >= need for k in range(len(s))):
            found.add(name)
    return ",".join(sorted(found))


def damaged(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
    return " ".join(words)


def test_against_brute_force(make_docs, odd_rows):
    rng = random.Random(7)
    noise = [f"n{k}" for k in range(200)] + ["the", "license", "under"]
    rows = list(odd_rows)
    for k, name in enumerate([*TEMPLATES] * 12):
        around = [rng.choices(noise, k=rng.randrange(0, 300)) for _ in range(2)]
        middle = damaged(rng, TEMPLATES[name], k % 4)
        rows.append((1000 + k, " ".join([*around[0], middle.upper() if k % 2 else middle, *around[1]])))
    got = by_id(scan_licenses(make_docs(rows)))
    want = {}
    for doc, text in rows:
        want[doc] = brute(text)
    assert {r["doc_id"]: r["licenses"] for r in got} == want and len(got) == len(rows)
    for r in got:
        assert r["n_matches"] == len(r["matches"]) and r["n_licenses"] == len({m["license"] for m in r["matches"]})
        assert all(m["containment"] >= 0.8 for m in r["matches"])


def test_each_passage_is_one_match(make_docs):
    text = "x y. Released under the MIT License. and\nreleased under the MIT license z"
    (got,) = by_id(scan_licenses(make_docs([(1, text)])))
    assert [(m["license"], m["start_word"], m["n_words"]) for m in got["matches"]] == [("MIT", 2, 5), ("MIT", 8, 5)]


def test_no_documents(make_docs):
    assert scan_licenses(make_docs([])).collect() == []
