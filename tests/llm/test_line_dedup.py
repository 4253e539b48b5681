import hashlib
import random

from colloquy.llm.line_dedup import deduplicate_lines

from .conftest import by_id

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars, min_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        drop = lambda x: doc is not None and len(h := holders.get(key(x), ())) >= min_docs and max(h) != doc
        kept = [x for x in lines if not drop(x)]
        out.append({
            "doc_id": doc, "n_lines": len(lines), "n_dropped": len(lines) - len(kept),
            "kept_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        })
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_against_brute_force(make_docs, odd_rows):
    random.seed(3)
    pool = [f"É line number {k} of the pool" for k in range(12)] + ["short", "", "  Mixed Case Line Number 1 Of All  ", "mixed case line number 1 of all"]
    rows = odd_rows + [(100 + k, "\n".join(random.choices(pool, k=6))) for k in range(40)]
    got = deduplicate_lines(make_docs(rows), min_chars=20, min_docs=5, texts=False)
    assert by_id(got) == brute(rows, 20, 5)


def test_texts_keep_all_columns(make_docs):
    line = "a line that is quite long, longer than forty characters"
    rows = [(k, f"{line}\nown {k}") for k in range(6)]
    got = {r["doc_id"]: r for r in by_id(deduplicate_lines(make_docs(rows)))}
    assert got[0]["text"] == "own 0" and got[5]["text"] == f"{line}\nown 5" and got[0]["word"] == "c"


def test_columns_named_like_those_inside(spark):
    line = "a line that is quite long, longer than forty characters"
    rows = [(k, f"{line}\nown {k}", "x", b"y", k, len(line) + 6) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dropped string, key binary, _0 long, n_chars long")
    out = deduplicate_lines(docs)
    got = {r["doc_id"]: r for r in by_id(out)}
    assert out.columns == docs.columns
    assert got[1] == {"doc_id": 1, "text": "own 1", "_dropped": "x", "key": b"y", "_0": 1, "n_chars": 5}


def test_no_documents(make_docs):
    assert deduplicate_lines(make_docs([])).collect() == []
