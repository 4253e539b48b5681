import hashlib
import zlib

import pytest

from colloquy.llm.manifest import Node, build_manifest, levels_of

from .conftest import by_id

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, key string, path string, pos long, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, width):
    """All levels, from the leaves to the root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + width]) for k in range(0, len(out[-1]), width)])
    return out


def fold(levels, at, digest, width):
    beside = []
    for level in levels[:-1]:
        first = at // width * width
        run = level[first : first + width]
        beside += run[: at - first] + run[at - first + 1 :]
        run[at - first] = digest
        digest, at = h(*run), at // width
    return digest, beside


def brute(rows, width):
    leaf = lambda r: h(*map(field, r))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in langs[lang]], width)
    top = tree([trees[x][-1][0] for x in order], width)
    out = []
    for k, lang in enumerate(order):
        for at, r in enumerate(langs[lang]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if bad else leaf(r)
            sub, beside = fold(trees[lang], at, start, width)
            root, more = fold(top, k, sub, width)
            out.append({
                "doc_id": r[0], "leaf": leaf(r), "subroot": trees[lang][-1][0], "root": top[-1][0],
                "proof_sha256": h(*beside, *more), "folded_root": root, "verified": root == top[-1][0],
            })
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


ROWS = (
    [(k, f"src{k % 3}", ["en", "fr", None, "", "Ü", "ü"][min(k % 17, 5)], None if k % 5 == 0 else k, f"text {k} É\n") for k in range(-20, 150)]
    + [(7, None, "en", 1, None), (7, None, "en", 1, None), (None, "", None, None, ""), (None, "a", "zz", 3, "x" * 50_000)]
    + [(1 << 40, "s", f"lang{k}", k, "") for k in range(9)]
)


@pytest.mark.parametrize("width,height", [(2, 12), (2, 1), (2, 2), (3, 2)])
def test_against_brute_force(spark, width, height):
    docs = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in ROWS], SHAPE)
    got = by_id(build_manifest(docs, width, height))
    assert got == brute(list(ROWS), width)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    rows = [(k, "s", f"l{k}", 5, "t") for k in range(n)]
    assert by_id(build_manifest(spark.createDataFrame(rows, ", ".join(SHAPE.split(", ")[:5])))) == (brute(rows, 2) if n else [])


def test_fold_resumes_the_state_before_the_slot():
    node = Node(["a" * 64, "b" * 64, "c" * 64])
    assert node.fold(1, "x" * 64) == h("a" * 64, "x" * 64, "c" * 64)
    assert node.fold(2, "c" * 64) == node.digest == h("a" * 64, "b" * 64, "c" * 64)
    assert node.siblings(1) == ["a" * 64, "c" * 64]


def test_levels():
    assert [levels_of(n, 2) for n in (1, 2, 3, 4, 5)] == [0, 1, 2, 2, 3]
