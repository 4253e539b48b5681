"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks that perfect codes cover: two of 23 bits by
the Golay code (covering radius 3) and one of 15 by the Hamming code (radius
1); three bits stay free. The anchors are the products of code words. Every
fingerprint has one home anchor, and is replicated to each anchor that is the
home of some point within the threshold of it; these lie within covering
radius plus threshold. Two fingerprints within the threshold meet at the home
of either. Per anchor they are compared, and only a spanning forest of the
links leaves the task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import prepare
from colloquy.llm.graph import connected_components
from colloquy.session import settle

THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: Rows at one anchor up to which they are compared two by two.
DIRECT = 48
#: Rows that are compared together in a task.
CHUNK = 1 << 20
#: Generator polynomials of the perfect codes, by block length. Fixed values.
GENERATORS = {23: 0b101011100011, 15: 0b10011}
BLOCKS = ((0, 23), (23, 23), (46, 15))


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's three-word shingles; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and white space
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    first = (ends - lengths)[: len(last)]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 8192 + 1):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""

    def compute(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        compute, "doc_id long, fp long"
    )


def _syndromes(values: np.ndarray, width: int) -> np.ndarray:
    """Remainders of the bit polynomials by the block's generator."""
    generator = GENERATORS[width]
    degree = generator.bit_length() - 1
    out = values.copy()
    for bit in range(width - 1, degree - 1, -1):
        out ^= ((out >> bit) & 1) * (generator << (bit - degree))
    return out


@lru_cache(maxsize=8)
def _reach(width: int, threshold: int):
    """For each syndrome: offsets to the homes of all points within ``threshold``.

    Arrays ``first`` (by syndrome), ``offset`` and ``flips``: the fewest flips
    after which a word with this syndrome has ``word ^ offset`` as its home.
    """
    unit = 1 << np.arange(width, dtype=np.int64)
    patterns = [np.zeros(1, np.int64)]
    for _ in range(3):
        patterns.append(np.unique((patterns[-1][:, None] ^ unit[None]).ravel()))
    leader = np.full(1 << (GENERATORS[width].bit_length() - 1), -1, np.int64)
    weights = [np.concatenate([p[np.bitwise_count(p) == k] for p in patterns[k : k + 1]]) for k in range(4)]
    for words in weights:  # lighter first: perfect codes have one leader each
        s = _syndromes(words, width)
        new = leader[s] < 0
        leader[s[new]] = words[new]
    first, offsets, flips = [0], [], []
    for syndrome in range(len(leader)):
        best: dict[int, int] = {}
        for k in range(threshold + 1):
            for e, s in zip(weights[k].tolist(), (_syndromes(weights[k], width) ^ syndrome).tolist()):
                best.setdefault(e ^ int(leader[s]), k)
        offsets += best
        flips += best.values()
        first.append(len(offsets))
    return np.array(first), np.array(offsets, np.int64), np.array(flips, np.int64)


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``fps``, anchor) for every anchor of every fingerprint."""
    row = np.arange(len(fps))
    anchor = np.zeros(len(fps), np.int64)
    spent = np.zeros(len(fps), np.int64)
    for start, width in BLOCKS:
        word = (fps[row] >> start) & ((1 << width) - 1)
        first, offset, flips = _reach(width, threshold)
        s = _syndromes(word, width)
        count = first[s + 1] - first[s]
        at = np.repeat(np.arange(len(row)), count)
        k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count - first[s], count)
        total = spent[at] + flips[k]
        fits = total <= threshold
        at, k, total = at[fits], k[fits], total[fits]
        row, spent = row[at], total
        anchor = anchor[at] | ((word[at] ^ offset[k]) << start)
    return row, anchor


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it takes the absolute value


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of the edges a-b, without the roots themselves."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links_at_anchors(anchor: np.ndarray, fps: np.ndarray, threshold: int = THRESHOLD):
    """(u, v): a forest that joins all fingerprints within the threshold at some anchor.

    ``anchor`` is sorted. Few rows at an anchor are compared two by two; many
    meet at their midpoints, the points within half the threshold of both,
    which costs the same for every row however many there are.
    """
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[start, len(anchor)])
    group = np.repeat(np.arange(len(start)), size)
    found_a, found_b = [], []
    rows = np.flatnonzero((size[group] > 1) & (size[group] <= DIRECT))
    a, g = fps[rows], group[rows]
    for lag in range(1, int(size[g].max(initial=1))):
        near = (g[lag:] == g[:-lag]) & (_distance(a[lag:], a[:-lag]) <= threshold)
        found_a.append(a[:-lag][near])
        found_b.append(a[lag:][near])
    half = [np.zeros(1, np.int64)]
    for _ in range(threshold // 2):
        half.append(np.unique((half[-1][:, None] ^ (np.int64(1) << np.arange(64, dtype=np.int64))).ravel()))
    flips = np.unique(np.concatenate(half))
    for g in np.flatnonzero(size > DIRECT):
        own = np.unique(fps[start[g] : start[g] + size[g]])
        points = (own[:, None] ^ flips[None]).ravel()
        who = np.repeat(own, len(flips))
        order = np.argsort(points, kind="stable")
        points, who = points[order], who[order]
        same = points[1:] == points[:-1]
        a, b = who[:-1][same], who[1:][same]
        found_a.append(a)
        found_b.append(b)
    a = np.concatenate([*found_a, np.zeros(0, np.int64)])
    b = np.concatenate([*found_b, np.zeros(0, np.int64)])
    return _forest(a, b)


def links(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (u, v) between distinct fingerprints within the threshold, as forests."""
    if threshold % 2:
        raise ValueError("the threshold must be even: large anchors compare by midpoints")

    def replicate(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False)
            for part in np.array_split(fps, len(fps) // 2048 + 1):
                row, anchor = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], ["anchor", "fp"])

    def compare(batches):
        held_anchor, held_fp, rows = [], [], 0

        def done(final: bool):
            nonlocal held_anchor, held_fp, rows
            anchor, fps = np.concatenate(held_anchor), np.concatenate(held_fp)
            cut = len(anchor) if final else int(np.searchsorted(anchor, anchor[-1]))
            held_anchor, held_fp = [anchor[cut:]], [fps[cut:]]
            rows = len(anchor) - cut
            u, v = links_at_anchors(anchor[:cut], fps[:cut], threshold)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        limit = CHUNK
        for batch in batches:
            if len(batch):
                held_anchor.append(batch["anchor"].to_numpy(zero_copy_only=False))
                held_fp.append(batch["fp"].to_numpy(zero_copy_only=False))
                rows += len(batch)
            if rows >= limit:
                yield done(False)
                limit = max(CHUNK, 2 * rows)
        if rows:
            yield done(True)

    return (
        classes.select("fp")
        .mapInArrow(replicate, "anchor long, fp long")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(compare, "u long, v long")
    )


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints of at most ``threshold`` (even) differing bits are linked; the
    component_id is the smallest doc_id that links reach. Copies share one
    fingerprint and enter the comparison once. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows are returned
    each; a null doc_id has a component but never names one, unless it has no
    other. Extra columns are ignored. An empty table gives no rows.
    """
    own = settle(fingerprints(docs), "fingerprints")
    classes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes, threshold))
    rooted = (
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = settle(rooted.join(named, "root").select("fp", "component_id"), "components")
    return own.join(component, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each_group(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group.

    Of rows with one doc_id all stay, as do rows with a null doc_id.
    """
    found = near_duplicates(docs.select("doc_id", "text"), threshold)
    gone = settle(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")  # of known size
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
