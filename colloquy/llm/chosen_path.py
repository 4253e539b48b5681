"""Near duplicates by a chosen-path set similarity join.

Every document's set is reduced to minwise values of independent coordinates.
A tree branches its nodes by one or two coordinates that the node's path
chooses, on average as many as keep a pair at the threshold together once:
documents with the same value go on together. Small nodes are compared two by
two, independent trees are repeated until a pair at the threshold is met with
the target recall, and what meets is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import FILTER_BITS, IdFilter, broadcast_if_small, prepare
from colloquy.llm.graph import connected_components
from colloquy.llm.hashing import mixed
from colloquy.llm.simhash import _forest
from colloquy.llm.tokens import WHITE, Words, byte_kinds, run_hashes, words_of
from colloquy.session import settle

PERCENT = 85
SHINGLE = 3
#: Coordinates of minwise values.
COORDINATES = 128
#: A pair at the threshold meets in some tree with this probability.
RECALL = 0.999
#: Levels below the root; a node that is large even there is one class for the confirmation.
DEPTH = 8
#: Documents up to which a node is compared two by two.
SMALL = 256
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 4.5
#: Set entries that are held for one confirmation, and entries compared in it.
BLOCK_ENTRIES = 1 << 21
BLOCK_WORK = 1 << 31
KINDS = byte_kinds(WHITE)
_EMPTY = np.zeros(0, np.uint64)
_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trees_needed(percent: int = PERCENT, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Trees after which a pair at the threshold has met with probability ``recall``.

    A node chooses one coordinate, or two so that the mean is 1 / threshold.
    """
    s = percent / 100
    two = 1 / s - 1
    meets = 1.0
    for _ in range(depth):
        meets = (1 - two) * s * meets + two * (1 - (1 - s * meets) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


# -- sets and minwise values ---------------------------------------------------


def _sets(words: Words, rows: int, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h = words.hashes()
    runs = run_hashes(h, shingle)
    ends = np.searchsorted(words.row, np.arange(rows), side="right")
    first = 0
    for last in ends.tolist():
        n = last - first
        if not n:
            yield _EMPTY
        elif n < shingle:
            yield run_hashes(h[first:last], n)
        else:
            yield np.unique(runs[first : last - shingle + 1])
        first = last


def minwise(values: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash, as 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(values, len(values) // 4096 + 1):
        if len(part):
            x = part[None] * _MULTIPLY[:, None]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def summaries(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, class_id, sketch) of each row; class_id names the set, and is null for none."""

    def summarise(batches):
        for batch in batches:
            sizes, classes, sketches = [], [], []
            for first, after, words in words_of(batch["text"], KINDS):
                for own in _sets(words, after - first, shingle):
                    sizes.append(len(own))
                    classes.append(_digest(own) if len(own) else None)
                    sketches.append(minwise(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "class_id", "sketch"],
            )

    return docs.mapInArrow(summarise, "doc_id long, n long, class_id binary, sketch binary")


# -- the trees -------------------------------------------------------------------


class PathFilter(IdFilter):
    """The set of fixed size over path hashes that tasks compute themselves."""

    def _at(self):
        return F.col(self.columns[0]).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return ((bits[at >> 6] >> (at & 63)) & 1).astype(bool)


def _children(row: np.ndarray, path: np.ndarray, sketches: np.ndarray, two: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the next level: the path alone chooses its coordinates."""
    draw = mixed(path + np.uint64(0xD1B54A32D192ED03))
    a = (draw % np.uint64(COORDINATES)).astype(np.int64)
    b = ((draw >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)
    b += b >= a  # another one than a
    both = (draw >> np.uint64(32)).astype(np.float64) < two * 2.0**32

    def child(rows, paths, at):
        return mixed(mixed(paths ^ (at.astype(np.uint64) << np.uint64(40))) ^ sketches[rows, at])

    return np.r_[row, row[both]], np.r_[child(row, path, a), child(row[both], path[both], b[both])]


def _paths(sketches: np.ndarray, trees: int, large: list, two: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of each sketch below the nodes known to be large, one filter for each level."""
    roots = mixed(np.arange(1, trees + 1, dtype=np.uint64))
    row = np.repeat(np.arange(len(sketches)), trees)
    path = np.tile(roots, len(sketches))
    for level in large:
        if level is not None:
            stays = _in(level.value, path)
            row, path = row[stays], path[stays]
        row, path = _children(row, path, sketches, two)
    return row, path


def _sketches(batch) -> np.ndarray:
    joined = b"".join(batch["sketch"].to_pylist())
    return np.frombuffer(joined, np.uint32).reshape(-1, COORDINATES)


def _located(classes: DataFrame, trees: int, large: list, two: float, chosen=None, but=None) -> DataFrame:
    """(path, node, sketch) of every class at one level, where the paths may be in a filter and not in another."""

    def locate(batches):
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                row, path = _paths(_sketches(part), trees, large, two)
                if chosen is not None:
                    fits = _in(chosen.value, path) & (True if but is None else ~_in(but.value, path))
                    row, path = row[fits], path[fits]
                # One byte of each minwise value estimates as well.
                low = _sketches(part).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(path.view(np.int64)), part["node"].take(pa.array(row)),
                        pa.array([low[k].tobytes() for k in range(len(low))], pa.binary()).take(pa.array(row)),
                    ],
                    ["path", "node", "low"],
                )

    return classes.select("node", "sketch").mapInArrow(locate, "path long, node binary, low binary")


def compare_node(low: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (child, root) over the rows of a node that agree in ``least`` coordinates."""
    found_a, found_b = [], []
    for k in range(0, len(low), 32):
        part = low[k : k + 32]
        same = (part[:, None] == low[None, k:]).sum(axis=2, dtype=np.int32)
        a, b = np.nonzero(same >= least)
        found_a.append(a[b > a] + k)
        found_b.append(b[b > a] + k)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _compared(located: DataFrame, least: int) -> DataFrame:
    """Links (u, v) of small nodes: forests of what may be similar."""

    def compare(batches):
        held, rows = [], 0

        def done(table: pa.Table) -> pa.RecordBatch:
            path = table["path"].to_numpy()
            start = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            end = np.r_[start[1:], len(path)]
            low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist()):
                u, v = compare_node(low[a:b], least)
                us.append(u + a)
                vs.append(v + a)
            node = table["node"].combine_chunks()
            return pa.RecordBatch.from_arrays(
                [node.take(pa.array(np.concatenate(us))), node.take(pa.array(np.concatenate(vs)))], ["u", "v"]
            )

        for batch in batches:
            if len(batch):
                held.append(batch)
                rows += len(batch)
            if rows >= 1 << 16:
                table = pa.Table.from_batches(held)
                cut = int(np.searchsorted(table["path"].to_numpy(), table["path"][-1].as_py()))
                yield done(table.slice(0, cut)) if cut else pa.RecordBatch.from_pydict(
                    {"u": pa.array([], pa.binary()), "v": pa.array([], pa.binary())}
                )
                held, rows = table.slice(cut).to_batches(), len(table) - cut
        if rows:
            yield done(pa.Table.from_batches(held))

    return located.repartition("path").sortWithinPartitions("path").mapInArrow(compare, "u binary, v binary")


def meetings(classes: DataFrame, percent: int, trees: int, depth: int, small: int) -> DataFrame:
    """Links (u, v) between class ids that hold together all pairs that met in a tree.

    Counts of a level's nodes say which are large; only those branch further,
    and only smaller ones with two classes or more are shuffled. A node that
    is large at the last level hangs on its least class.
    """
    s = percent / 100
    least = max(1, math.floor(COORDINATES * s - SLACK * math.sqrt(COORDINATES * s * (1 - s))))
    two = 1 / s - 1
    # Of classes with one sketch, one goes through the trees.
    nodes = settle(classes.groupBy("sketch").agg(F.min("class_id").alias("node")), "sketches")
    links = (
        classes.join(nodes, "sketch").filter("class_id != node").select(F.col("class_id").alias("u"), F.col("node").alias("v"))
    )
    links = settle(links, "same-sketch")
    large: list = [None]
    for level in range(1, depth + 1):
        sizes = settle(
            _located(nodes, trees, large, two).groupBy("path").agg(F.count("*").alias("m")).filter("m > 1"), "node-sizes"
        )
        several = PathFilter(sizes, ["path"])
        many = sizes.filter(F.col("m") > small)
        last = many.isEmpty()
        over = PathFilter(many, ["path"])
        leaves = _located(nodes, trees, large, two, several.sent, over.sent)
        links = links.unionByName(settle(_compared(leaves, least), "node-links"))
        if last:
            return links
        if level == depth:
            rest = _located(nodes, trees, large, two, over.sent)
            heads = settle(rest.groupBy("path").agg(F.min("node").alias("head")), "heads")
            return links.unionByName(
                rest.join(broadcast_if_small(heads), "path").filter("node != head").select(F.col("node").alias("u"), F.col("head").alias("v"))
            )
        large = [*large, over.sent]
    return links


# -- confirmation ----------------------------------------------------------------


def confirm(sets: list[np.ndarray], percent: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest (child, root) of the sets linked by their full Jaccard similarity.

    With ``split`` only pairs of a set before it and one from it on count.
    """
    sizes = np.array([len(x) for x in sets])
    joined = np.concatenate(sets)
    values, entry = np.unique(joined, return_inverse=True)
    start = np.r_[0, np.cumsum(sizes)]
    flag = np.zeros(len(values), bool)
    found_a, found_b = [], []
    first = split or 0
    for k in range(split if split is not None else len(sets) - 1):
        after = first if split is not None else k + 1
        own = entry[start[k] : start[k + 1]]
        flag[own] = True
        both = np.add.reduceat(flag[entry[start[after] :]], start[after:-1] - start[after], dtype=np.int64)
        flag[own] = False
        union = sizes[k] + sizes[after:] - both
        near = np.flatnonzero(100 * both >= percent * union) + after
        found_a.append(np.full(len(near), k))
        found_b.append(near)
    return _forest(np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)]))


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, class_id, entries): whole sets again, for the documents that met others."""

    def fill(batches):
        for batch in batches:
            for first, after, words in words_of(batch["text"], KINDS):
                own = list(_sets(words, after - first, shingle))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, after - first), pa.array([_digest(x) for x in own], pa.binary()),
                        pa.array([x.tobytes() for x in own], pa.binary()),
                    ],
                    ["doc_id", "class_id", "entries"],
                )

    return docs.mapInArrow(fill, "doc_id long, class_id binary, entries binary")


def confirmed(docs: DataFrame, met: DataFrame, percent: int, shingle: int, entries: int, work: int) -> DataFrame:
    """Links (u, v) between class ids whose full sets are similar.

    ``met`` (doc_id, class_id, n, root) are one document of each class that met
    another, and the group in which they met. A group too large for one task
    is cut into blocks, each pair of which is a task of its own.
    """
    whole = met.groupBy("root").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
    by_size = F.ceil(F.col("w") / entries)
    by_work = F.ceil(F.sqrt(F.col("w") * F.col("m") / work))
    blocks = whole.select("root", F.greatest(by_size, by_work).cast("int").alias("blocks"))
    placed = settle(
        met.join(broadcast_if_small(settle(blocks, "blocks")), "root").select(
            "class_id", "doc_id", "root", "blocks", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("own")
        ),
        "met",
    )
    chosen = IdFilter(placed, ["doc_id"])
    sets = _full_sets(chosen.keep(docs), shingle).dropDuplicates(["class_id"])
    filled = sets.select("class_id", "entries").join(placed.drop("doc_id"), "class_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = filled.select("root", "class_id", "entries", "own", other).select(
        "root", "class_id", "entries", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def compare(group: pa.Table) -> pa.Table:
        ids = group["class_id"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group["entries"].to_pylist()]
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        order = list(range(len(ids)))
        split = None
        if i != j:
            own = group["own"].to_pylist()
            order.sort(key=lambda k: own[k] == j)
            split = sum(x == i for x in own)
            if split in (0, len(ids)):
                order = []
        child, root = confirm([sets[k] for k in order], percent, split) if len(order) > 1 else ([], [])
        return pa.table({
            "u": pa.array([ids[order[k]] for k in child], pa.binary()), "v": pa.array([ids[order[k]] for k in root], pa.binary()),
        })

    return dealt.groupBy("root", "i", "j").applyInArrow(compare, "u binary, v binary")


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    depth: int = DEPTH,
    small: int = SMALL,
    entries: int = BLOCK_ENTRIES,
    work: int = BLOCK_WORK,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    A row's set are its distinct shingles of ``shingle`` words (fewer words:
    all of them as one); rows are linked where the Jaccard similarity of their
    sets is ``percent`` or more, and the component_id is the smallest doc_id
    that links reach. Rows with one set are one class. Null texts and texts
    without words have no set and are alone. Repeated rows are returned each;
    a null doc_id is linked but names a component only if no other does, and
    is never kept. Extra columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = settle(summaries(texts, shingle), "summaries")
    grouped = own.filter("class_id IS NOT NULL").groupBy("class_id")
    # All of a class have one sketch and size.
    classes = settle(
        grouped.agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes"
    )
    met = meetings(classes, percent, trees_needed(percent, recall, depth), depth, small)
    groups = connected_components(met)
    members = settle(
        classes.join(groups, classes.class_id == groups.node).select("class_id", F.col("least").alias("doc_id"), "n", "root"), "members"
    )
    links = settle(confirmed(texts, members, percent, shingle, entries, work), "links")
    roots = connected_components(links)
    linked = classes.select("class_id", "least").join(roots, F.col("class_id") == F.col("node"))
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    renamed = settle(linked.join(names, "root").select("class_id", "name"), "names")
    named = classes.select("class_id", "least").join(renamed, "class_id", "left").select(
        "class_id", F.coalesce("name", "least").alias("name")
    )
    # Rows without a set have no class: they are dealt by nothing and joined with nothing.
    some = own.filter("class_id IS NOT NULL").join(named, "class_id").select("doc_id", "n", "name")
    none = own.filter("class_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("name"))
    return some.unionByName(none).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("name").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("name"), F.lit(False)).alias("kept"),
    )
