"""Merkle manifest of a table: a hash tree per language and one over their roots.

Each node keeps copies of its hash state, one from before each of its child
slots. Folding a changed child upwards resumes the state of its slot, adds the
replacement and the siblings to its right, and never hashes what is to its
left again. Trees are cut into subtrees of ``width ** height`` leaves, each one
group of a shuffle; their roots are the leaves of the next layer.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from colloquy.llm.common import broadcast_if_small, prepare
from colloquy.session import settle

WIDTH = 2
#: Levels of nodes in one subtree: 4,096 leaves of a binary tree.
HEIGHT = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """UTF-8 bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[c]) for c in COLUMNS]).cast("binary"), 256)


class Node:
    """A node's digest and a copy of its state from before each child."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        """The digest with another child in ``slot``: resumed there, not begun anew."""
        state = self.states[slot].copy()
        state.update("".join([replacement, *self.children[slot + 1 :]]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> list[str]:
        return self.children[:slot] + self.children[slot + 1 :]


def subtree(leaves: list[str], levels: int, width: int) -> list[list[Node]]:
    """Levels of nodes above ``leaves``, lowest first."""
    out: list[list[Node]] = []
    below = leaves
    for _ in range(levels):
        out.append([Node(below[k : k + width]) for k in range(0, len(below), width)])
        below = [node.digest for node in out[-1]]
    return out


def levels_of(n: int, width: int) -> int:
    """Levels of nodes above ``n`` leaves; a lone leaf is its own root."""
    levels, nodes = 0, n
    while nodes > 1:
        nodes = -(-nodes // width)
        levels += 1
    return levels


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, the place within the keys in ascending order, and ``total``, their rows.

    Ranges of the whole order are numbered where they lie; only each range's
    counts by key are summed up, so a key with most rows is many tasks.
    """
    shape = StructType([*rows.schema, StructField("part", IntegerType()), StructField("at", LongType())])
    columns = rows.columns

    def number(batches):
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for key in zip(*[batch[k].to_pylist() for k in keys]):
                n = n + 1 if key == last else 0
                last = key
                at.append(n)
            parts = pa.array([part] * len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(at, pa.int64())], [*columns, "part", "at"])

    by = [F.col(c) for c in [*keys, *order]]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = settle(rows.repartitionByRange(count, *by).sortWithinPartitions(*by).mapInArrow(number, shape), "numbered")
    sums = numbered.groupBy(*keys, "part").agg((F.max("at") + 1).alias("n"))
    key = Window.partitionBy(*keys)
    before = key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        sums.select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(key).alias("total"),
        ),
        "starts",
    )
    same = F.col("part") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return numbered.join(broadcast_if_small(starts), same).select(
        *columns, (F.col("at") + F.col("_before")).alias("pos"), "total"
    )


_PATH = "array<struct<l:array<string>,r:array<string>>>"


def _layers(leaves: DataFrame, width: int, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (key, root) and, by layer, the subtrees (key, block, total, digest).

    ``leaves`` are (key, pos, total, digest), pos from 0 to total - 1.
    """
    size = width**height
    layers = []
    now = leaves
    while True:
        blocks = settle(
            now.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
            .groupBy("key", "block", "total")
            .applyInArrow(_root_of_block(width, height), "key binary, block long, total long, digest string"),
            "subtrees",
        )
        layers.append(blocks)
        if blocks.filter(F.col("total") > size).isEmpty():
            roots = blocks
            for earlier in layers[:-1]:  # keys whose tree ended in a lower layer
                roots = roots.unionByName(earlier.filter(F.col("total") <= size))
            return roots.select("key", F.col("digest").alias("root")), layers
        now = blocks.filter(F.col("total") > size).select(
            "key", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), "digest"
        )


def _levels(total: int, width: int, height: int) -> int:
    return min(height, levels_of(total, width))


def _sorted_leaves(group: pa.Table) -> pa.Table:
    return group.sort_by("pos")


def _root_of_block(width: int, height: int):
    def root(group: pa.Table) -> pa.Table:
        total = group["total"][0].as_py()
        leaves = _sorted_leaves(group)["digest"].to_pylist()
        tree = subtree(leaves, _levels(total, width, height), width)
        digest = tree[-1][0].digest if tree else leaves[0]
        return pa.table({
            "key": pa.array([group["key"][0].as_py()], pa.binary()), "block": pa.array([group["block"][0].as_py()], pa.int64()),
            "total": pa.array([total], pa.int64()), "digest": [digest],
        })

    return root


def _paths_of_block(width: int, height: int):
    """For a subtree and the path above it: the paths above its leaves."""

    def paths(group: pa.Table, way: pa.Table) -> pa.Table:
        total = group["total"][0].as_py()
        ordered = _sorted_leaves(group)
        tree = subtree(ordered["digest"].to_pylist(), _levels(total, width, height), width)
        above = way["path"][0].as_py() or []
        out = []
        for at in range(len(ordered)):
            own, slot = [], at
            for level in tree:
                node, place = level[slot // width], slot % width
                own.append({"l": node.children[:place], "r": node.children[place + 1 :]})
                slot //= width
            out.append(own + above)
        return pa.table({
            "key": ordered["key"].cast(pa.binary()), "block": ordered["pos"].cast(pa.int64()),
            "path": pa.array(out, pa.list_(pa.struct([("l", pa.list_(pa.string())), ("r", pa.list_(pa.string()))]))),
        })

    return paths


def _with_way(nodes: DataFrame, paths: DataFrame, each, shape: str) -> DataFrame:
    """Each subtree's nodes beside its one path."""
    return nodes.groupBy("key", "block").cogroup(paths.groupBy("key", "block")).applyInArrow(each, shape)


def _descend(leaves: DataFrame, layers: list[DataFrame], top: DataFrame | None, width: int, height: int) -> DataFrame:
    """(key, block, path): what is beside the way from each subtree of leaves to the root.

    ``top`` has a path for each key, which goes on above its root.
    """
    size = width**height
    above = layers[-1].filter(F.col("total") <= size).select("key", "block")
    if top is None:
        above = above.withColumn("path", F.lit(None).cast(_PATH))
    else:
        above = above.join(top, "key").select("key", "block", "path")
    for lower in layers[-2::-1]:
        inner = lower.filter(F.col("total") > size).select(
            "key", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), "digest",
            F.floor(F.col("block") / size).cast("long").alias("block"),
        )
        shape = f"key binary, block long, path {_PATH}"
        opened = _with_way(inner, above, _paths_of_block(width, height), shape)
        ended = lower.filter(F.col("total") <= size).select("key", "block")
        ended = ended.withColumn("path", F.lit(None).cast(_PATH)) if top is None else ended.join(top, "key").select("key", "block", "path")
        above = settle(opened.unionByName(ended), "paths")
    return above


def _fold_block(width: int, height: int):
    """Every leaf of a subtree folded up to the root, from its tampered digest where it has one."""

    def fold(group: pa.Table, way: pa.Table) -> pa.Table:
        total = group["total"][0].as_py()
        ordered = _sorted_leaves(group)
        leaves = ordered["digest"].to_pylist()
        tree = subtree(leaves, _levels(total, width, height), width)
        # Above the subtree all its leaves pass the same nodes: their states before the slot are kept once.
        steps = way["path"][0].as_py() or []
        above = [(hashlib.sha256("".join(s["l"]).encode()), "".join(s["r"]).encode()) for s in steps]
        beside = "".join(d for s in steps for d in s["l"] + s["r"]).encode()
        proofs, folded = [], []
        for at, changed in enumerate(ordered["changed"].to_pylist()):
            digest = changed if changed is not None else leaves[at]
            proof, slot = hashlib.sha256(), at
            for level in tree:
                node, place = level[slot // width], slot % width
                proof.update("".join(node.siblings(place)).encode())
                digest = node.fold(place, digest)
                slot //= width
            for state, right in above:
                resumed = state.copy()
                resumed.update(digest.encode() + right)
                digest = resumed.hexdigest()
            proof.update(beside)
            proofs.append(proof.hexdigest())
            folded.append(digest)
        return pa.table({
            "doc_id": ordered["doc_id"], "key": ordered["key"].cast(pa.binary()), "leaf": ordered["digest"].cast(pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
        })

    return fold


def tampered(doc_id: Column) -> Column:
    """Which documents are tampered with: 7 divides the crc32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def build_manifest(docs: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf hashes doc_id, source, lang, n_chars and text; leaves ascend by
    doc_id (null first, then by their digest, so repeated rows have one result)
    in the tree of their lang, whose roots, in the order of lang (null first),
    are the leaves of the tree above. The documents that ``tampered`` names are
    folded from a leaf with n_chars greater by 1; a null n_chars stays. Null
    is a value of its own in every column, different from the empty string.
    Extra columns are ignored. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    values = {c: F.col(c) for c in COLUMNS}
    changed = leaf_digest({**values, "n_chars": F.col("n_chars") + F.lit(1)})
    rows = docs.select(*COLUMNS).select(
        F.col("doc_id").cast("long"),
        F.col("lang").cast("string"),
        leaf_digest(values).alias("digest"),
        F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), changed).alias("changed"),
    )
    # A null lang is a key of its own: no prefix, while a lang has one.
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).cast("binary")
    # Written first: the ranges are found by a pass of their own.
    hashed = settle(rows.select("doc_id", key.alias("key"), "digest", "changed"), "hashed")
    leaves = settle(ranked(hashed, ["key"], ["doc_id", "digest"]), "leaves")
    roots, layers = _layers(leaves.select("key", "pos", "total", "digest"), width, height)
    roots = settle(roots, "subroots")

    one = roots.select(F.lit(b"").alias("one"), F.col("key").alias("lang_key"), F.col("root").alias("digest"))
    top = settle(ranked(one, ["one"], ["lang_key"]).withColumnRenamed("one", "key"), "top-leaves")
    whole, top_layers = _layers(top.select("key", "pos", "total", "digest"), width, height)
    size = width**height
    top_paths = _descend(top, top_layers, None, width, height)
    # One more step down: from the subtrees of the top to its leaves, which are the languages.
    opened = _with_way(
        top.withColumn("block", F.floor(F.col("pos") / size).cast("long")),
        top_paths,
        _paths_of_block(width, height),
        f"key binary, block long, path {_PATH}",
    )
    by_lang = settle(
        opened.join(top.select(F.col("pos").alias("block"), "lang_key"), "block").select(F.col("lang_key").alias("key"), "path"),
        "top-paths",
    )
    paths = _descend(leaves, layers, by_lang, width, height)
    folded = _with_way(
        leaves.withColumn("block", F.floor(F.col("pos") / size).cast("long")),
        paths,
        _fold_block(width, height),
        "doc_id long, key binary, leaf string, proof_sha256 string, folded_root string",
    )
    row = whole.select("root").first()  # the one root of all
    root = F.lit(row[0] if row else None).cast("string")
    # Languages are few beside rows, but not bounded: their table is broadcast where its size allows.
    return (
        folded.join(broadcast_if_small(roots.withColumnRenamed("root", "subroot")), "key")
        .select(
            "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
            (F.col("folded_root") == root).alias("verified"),
        )
    )
