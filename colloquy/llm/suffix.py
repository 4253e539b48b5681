"""Bytes covered by long repeated strings, from per-shard suffix arrays.

Windows of ``length`` bytes are dealt out by content: each belongs to its
anchor, the gram with the least hash inside it (the first of equals). Equal
windows have equal anchors, so they can only repeat among the regions (runs of
windows with one anchor) of one gram. Regions are compared by hash first: what
has an equal twin repeats as a whole. Only of grams with different regions do
the bytes travel, each different region once. Many grams make a shard, which
is sorted by Larsson-Sadakane refinement and searched by the common prefixes of
neighbours (Kasai's, in the form that computes only what the position before
does not give). A gram with very many regions is cut into several shards, which
are merged by binary search among the sorted digests of their windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import IdFilter, prepare
from colloquy.llm.hashing import RangeHashes, mixed
from colloquy.session import settle

LENGTH = 400
#: Bytes of an anchor's gram.
GRAM = 100
#: Windows of a text that are dealt out at once.
CHUNK = 1 << 20
#: Bytes of a shard, about.
SHARD_BYTES = 1 << 21
#: Regions of one gram in a shard, about.
SHARD_REGIONS = 1024
POSITION_BITS = 24

REGION = "doc_id long, twin long, first long, windows long, gram long, content long, anchors long"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def regions(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """(first window, windows, gram's hash, content's hash, anchors) of the runs of windows with one gram."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at : at + CHUNK + length - 1]
        hashes = RangeHashes(part)
        grams = hashes.of_length(gram)
        position = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << POSITION_BITS) - 1)
        least = sliding_minimum((grams & ~low) | position, length - gram + 1)
        anchor = (least & low).astype(np.int64)
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        keys = grams[anchor[new]]
        # Neighbouring anchors with one gram (periodic text) are one region.
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        first = new[start]
        windows = np.diff(np.r_[first, len(anchor)])
        content = hashes.of(first, first + windows + length - 1) ^ mixed(windows.astype(np.uint64))
        for column, values in zip(out, (first + at, windows, keys[start], content, np.diff(np.r_[start, len(new)]))):
            column.append(values)
    empty = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return [np.concatenate([*c, np.zeros(0, k)]) for c, k in zip(out, empty)]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each), by Larsson-Sadakane refinement.

    Sorted by eight bytes first; then only groups that are not yet single are
    sorted again, by the rank of what follows at twice the distance each time.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(head, kind="stable")
    head = head[order]
    start = np.r_[True, head[1:] != head[:-1]][:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    slots = np.flatnonzero(~(start & np.r_[start[1:], True]))
    h = 8
    while len(slots):
        own = order[slots]
        after = own + h
        # Past the end: the shorter comes first.
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], n - 1 - after)
        key = rank[own] * (2 * n + 2 * h) + follow + n + h
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        start = np.r_[True, key[1:] != key[:-1]]
        rank[own] = np.maximum.accumulate(np.where(start, slots, 0))
        slots = slots[~(start & np.r_[start[1:], True])]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each slot of the order, the prefix it shares with the slot before (0 for the first).

    A suffix whose byte before equals that of its neighbour's shares one byte
    less than the suffix before it does; only the others are compared.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    at = np.arange(n)
    known = (at > 0) & (previous > 0)
    known[known] = text[at[known] - 1] == text[previous[known] - 1]
    # The neighbour of the suffix before must be the one before this neighbour.
    inherits = known.copy()
    inherits[known] = previous[at[known] - 1] == previous[known] - 1
    todo = np.flatnonzero(~inherits & (previous >= 0))
    lcp = np.zeros(n, np.int64)
    step = 16
    padded_a = np.r_[text.astype(np.int16), np.full(step, -1, np.int16)]
    padded_b = np.r_[text.astype(np.int16), np.full(step, -2, np.int16)]
    lane = np.arange(step)
    while len(todo):
        i, j = todo + lcp[todo], previous[todo] + lcp[todo]
        same = padded_a[np.minimum(i, n)[:, None] + lane] == padded_b[np.minimum(j, n)[:, None] + lane]
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        lcp[todo] += run
        todo = todo[run == step]
    base = np.maximum.accumulate(np.where(inherits, -1, at))
    lcp = np.where(inherits, np.maximum(lcp[base] - (at - base), 0), lcp)
    return lcp[order]


def repeated_windows(text: np.ndarray, owned: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which owned windows of a shard have the bytes of another owned one, and one of each different window.

    ``owned`` flags the windows by their first byte.
    """
    order, rank = suffix_array(text)
    lcp = common_prefixes(text, order, rank)
    run = np.cumsum(lcp < length)
    mine = owned[order]
    several = np.bincount(run, weights=mine, minlength=1 + (run[-1] if len(run) else 0)) > 1
    out = np.zeros(len(text), bool)
    out[order[mine & several[run]]] = True
    different = np.zeros(len(text), bool)
    found = order[mine]
    different[found[np.unique(run[mine], return_index=True)[1]]] = True
    return out, different


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id (a number also for null), twin (a hash of the text) and text; equal rows are equal in both."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
        F.xxhash64(text).alias("twin"),
        text.alias("text"),
    )


def all_regions(own: DataFrame, length: int, gram: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, twin, text in zip(*(batch[n].to_pylist() for n in ("doc_id", "twin", "text"))):
                first, windows, key, content, anchors = regions(np.frombuffer(text.encode(), np.uint8), length, gram)
                values = (
                    np.full(len(first), doc, np.int64), np.full(len(first), twin, np.int64),
                    first, windows, key.view(np.int64), content.view(np.int64), anchors,
                )
                for column, v in zip(columns, values):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in columns],
                [field.split()[0] for field in REGION.split(", ")],
            )

    return own.filter(F.octet_length("text") >= length).mapInArrow(cut, REGION)


def _shards(slices: DataFrame, length: int) -> DataFrame:
    """Repeated windows of single regions, as runs; and of cut grams the different windows.

    Those are packed by digest into as many buckets as the gram has shards,
    one row for each bucket. ``alone`` marks the windows that the shard has
    once only, of regions that stand once only.
    """
    shape = (
        "doc_id long, twin long, first long, last long, gram long, bucket long, digest array<long>, "
        "docs array<long>, twins array<long>, firsts array<long>, alone array<boolean>"
    )
    longs = pa.list_(pa.int64())
    kinds = (pa.int64(),) * 6 + (longs,) * 4 + (pa.list_(pa.bool_()),)
    names = [field.split()[0] for field in shape.split(", ")]

    def search(batches):
        def done(rows: pa.Table) -> pa.RecordBatch:
            texts = rows["bytes"].to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            begin = np.cumsum(sizes) - sizes
            text = np.frombuffer(b"".join(texts), np.uint8)
            windows = sizes - length + 1
            edge = np.zeros(len(text) + 1, np.int8)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + windows, -1)
            again, different = repeated_windows(text, np.cumsum(edge)[:-1].astype(bool), length)
            doc, twin, at, gram, part, cut, single = (
                rows[n].to_numpy() for n in ("doc_id", "twin", "first", "gram", "part", "cut", "single")
            )
            out = []
            for k in np.flatnonzero(single):
                for a, b in zip(*_runs(again[begin[k] : begin[k] + windows[k]])):
                    out.append((doc[k], twin[k], at[k] + a, at[k] + b, *(None,) * 7))
            start = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
            for a, b in zip(start, np.r_[start[1:], len(gram)]):
                if cut[a] < 2:
                    continue
                low, high = begin[a], begin[b - 1] + sizes[b - 1]
                chosen = np.flatnonzero(different[low:high])
                if not len(chosen):  # all are in other parts of the gram, in this array
                    continue
                which = np.searchsorted(begin[a:b], chosen + low, side="right") - 1 + a
                digest = RangeHashes(text[low:high]).of(chosen, chosen + length).view(np.int64)
                firsts = at[which] + chosen + low - begin[which]
                alone = ~again[low:high][chosen] & single[which]
                bucket = digest % cut[a]
                order = np.lexsort((digest, bucket))
                for same in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    packed = (v[same] for v in (digest, doc[which], twin[which], firsts, alone))
                    out.append((None, None, None, None, gram[a], bucket[same[0]], *packed))
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while len(batch):
                # Up to the end of a shard's group of equal (gram, part), if this batch has it.
                held.append(batch)
                size += batch["bytes"].nbytes
                if size < SHARD_BYTES:
                    break
                rows = pa.Table.from_batches(held)
                gram, part = rows["gram"].to_numpy(), rows["part"].to_numpy()
                ends = np.flatnonzero((gram[1:] != gram[:-1]) | (part[1:] != part[:-1])) + 1
                if not len(ends):
                    break
                heights = np.cumsum(rows["size"].to_numpy())
                # The last end within the shard's size, or else the first.
                k = max(0, int(np.searchsorted(heights[ends - 1], SHARD_BYTES, side="right")) - 1)
                yield done(rows.slice(0, ends[k]))
                rest = rows.slice(ends[k]).combine_chunks().to_batches()
                held, size = [], 0
                batch = rest[0] if rest else batch.slice(0, 0)
        if held:
            yield done(pa.Table.from_batches(held))

    return slices.mapInArrow(search, shape)


def _merged_shards(packed: DataFrame) -> DataFrame:
    """Of the windows of cut grams those that another shard has too, as runs of one."""

    def merge(rows: pa.Table) -> pa.Table:
        digest, doc, twin, first, alone = (
            np.concatenate([c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in rows[n].chunks])
            for n in ("digest", "docs", "twins", "firsts", "alone")
        )
        ordered = np.sort(digest)
        shards = np.searchsorted(ordered, digest, side="right") - np.searchsorted(ordered, digest, side="left")
        found = (shards > 1) & alone
        return pa.table({"doc_id": doc[found], "twin": twin[found], "first": first[found], "last": first[found]})

    return packed.groupBy("gram", "bucket").applyInArrow(merge, "doc_id long, twin long, first long, last long")


def repeated_runs(own: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, twin, first, last): runs of windows of a document that also stand elsewhere."""
    cut = settle(all_regions(own, length, gram), "regions")
    contents = settle(
        cut.groupBy("gram", "content").agg(
            F.count("*").alias("twins"),
            F.max("anchors").alias("anchors"),
            F.min(F.struct("doc_id", "twin", "first", "windows")).alias("one"),
        ),
        "contents",
    )
    whole = (
        cut.join(contents.filter("twins > 1").select("gram", "content"), ["gram", "content"])
        .select("doc_id", "twin", "first", (F.col("first") + F.col("windows") - 1).alias("last"))
    )
    compared = (
        contents.groupBy("gram")
        .agg(
            F.count("*").alias("different"),
            F.max("anchors").alias("most"),
            F.max((F.col("twins") == 1).cast("int")).alias("single"),
        )
        .filter("single = 1 and (different > 1 or most > 1)")
        .select("gram", F.ceil(F.col("different") / SHARD_REGIONS).cast("int").alias("cut"))
    )
    wanted = settle(
        contents.join(compared, "gram").select(
            "one.*", "gram", (F.col("twins") == 1).alias("single"), "cut",
            F.pmod(F.col("content"), F.col("cut")).alias("part"),
        ),
        "wanted",
    )
    parts = wanted.groupBy("doc_id", "twin").agg(
        F.collect_list(F.struct("first", "windows", "gram", "single", "cut", "part")).alias("regions")
    )
    shape = (
        "doc_id long, twin long, first long, gram long, single boolean, cut int, part long, size long, bytes binary"
    )

    def slice_(batches):
        for batch in batches:
            rows = []
            for doc, twin, text, found in zip(*(batch[n].to_pylist() for n in ("doc_id", "twin", "text", "regions"))):
                raw = text.encode()
                for r in found:
                    piece = raw[r["first"] : r["first"] + r["windows"] + length - 1]
                    rows.append((doc, twin, r["first"], r["gram"], r["single"], r["cut"], r["part"], len(piece), piece))
            kinds = (pa.int64(),) * 4 + (pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows)) or [()] * 9
            for k in range(0, max(1, len(rows)), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[k : k + 4096], t) for c, t in zip(columns, kinds)],
                    [field.split()[0] for field in shape.split(", ")],
                )

    slices = (
        IdFilter(wanted, ["doc_id", "twin"]).keep(own)
        .join(parts, ["doc_id", "twin"])
        .mapInArrow(slice_, shape)
        .repartition("gram", "part")
        .sortWithinPartitions("gram", "part")
    )
    found = settle(_shards(slices, length), "shards")
    again = found.filter("gram is null").select("doc_id", "twin", "first", "last")
    crossed = _merged_shards(
        found.filter("gram is not null").select("gram", "bucket", "digest", "docs", "twins", "firsts", "alone")
    )
    return whole.unionByName(again).unionByName(crossed)


def without_repeats(raw: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    edges: list[list[int]] = []
    for first, last in sorted(runs):
        if edges and first <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], last + length)
        else:
            edges.append([first, last + length])
    kept, at = [], 0
    for a, b in edges:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return sum(b - a for a, b in edges), len(edges), b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes each byte that a ``length``-byte string covers which also starts elsewhere.

    ``docs`` has doc_id and text. Strings are judged on the input, within and
    across documents; matches never cross documents. Returns doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 and kept (the bytes left). A null text is
    empty. Repeated rows count and are returned each. A null doc_id stays null.
    Extra columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    own = _identified(docs)
    runs = settle(repeated_runs(own, length, gram), "runs")
    lists = runs.distinct().groupBy("doc_id", "twin").agg(
        F.collect_list(F.struct("first", "last")).alias("runs")  # of one document
    )
    affected = IdFilter(runs, ["doc_id", "twin"])
    touched = affected.keep(own).join(lists, ["doc_id", "twin"], "left").select("doc_id", "text", "runs")
    others = affected.keep(own, found=False).select("doc_id", "text", F.lit(None).cast(lists.schema["runs"].dataType).alias("runs"))

    def remove(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch["text"].to_pylist(), batch["runs"].to_pylist()):
                raw = text.encode()
                removed, spans, kept = without_repeats(raw, [(r["first"], r["last"]) for r in found or ()], length)
                rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = touched.unionByName(others).mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))
