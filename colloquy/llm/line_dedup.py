"""Repeated lines across documents, found with levelled sorted runs of line hashes.

The distinct line keys of the documents come in batches, the largest document
ids first. A batch is aggregated by key and merge-anti-joined with the runs of
the batches before: keys without a run yet get their keeper from this batch,
known ones only add their count. The batch's rows become a run of level 0;
``fanout`` runs of a level are compacted into one of the next.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import prepare
from colloquy.session import settle

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None for keys that are too short."""
    bare = line.strip(SPACE)
    if len(bare) < min_chars:
        return None
    return xxhash.xxh3_128_digest(bare.encode().lower())  # bytes: A-Z only


class SortedRuns:
    """Runs of (key, n_docs, keeper), each sorted by key, in levels."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        found = [run for level in self.levels for run in level]
        out = found[0] if found else None
        for run in found[1:]:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Adds a batch's (key, n_docs, keeper), one row for each key."""
        known = self.all()
        if known is not None:
            keys = known.select("key").hint("merge")
            fresh = batch.join(keys, "key", "left_anti")
            again = batch.join(keys, "key", "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            batch = fresh.unionByName(again)
        self._put(0, batch)

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(settle(rows.sortWithinPartitions("key"), f"run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def merged(self) -> DataFrame:
        return self._merged([run for level in self.levels for run in level])


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key) for the distinct long line keys of each document."""

    def keys(batches):
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars))}
                ids += [doc] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "key"]
            )

    return (
        docs.filter(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(keys, "doc_id long, key binary")
    )


def repeated_lines(
    docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int
) -> DataFrame:
    """(doc_id, dropped keys) of the documents that lose lines."""
    spark = docs.sparkSession
    entries = settle(line_keys(docs, min_chars).distinct(), "line-keys")
    low, high = entries.agg(F.min("doc_id"), F.max("doc_id")).first()
    runs = SortedRuns(spark, fanout)
    low, high = (0, 0) if low is None else (low, high)
    edges = [low + (high - low + 1) * k // batches for k in range(batches + 1)]
    for a, b in list(zip(edges, edges[1:]))[::-1]:
        runs.add(
            entries.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b))
            .groupBy("key")
            .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        )
    common = runs.merged().filter(F.col("n_docs") >= min_docs).select("key", "keeper")
    return (
        entries.join(common, "key")
        .filter(F.col("doc_id") < F.col("keeper"))
        .groupBy("doc_id")
        .agg(F.collect_list("key").alias("_dropped"))  # at most a document's own lines
    )


def without(text: str | None, dropped: set[bytes], min_chars: int) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    kept = [x for x in lines if line_key(x, min_chars) not in dropped] if dropped else lines
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def deduplicate_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    texts: bool = True,
) -> DataFrame:
    """Drops long lines held by many documents, except in the largest doc_id.

    Returns the columns of ``docs`` with the new ``text`` (and ``n_chars``,
    where there is one), or, without ``texts``, doc_id, n_lines, n_dropped and
    kept_sha256. A null or empty text is one empty line; a null text that
    loses nothing stays null. Rows with the same doc_id are one document to the
    counts and each lose their lines. Rows with a null doc_id hold no line and
    lose none. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    lost = repeated_lines(docs, min_chars, min_docs, batches, fanout)
    own = docs if texts else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    place = {n: f"_{k}" for k, n in enumerate(own.columns)}  # no clash with what is added
    names = list(place.values())
    doc_id, text_, n_chars = place["doc_id"], place["text"], place.get("n_chars")
    both = (
        own.toDF(*names)
        .join(lost.select(F.col("doc_id").alias(doc_id), "_dropped"), doc_id, "left")
        .select(*names, "_dropped")
    )

    def drop(batches_):
        for batch in batches_:
            rows = [
                without(text, set(dropped or ()), min_chars)
                for text, dropped in zip(batch[text_].to_pylist(), batch["_dropped"].to_pylist())
            ]
            if texts:
                columns = {n: batch[n] for n in names}
                olds = batch[text_].to_pylist()
                news = [old if not n else new for old, (_, n, new) in zip(olds, rows)]
                columns[text_] = pa.array(news, pa.string())
                if n_chars:
                    olds = columns[n_chars].to_pylist()
                    news = [len(new) if n else old for old, (_, n, new) in zip(olds, rows)]
                    columns[n_chars] = pa.array(news, columns[n_chars].type)
                yield pa.RecordBatch.from_pydict(columns)
            else:
                digests = [hashlib.sha256(kept.encode()).hexdigest() for _, _, kept in rows]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch[doc_id],
                        "n_lines": pa.array([r[0] for r in rows], pa.int64()),
                        "n_dropped": pa.array([r[1] for r in rows], pa.int64()),
                        "kept_sha256": pa.array(digests, pa.string()),
                    }
                )

    if texts:
        return both.mapInArrow(drop, own.toDF(*names).schema).toDF(*own.columns)
    return both.mapInArrow(drop, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
