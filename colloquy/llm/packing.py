"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised where they are read and only their lengths travel. The
packing itself is planned on the histogram of lengths, which has at most
``capacity`` entries whatever the number of documents: a plan is a list of bin
contents with how many bins have them. Each piece then finds its bin from its
rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import prepare
from colloquy.session import settle

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
#: Pieces of one length and salt that are ranked together, on average at most.
RANKED_TOGETHER = 1 << 18
#: Its text is one id to the tokenizer, so texts that hold it take the slow path.
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoders(vocabulary: str):
    """The merge ranks and the tokenizer file of one vocabulary; ids are equal (tested)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return fast, Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def token_ids(text: str | None, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> np.ndarray:
    """A text's ids and the end id; null is empty."""
    fast, plain = _encoders(vocabulary)
    if text and SPECIAL in text:
        ids = plain.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text or "")
    return np.array([*ids, end_id], dtype="<u4")


def cuts(length: int, capacity: int) -> list[int]:
    """Starts of a document's pieces and its end; only the first piece may be short."""
    return [0, *range((length - 1) % capacity + 1, length + 1, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    def tokenise(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = token_ids(text, vocabulary)
                at = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tokenise, PIECES
    )


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, their content as (length, how many)) for a histogram of lengths.

    Pieces above a third of the capacity are matched first, the longest with
    the longest that still fits, so at most two share a bin. The others go, in
    falling length, to the smallest gap they fit; all bins of equal gap are
    filled at once.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    gaps: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in (m for m in large if m <= min(n, capacity - n)):
            if not left[n]:
                break
            if m == n:
                pairs, inside = left[n] // 2, [(n, 2)]
                left[n] -= 2 * pairs
            else:
                pairs, inside = min(left[n], left[m]), [(n, 1), (m, 1)]
                left[n] -= pairs
                left[m] -= pairs
            if pairs:
                gaps[capacity - n - m].append((pairs, inside))
        if left[n]:
            gaps[capacity - n].append((left[n], [(n, 1)]))
            left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count, gap = left[n], n
        while count:
            while gap < capacity and not gaps[gap]:
                gap += 1
            bins, inside = gaps[gap].pop() if gaps[gap] else (count, [])
            each = min(gap // n, count)
            taken = min(bins, count // each)
            if inside and bins > taken:
                gaps[gap].append((bins - taken, inside))
            gaps[gap - each * n].append((taken, [*inside, (n, each)]))
            count -= taken * each
    return [bins for same in gaps for bins in same]


def segments(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: which ranks go to which bins and where in them.

    A segment's pieces fill its bins in order, ``each`` to a bin.
    """
    ranks: dict[int, int] = {}
    rows, first_bin = [], 0
    for bins, inside in plan:
        offset = 0
        for length, each in inside:
            rank = ranks.get(length, 0)
            rows.append((length, rank, each, first_bin, offset))
            ranks[length] = rank + bins * each
            offset += length * each
        first_bin += bins
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "first_bin", "offset"), columns))


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and its place there.

    A null or empty text is the end id alone. Repeated rows are packed each;
    a null doc_id stays null. Extra columns are ignored. An empty table gives
    no rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, capacity, vocabulary), "pieces")
    # At most ``capacity`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # The number of segments depends on the capacity only.
    where = spark.sparkContext.broadcast(segments(plan_bins(histogram, capacity)))
    salts = max(64, sum(histogram.values()) // RANKED_TOGETHER)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"),
        )
        .select("length", "salt", "before")
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )

    def place(batches):
        at = where.value
        keys = (at["length"] << 48) | at["rank"]
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            nth = rank - at["rank"][k]
            each = at["each"][k]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(at["first_bin"][k] + nth // each),
                    pa.array(at["offset"][k] + nth % each * length),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
