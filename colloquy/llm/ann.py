"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred and turned by a rotation that is learnt on a bounded
sample (iterative quantisation), and become their signs: 64-bit codes. Codes
are split into substrings of 8 bits. By the pigeonhole principle a code within
radius r of the query's agrees with it up to r // substrings in one of them, so
probing all values that near in every substring index finds every code within
r. What is found is ranked by true distance.

Vectors that are equal are one entry of the index, with their smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import prepare
from colloquy.session import settle

NEIGHBOURS = 10
QUERY_EVERY = 100
#: Rows that the rotation and the radius are learnt on at most, by hash of the vector.
SAMPLE = 20_000
#: Sampled queries for the radius, and the share of true neighbours it must cover.
RADIUS_QUERIES = 200
RADIUS_SHARE = 0.97
ROUNDS = 30
BITS = 64
PART = 8
#: Vectors in a block of the index, about; a block is indexed and probed in one task.
BLOCK = 8192
#: Queries that probe a block together, about.
QUERY_BLOCK = 2048


class Codes:
    """The learnt centre, rotation and radius."""

    def __init__(self, sample: np.ndarray, neighbours: int = NEIGHBOURS, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] if sample.ndim == 2 else 0
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(width)
        x = sample - self.centre
        # Directions of most variance first; more bits than those come from random ones.
        _, axes = np.linalg.eigh(x.T @ x + 1e-12 * np.eye(width))
        axes = axes[:, ::-1]
        while axes.shape[1] < BITS:
            axes = np.c_[axes, np.linalg.qr(rng.standard_normal((width, width)))[0]]
        axes = axes[:, :BITS]
        turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
        z = x @ axes
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ vt).T
        self.rotation = axes @ turn
        self.radius = self._radius(sample, neighbours)

    def of(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.centre) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()

    def _radius(self, sample: np.ndarray, neighbours: int) -> int:
        """Least radius that holds the wanted share of the sample's own neighbours.

        In the whole table neighbours are nearer than in a sample of it.
        """
        if len(sample) < 2:
            return BITS
        code, found = self.of(sample), []
        norm = (sample**2).sum(axis=1)
        for k in range(0, len(sample), max(1, len(sample) // RADIUS_QUERIES)):
            d = norm - 2 * sample @ sample[k]
            d[k] = np.inf
            near = np.argsort(d, kind="stable")[: min(neighbours, len(sample) - 1)]
            found.append(np.bitwise_count(code[near] ^ code[k]))
        return int(np.quantile(np.concatenate(found), RADIUS_SHARE, method="higher"))


class Index:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(np.uint8).reshape(-1, BITS // PART)
        self.order = np.argsort(self.parts, axis=0, kind="stable")
        self.first = np.stack(
            [np.searchsorted(self.parts[self.order[:, k], k], np.arange(257)) for k in range(BITS // PART)]
        )

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        hit = np.zeros(len(self.codes), bool)
        parts = np.array([code]).view(np.uint8)
        near = _BALLS[min(PART, radius // (BITS // PART))]
        for k, part in enumerate(parts):
            values = near ^ part
            for a, b in zip(self.first[k, values], self.first[k, values.astype(np.int64) + 1]):
                hit[self.order[a:b, k]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


_VALUES = np.arange(1 << PART, dtype=np.uint8)
_BALLS = [_VALUES[np.bitwise_count(_VALUES) <= r] for r in range(PART + 1)]


def search_block(index: Index, vectors: np.ndarray, query: np.ndarray, code: np.uint64, radius: int, wanted: int):
    """(rows, distances) of the nearest found, with more than ``wanted`` where distances tie.

    The radius grows until enough are found, or the block is exhausted.
    """
    rows = index.within(code, radius)
    while len(rows) < min(wanted, len(vectors)):
        radius += BITS // PART
        rows = index.within(code, radius)
    away = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
    if len(rows) > wanted:
        keep = away <= np.partition(away, wanted - 1)[wanted - 1]
        rows, away = rows[keep], away[keep]
    return rows, away


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles, of the table's usual width."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    )
    return rows


def nearest_neighbours(
    vectors: DataFrame, neighbours: int = NEIGHBOURS, query_every: int = QUERY_EVERY
) -> DataFrame:
    """The nearest found of every query: query_id, rank (from 1), vec_id, score.

    ``vectors`` has vec_id and embedding. Queries are the rows whose vec_id
    ``query_every`` divides; candidates are all rows with another vec_id. The
    score is the Euclidean distance in double precision; ties go to the
    smaller vec_id. Null and zero vectors, those that hold null or non-finite
    components, and rows without vec_id take no part, nor do vectors of
    another width than most have. Rows that repeat a vec_id and its vector
    count once. Extra columns are ignored. An empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    good = usable(vectors)
    width = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = width["w"] if width else 0
    good = good.filter(F.size("v") == width)
    # Copies are one entry. No query sees more than its own id and ``neighbours`` others of them.
    by_key = Window.partitionBy("key", "v").orderBy("vec_id")
    # A hot vector's ids are thinned out in salted groups first.
    salted = Window.partitionBy("key", "v", "salt").orderBy("vec_id")
    entries = settle(
        good.distinct()
        .withColumn("key", F.xxhash64("v"))
        .withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        .withColumn("n", F.row_number().over(salted))
        .filter(F.col("n") <= neighbours + 1)
        .withColumn("n", F.row_number().over(by_key))
        .filter(F.col("n") <= neighbours + 1)
        .groupBy("key", "v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "vectors",
    )
    sample = entries.select("key", "v").orderBy("key", "v").limit(SAMPLE).toArrow()["v"]
    flat = sample.combine_chunks().flatten().to_numpy() if len(sample) else np.zeros(0)
    model = spark.sparkContext.broadcast(Codes(flat.reshape(-1, max(1, width)), neighbours))
    queries = good.filter(F.col("vec_id") % query_every == 0).distinct()
    n, n_queries = entries.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    query_block = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))
    # The stated query set against all rows, in blocks: every block of the
    # index meets every block of queries in a task of its own.
    index_rows = entries.select(
        F.pmod("key", F.lit(blocks)).cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
        "v",
        "ids",
    )
    query_rows = queries.select(block.alias("b"), query_block.cast("int").alias("q"), "vec_id", "v")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = model.value
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            x = left["v"].combine_chunks().flatten().to_numpy().reshape(left.num_rows, -1)
            y = right["v"].combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1)
            ids, index = left["ids"].to_pylist(), Index(codes.of(x))
            for query_id, query, code in zip(right["vec_id"].to_pylist(), y, codes.of(y)):
                # One more, as the query itself may be among them.
                rows, away = search_block(index, x, query, code, codes.radius, neighbours + 1)
                found = sorted(
                    (d, i) for r, d in zip(rows.tolist(), away.tolist()) for i in ids[r] if i != query_id
                )[:neighbours]
                out[0].append(np.full(len(found), query_id, np.int64))
                out[1].append(np.array([i for _, i in found], np.int64))
                out[2].append(np.array([d for d, _ in found], np.float64))
        empty = (np.int64, np.int64, np.float64)
        columns = [np.concatenate([*c, np.zeros(0, k)]) for c, k in zip(out, empty)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = (
        index_rows.groupBy("b", "q")
        .cogroup(query_rows.groupBy("b", "q"))
        .applyInArrow(probe, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # ``neighbours`` rows from each block
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )
