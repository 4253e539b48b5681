"""What the corpus operators share: session set-up, tables, ASCII case."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import tune

#: Bytes up to which a table is broadcast, as its rows' JSON measures them.
BROADCAST_BYTES = 8 << 20
#: Bits of a broadcast set of hashed ids.
FILTER_BITS = 25
#: Rows in an Arrow batch: a batch of very long texts must fit beside the task.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; ``lower`` would change other letters too."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def is_small(df: DataFrame) -> bool:
    """Whether the measured size of a written table allows to broadcast it.

    The size of its files says too much where many tasks wrote few rows each.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Marks a written table for broadcasting where its size allows; else a join shuffles."""
    return F.broadcast(df) if is_small(df) else df


class IdFilter:
    """A set of hashed ids with a fixed number of bits, broadcast to skip rows before a shuffle.

    It lets all rows through whose id is in the set, and some others; a join
    decides. However many ids there are, it has 2**FILTER_BITS bits.
    """

    def __init__(self, ids: DataFrame, columns: list[str]):
        self.columns = columns
        at = self._at()
        one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        rows = (
            ids.select(F.shiftright(at, 6).cast("int").alias("k"), one.alias("b"))
            .groupBy("k")
            .agg(F.bit_or("b").alias("b"))
            .toArrow()  # at most 2**FILTER_BITS / 64 rows
        )
        bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        bits[rows["k"].to_numpy()] = rows["b"].to_numpy()
        self.sent = ids.sparkSession.sparkContext.broadcast(bits)

    def _at(self) -> Column:
        return F.xxhash64(*self.columns).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))

    def keep(self, df: DataFrame, found: bool = True) -> DataFrame:
        """The rows that may be in the set, or those that surely are not."""
        sent = self.sent

        def chosen(batches):
            bits = sent.value
            for batch in batches:
                at = batch["_at"].to_numpy(zero_copy_only=False)
                inside = ((bits[at >> 6] >> (at & 63)) & 1).astype(bool)
                yield batch.filter(pa.array(inside == found)).drop_columns("_at")

        return df.withColumn("_at", self._at()).mapInArrow(chosen, df.schema)
