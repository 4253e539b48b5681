"""The exact value at a given rank per key, without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Histogram bins per unit of the value.
BINS_PER_UNIT = 1024


def value_at_rank(
    df: DataFrame, keys: Sequence[str], value: str, rank: Column, name: str
) -> DataFrame:
    """Per key: its row count ``_n`` and the value at a zero-based ascending rank.

    ``rank`` is an expression over ``_n``. A histogram (aggregated map-side)
    finds the bin that holds the rank; only that bin's distinct values, with
    their counts, are then ordered.
    """
    binned = df.withColumn("_bin", F.floor(F.col(value) * BINS_PER_UNIT).cast("long"))
    histogram = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_in_bin"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    target = (
        histogram.select(
            *keys,
            "_bin",
            "_in_bin",
            F.sum("_in_bin").over(by_key).alias("_n"),
            F.coalesce(F.sum("_in_bin").over(before), F.lit(0)).alias("_before"),
        )
        .withColumn("_rank", rank - F.col("_before"))
        .where("_rank >= 0 AND _rank < _in_bin")
        .select(*keys, "_bin", "_n", "_rank")
    )
    values = (
        binned.join(target, [*keys, "_bin"])
        .groupBy(*keys, "_n", "_rank", F.col(value).alias(name))
        .agg(F.count("*").alias("_copies"))
    )
    upto = Window.partitionBy(*keys).orderBy(name)
    return (
        values.withColumn("_upto", F.sum("_copies").over(upto))
        .where("_upto > _rank AND _upto - _copies <= _rank")
        .select(*keys, "_n", name)
    )
