"""Ordered scans (running sum, max, last value, row number) without one task per key.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task. Here the order is cut into chunks first: windows run inside
``(key, chunk)``, one summary row per chunk is aggregated map-side, and only the
summaries are scanned per key. A key with a third of all rows is spread over as
many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per chunk for tables ordered by a dense integer position.
CHUNK = 65_536

_MERGE = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
}


def position_chunk(position: str | Column, size: int = CHUNK) -> Column:
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(size)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    scans: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Adds one running column per entry of ``scans``.

    ``scans`` maps an output name to ``(kind, expression)`` with kind one of
    ``sum``, ``max``, ``min`` and ``last`` (last non-null value). ``chunk`` must
    be non-decreasing along ``order`` within a key, and ``order`` ascending
    expressions (negate a number to scan backwards). With ``inclusive=False`` the
    current row is left out; a sum over nothing is 0, anything else null.
    """
    names = list(scans)
    marked = df.withColumn("_chunk", chunk)
    for name in names:
        marked = marked.withColumn(f"_in_{name}", scans[name][1])

    end = Window.currentRow if inclusive else -1
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    local = marked.select(
        "*",
        *[
            (
                F.last(f"_in_{n}", ignorenulls=True)
                if scans[n][0] == "last"
                else _MERGE[scans[n][0]](f"_in_{n}")
            )
            .over(inside)
            .alias(f"_local_{n}")
            for n in names
        ],
    )

    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    totals = marked.groupBy(*keys, "_chunk").agg(
        *[
            (
                F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), position))
                if scans[n][0] == "last"
                else _MERGE[scans[n][0]](f"_in_{n}")
            ).alias(f"_total_{n}")
            for n in names
        ]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        "_chunk",
        *[
            (
                F.last(f"_total_{n}", ignorenulls=True)
                if scans[n][0] == "last"
                else _MERGE[scans[n][0]](f"_total_{n}")
            )
            .over(before)
            .alias(f"_carry_{n}")
            for n in names
        ],
    ).where(_any([F.col(f"_carry_{n}").isNotNull() for n in names]))

    joined = local.join(carry, [*keys, "_chunk"], "left")
    out = [F.col(c) for c in df.columns]
    for n in names:
        here, carried = F.col(f"_local_{n}"), F.col(f"_carry_{n}")
        kind = scans[n][0]
        if kind == "sum":
            zero = F.lit(0)
            value = F.coalesce(here, zero) + F.coalesce(carried, zero)
        elif kind == "last":
            value = F.coalesce(here, carried)
        elif kind == "max":
            value = F.when(carried.isNull() | (here >= carried), here).otherwise(carried)
        else:
            value = F.when(carried.isNull() | (here <= carried), here).otherwise(carried)
        if kind in ("max", "min"):
            value = F.when(here.isNull(), carried).otherwise(value)
        out.append(value.alias(n))
    return joined.select(*out)


def ordinal(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """Adds the zero-based position of each row within its key."""
    return running(
        df, keys, chunk, order, {name: ("sum", F.lit(1).cast("long"))}, inclusive=False
    )


def _any(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result
