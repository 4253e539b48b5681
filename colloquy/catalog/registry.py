"""Named queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.catalog.base_sql import BASE
from colloquy.session import tune
from colloquy.sources.adapters import DriverTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Value decimals kept in results that go through floating-point sums.
DIGITS = 6


def query(name: str, select: str | None = None, extra: str = ""):
    """Registers a query; ``select`` (with further CTEs in ``extra``) is its SQL."""

    def register(build: Callable[[DriverTables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(DriverTables(tune(spark), folder))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if select is not None:
            ORACLES[name] = BASE + (f",\n{extra.strip()}" if extra else "") + "\n" + select.strip()
        return build

    return register
