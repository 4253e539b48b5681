"""Which speech model a meeting uses, and what that still needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.schema import (
    ALWAYS_NEEDED_MODEL,
    DEFAULT_LANGUAGE,
    languages,
    model_choices,
    model_support,
)


def known_language(meetings: DataFrame) -> DataFrame:
    """Unknown languages read as the default one."""
    known = languages(meetings.sparkSession).select(
        F.col("language").alias("_raw"), F.lit(True).alias("_known")
    )
    return (
        meetings.withColumnRenamed("language", "_raw")
        .join(F.broadcast(known), "_raw", "left")
        .withColumn(
            "language", F.when(F.col("_known"), F.col("_raw")).otherwise(F.lit(DEFAULT_LANGUAGE))
        )
        .drop("_raw", "_known")
    )


def model_routing(meetings: DataFrame) -> DataFrame:
    """The recorded or assumed model, whether it fits the language, and the estimate."""
    spark = meetings.sparkSession
    defaults = languages(spark).select("language", "default_model")
    offered = (
        model_choices(spark)
        .groupBy("language")
        .agg(F.array_sort(F.collect_list(F.struct("choice_pos", "model"))).alias("_offered"))
        .select("language", F.array_join("_offered.model", ",").alias("choices"))
    )
    routed = (
        meetings.join(F.broadcast(defaults), "language")
        .join(F.broadcast(offered), "language")
        .withColumn("model", F.coalesce("model", "default_model"))
    )
    return routed.join(
        F.broadcast(model_support(spark)), ["model", "language"], "left"
    ).withColumns(
        {
            "supported": F.coalesce("supported", F.lit(False)),
            "minutes": F.col("duration") / 3600 * F.col("minutes_per_hour"),
        }
    )


def parse_remembered(rows: DataFrame, stored: str) -> DataFrame:
    """``language=model;…`` memories as rows, only those still offered; last one wins."""
    entry = F.split("_entry", "=", 2)
    parsed = (
        rows.select("*", F.posexplode(F.split(stored, ";", -1)).alias("_pos", "_entry"))
        .where(F.size(entry) == 2)
        .withColumns({"language": entry[0], "model": entry[1]})
    )
    keys = [c for c in rows.columns if c != stored]
    offered = model_choices(rows.sparkSession).select("language", "model")
    return (
        parsed.join(F.broadcast(offered), ["language", "model"], "left_semi")
        .groupBy(*keys, "language")
        .agg(F.max_by("model", "_pos").alias("model"))
    )


def write_remembered(memories: DataFrame, keys: list[str]) -> DataFrame:
    """Memories in their canonical text form (at most one entry per language)."""
    entry = F.concat("language", F.lit("="), "model")
    return memories.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("stored")
    )


def needed_models(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Downloads the chosen languages need, plus the one always needed, minus those here.

    ``wanted(language)`` may repeat; ``present(model)`` is installed or queued.
    """
    spark = wanted.sparkSession
    downloads = model_support(spark).where("is_download").select("model").distinct()
    chosen = (
        wanted.select("language")
        .distinct()
        .join(F.broadcast(languages(spark).select("language", "default_model")), "language")
        .select(F.col("default_model").alias("model"))
        .join(F.broadcast(downloads), "model", "left_semi")
    )
    always = spark.range(1).select(F.lit(ALWAYS_NEEDED_MODEL).alias("model"))
    return chosen.unionByName(always).distinct().join(present, "model", "left_anti")


def download_remaining(queue: DataFrame) -> DataFrame:
    """Bytes still to fetch; ``queue(state, bytes)``."""
    return queue.where(F.col("state").isin("queued", "downloading")).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("remaining_bytes"),
        F.count("*").alias("items"),
    )


def resolve_locale(requests: DataFrame, locales: DataFrame) -> DataFrame:
    """The locale to recognise with: the user's region, else the home region, else any.

    ``requests(request_id, language, region)``, ``locales(locale_pos, code, region)``.
    """
    homes = languages(requests.sparkSession).select("language", "code", "home_region")
    offered = locales.select("locale_pos", "code", F.col("region").alias("_region"))
    rank = (
        F.when(F.col("_region") == F.col("region"), 0)
        .when(F.col("_region") == F.col("home_region"), 1)
        .otherwise(2)
    )
    return (
        requests.join(F.broadcast(homes), "language")
        .join(offered, "code")
        .groupBy("request_id", "language", "region")
        .agg(
            F.min_by(
                F.concat("code", F.lit("-"), "_region"), F.struct(rank.alias("r"), "locale_pos")
            ).alias("locale")
        )
    )


def friendly_app_name(bundle: Column, fallback: Column) -> Column:
    """Browser names for the helper processes that play their sound."""
    # Process identifiers and the names shown for them.
    return (
        F.when(bundle.isNull(), fallback)
        .when(bundle == "com.apple.WebKit.GPU", "Safari")
        .when(bundle.startswith("com.google.Chrome"), "Google Chrome")
        .when(bundle.startswith("com.microsoft.edgemac"), "Microsoft Edge")
        .when(bundle.startswith("org.mozilla.firefox"), "Firefox")
        .otherwise(fallback)
    )


def seek_time(seconds: Column) -> Column:
    """Rounded up to a whole sample, so a seek never lands before the word."""
    return F.ceil(seconds * 44_100) / F.lit(44_100.0)
