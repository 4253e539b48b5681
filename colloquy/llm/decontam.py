"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

A window is a run of an item's words, and a document holds it only where it
holds all its words in order. So one necessary word is enough to find it: the
rarest, by how often the documents have it. Documents give their word
positions once; those on a necessary word are tried at the places and lengths
it has in windows, where their own place leaves room. So a word gives at most
as many candidates as a window has places, however many windows need it. Each
candidate is then joined to the windows that are equal to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import ascii_lower, broadcast_if_small, is_small, prepare
from colloquy.session import settle

WINDOW = 10
#: What separates words: everything in ASCII that is not a letter or a digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word begins like this, so it marks a document's own row; the marks are salted.
END, MARKS = "\x00", 64


def words(text: Column) -> Column:
    """The text's words; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window, at) with every run of ``window`` words, or the shorter item."""
    own = items.select(F.col("item_id").cast("long"), words(F.col("text").cast("string")).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    return (
        own.filter(F.size("w") > 0)
        .select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item_id", F.slice("w", F.col("at") + 1, window).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def necessary_words(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window's rarest word among all words of the documents, with its place in it."""
    each = found.select("window", "item_ids", F.posexplode("window").alias("place", "word"))
    vocabulary = settle(each.select("word").distinct(), "vocabulary")
    told = docs.select(F.explode(words(F.col("text"))).alias("word"))
    small = is_small(vocabulary)
    if small:
        told = told.join(F.broadcast(vocabulary), "word")
    counted = told.groupBy("word").agg(F.count("*").alias("n"))
    if small:  # it has no other words
        counted = F.broadcast(counted)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("r")
    return (
        each.join(counted, "word", "left")
        .groupBy("window")
        .agg(rarest, F.first("item_ids").alias("item_ids"))
        .select(F.col("r.word").alias("word"), F.col("r.place").alias("place"), "window", "item_ids")
    )


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """How much of each document is in benchmark items.

    ``docs`` has doc_id and text, ``items`` item_id and text. Returns doc_id,
    n_words, n_hit (words inside an occurrence of a window), n_items,
    items_sha256 (of those item_ids, sorted as strings, with commas) and
    contaminated. Null texts have no words; items without words are never
    found, nor do items with a null item_id count. Repeated rows are returned
    each. Extra columns are ignored. Empty tables give no rows, or none hit.
    """
    spark = prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prefix = settle(necessary_words(settle(windows(items, window), "windows"), own), "prefixes")
    tries = F.collect_set(F.struct("place", F.size("window").alias("long")))
    probes = settle(prefix.groupBy("word").agg(tries.alias("tries")), "probes")
    marks = spark.range(MARKS).select(F.concat(F.lit(END), F.col("id").cast("string")).alias("word"))
    mark = F.concat(F.lit(END), F.pmod("row", F.lit(MARKS)).cast("string"))
    pos, at = F.col("pos"), F.col("at")
    if is_small(probes):
        around, inner = F.col("w"), pos
        probes = F.broadcast(probes.unionByName(marks, allowMissingColumns=True))
    else:  # what is shuffled for a position is the words that a window around it can have
        around = F.slice("w", F.greatest(pos - window + 1, F.lit(0)) + 1, 2 * window - 1)
        inner = F.least(pos, F.lit(window - 1))
        probes = probes.unionByName(marks, allowMissingColumns=True)
    start = F.col("inner") - at["place"]
    tried = (
        own.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
        .select("doc_id", "row", "w", F.posexplode(F.array_append("w", mark)).alias("pos", "word"))
        .select("doc_id", "row", "pos", "word", around.alias("around"), inner.alias("inner"))
        .join(probes, "word")
        .select("doc_id", "row", "pos", "around", "inner", F.explode_outer("tries").alias("at"))
        .filter(at.isNull() | ((start >= 0) & (start + at["long"] <= F.size("around"))))
        .select(
            "doc_id",
            "row",
            F.when(at.isNull(), pos).alias("n_words"),
            (pos - at["place"]).alias("start"),
            (pos - at["place"] + at["long"]).alias("end"),
            F.when(at.isNotNull(), F.slice("around", start + 1, at["long"])).alias("found"),
        )
        .withColumn("key", F.when(F.col("found").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("found")))
    )
    known = broadcast_if_small(prefix).select(F.xxhash64("window").alias("window_key"), "window", "item_ids")
    rows = tried.join(
        known, (F.col("key") == F.col("window_key")) & (F.col("found") == F.col("window")), "left"
    ).filter(F.col("found").isNull() | F.col("item_ids").isNotNull())
    # All rows of a window partition are of one document.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new_words = F.greatest(
        F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start"))), F.lit(0)
    )
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("item_ids"))), lambda i: i.cast("string")))
    return (
        rows.withColumn("hit", new_words)
        .groupBy("row")
        .agg(
            F.max(F.when(F.col("n_words").isNotNull(), F.struct("doc_id"))).alias("d"),
            F.max("n_words").cast("long").alias("n_words"),
            F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_hit"),
            ids.alias("ids"),
        )
        .select(
            F.col("d.doc_id").alias("doc_id"),
            "n_words",
            "n_hit",
            F.size("ids").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; null doc_ids stay."""
    found = find_leaks(docs.select("doc_id", "text"), items, window)
    gone = settle(found.filter("contaminated").select("doc_id").distinct(), "gone")  # of known size
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
