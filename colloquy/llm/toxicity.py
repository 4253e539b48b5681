"""Toxicity by class-conditional Kneser-Ney models of words.

A word is a pair: its head (the first four characters) and the whole of it.
For each class c, with counts n_c,

    P_c(word | head) = (1 - L(head)) n_c(word) / n_c(head) + L(head) P(word | head)
    P_c(head)        = (1 - L) n_c(head) / N_c + L P(head)

where all without a class is shared by both: the P are Kneser-Ney continuation
counts over both classes together, and L the mass that discounting D from every
count, again of both together, sets free. So what neither class knows tells
nothing. n_c counts the different words that precede, so that what copies
repeat counts once; they are counted in a sketch of 64 bits, and a word that
fills its sketch by its occurrences.

A text's evidence is the log-likelihood under the toxic model less that under
the ordinary one, normalised by length: over the whole text, and over its
windows of a few words, of which the highest counts. A word counts where it
first stands in the text; repeating it adds nothing.

All labelled rows that may be learnt from are counted, by Spark. A hash table
with check bits and a bounded number of slots holds the most frequent word of
each slot. The words without a slot are a written table: sent as it is while it
is short, else joined with the texts that have such words. So every counted
word scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import IdFilter, is_small, prepare
from colloquy.llm.hashing import RangeHashes
from colloquy.session import settle

DISCOUNT = 0.75
HEAD = 4
WINDOW = 3
FOLDS = 5
#: The fold that the calibration learns from; the model it is learnt with has not seen it.
CALIBRATION_FOLD = 4
#: Most rows that the calibration (four numbers) is fitted on.
CALIBRATION_ROWS = 20_000
#: Slots of the model's tables, which are broadcast: 2**22 words, 2**20 heads.
WORD_BITS, HEAD_BITS = 22, 20
#: Words and heads without a slot up to which these are broadcast too: 12 bytes each.
REST_ROWS = 1 << 20
#: Bits of the broadcast set of hashes without a slot.
REST_BITS = 25
#: Marks that a table joined by a shuffle is dealt over, so that one word or text is no hot key.
SALTS = 16
#: Ordinary and toxic rows of the other folds, and of the calibration fold.
KINDS = ("o", "t", "ho", "ht")


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the heads and of the whole of a text's words, by prefix sums over its bytes.

    Words are what stands between white space, without ASCII case and without
    ASCII punctuation at either end.
    """
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    inner = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    where = np.flatnonzero(inner)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    gaps = np.cumsum(gap)[where]
    new = np.r_[True, gaps[1:] != gaps[:-1]]
    start = where[new]
    end = where[np.r_[np.flatnonzero(new)[1:] - 1, len(where) - 1]] + 1
    hashes = RangeHashes(raw)
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes that begin a character
    at = np.searchsorted(first, start) + HEAD
    head = np.minimum(end, np.r_[first, np.full(HEAD, len(raw))][at])
    return hashes.of(start, head), hashes.of(start, end)


def _fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)).cast("int")


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from, one for each document."""
    return (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .filter(_fold() > 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, fold, toxic) of all rows with a known label.

    A set of hashed labelled ids of fixed size goes to all tasks first, so that
    few other texts are shuffled; what it lets through in error the join drops.
    """
    some = IdFilter(known, ["doc_id"]).keep(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(
            F.col("doc_id").isNotNull() & (_fold() > 0)
        )
    )
    return some.join(known, "doc_id").select("text", _fold().alias("fold"), "toxic")


def calibration_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, toxic) of at most CALIBRATION_ROWS labels of the calibration fold, by hash of the id."""
    ids = known.filter(_fold() == CALIBRATION_FOLD).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(F.broadcast(ids), "doc_id")  # of bounded size
        .select("text", "toxic")
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """(head, word, o, t, ho, ht): counts in ordinary and toxic rows, and the same in the calibration fold."""

    def count(batches):
        for batch in batches:
            texts = [hashed_words(t) for t in batch["text"].to_pylist()]
            kinds = [
                toxic + 2 * (fold == CALIBRATION_FOLD)
                for fold, toxic in zip(batch["fold"].to_pylist(), batch["toxic"].to_pylist())
            ]
            none = [np.zeros(0, np.uint64)]
            head = np.concatenate([h for h, _ in texts] or none)
            word = np.concatenate([w for _, w in texts] or none)
            bit = np.concatenate([np.r_[np.uint64(0), w[:-1]][: len(w)] for _, w in texts] or none) >> np.uint64(58)
            kind = np.repeat(np.array(kinds, np.int64), [len(w) for _, w in texts])
            unique, first, inverse = np.unique(word, return_index=True, return_inverse=True)
            at = inverse * 4 + kind
            counts = np.bincount(at, minlength=4 * len(unique)).reshape(-1, 4)
            sketch = np.zeros(4 * len(unique), np.uint64)
            np.bitwise_or.at(sketch, at, np.uint64(1) << bit)
            sketch = sketch.view(np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(head[first].view(np.int64)),
                    pa.array(unique.view(np.int64)),
                    *(pa.array(counts[:, k].astype(np.int32)) for k in range(4)),
                    *(pa.array(sketch[:, k].copy()) for k in range(4)),
                ],
                ["head", "word", *KINDS, *(f"s_{c}" for c in KINDS)],
            )

    shape = "head long, word long, " + ", ".join([f"{c} int" for c in KINDS] + [f"s_{c} long" for c in KINDS])
    sums = [F.sum(c).cast("long").alias(c) for c in KINDS] + [F.bit_or(f"s_{c}").alias(f"s_{c}") for c in KINDS]
    return rows.mapInArrow(count, shape).groupBy("head", "word").agg(*sums)


def class_counts(counts: DataFrame, with_calibration: bool) -> DataFrame:
    """(head, word, o, t): the different contexts of each word in each class."""

    def n(c: str):
        raw, sketch = F.col(c), F.col(f"s_{c}")
        if with_calibration:
            raw, sketch = raw + F.col(f"h{c}"), sketch.bitwiseOR(F.col(f"s_h{c}"))
        free = F.lit(64) - F.bit_count(sketch)
        estimate = F.round(F.lit(-64.0) * F.log(free / F.lit(64.0)))
        return F.when(free == 0, raw).otherwise(F.least(raw, estimate.cast("long"))).alias(c)

    return counts.select("head", "word", n("o"), n("t")).filter("o + t > 0")


def _slotted(rows: DataFrame, key: str, bits: int, n, ratio) -> DataFrame:
    """(slot, key, ratio, kept): of the keys in a slot the one with the highest count is kept there."""
    first = Window.partitionBy("slot").orderBy(F.desc("n"), F.desc("key"))
    ranked = rows.select(
        F.shiftrightunsigned(key, 64 - bits).cast("int").alias("slot"),
        F.col(key).alias("key"),
        ratio.cast("float").alias("ratio"),
        n.alias("n"),
    ).select("slot", "key", "ratio", (F.row_number().over(first) == 1).alias("kept"))
    return settle(ranked, "ratios")


def _filled(rows: DataFrame | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and check values (-1: free) of 2**bits slots."""
    ratio, check = np.zeros(1 << bits, np.float32), np.full(1 << bits, -1, np.int32)
    if rows is not None:
        check_bits = F.col("key").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("check")
        found = rows.filter("kept").select("slot", check_bits, "ratio").toArrow()  # at most as many rows as slots
        at = found["slot"].to_numpy()
        ratio[at], check[at] = found["ratio"].to_numpy(), found["check"].to_numpy()
    return ratio, check


def _without_slot(words: DataFrame, heads: DataFrame) -> dict[str, object]:
    """What lost its slot: as arrays while these are short, else (head, key, ratio) and its set in 2**REST_BITS bits."""
    rest = words.filter("not kept").select(F.lit(False).alias("head"), "key", "ratio").unionByName(
        heads.filter("not kept").select(F.lit(True).alias("head"), "key", "ratio")
    )
    if rest.count() <= REST_ROWS:
        few = rest.orderBy("key").toArrow()  # at most REST_ROWS
        is_head = few["head"].to_numpy()
        key, ratio = few["key"].to_numpy(), few["ratio"].to_numpy()
        return {"few": {kind: (key[is_head == kind], ratio[is_head == kind]) for kind in (False, True)}}
    at = F.col("key").bitwiseAND(F.lit((1 << REST_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = (
        rest.select(F.shiftright(at, 6).cast("int").alias("k"), one.alias("b"))
        .groupBy("k")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()  # at most 2**REST_BITS / 64 rows
    )
    bits = np.zeros(1 << (REST_BITS - 6), np.int64)
    bits[rows["k"].to_numpy()] = rows["b"].to_numpy()
    return {"rest": (rest, bits)}


def build_model(counts: DataFrame) -> dict[str, object]:
    """The log ratios of words and of heads alone as tables with a fixed number of slots, and the rest.

    ``counts`` has head, word, o and t. A word that was never counted has its
    head's ratio.
    """
    heads = settle(
        counts.groupBy("head").agg(
            F.sum("o").alias("n_o"),
            F.sum("t").alias("n_t"),
            F.sum((F.col("o") > 0).cast("long")).alias("t_o"),
            F.sum((F.col("t") > 0).cast("long")).alias("t_t"),
        ),
        "heads",
    )
    total = heads.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_o", "n_t", "t_o", "t_t")),
        F.sum((F.col("n_o") > 0).cast("long")).alias("h_o"),
        F.sum((F.col("n_t") > 0).cast("long")).alias("h_t"),
        F.count("*").alias("heads"),
    ).first()
    if not total["n_o"] or not total["n_t"]:  # one class alone tells nothing
        return {"word": _filled(None, WORD_BITS), "head": _filled(None, HEAD_BITS)}
    # One head more stands for all that were never seen.
    shared = (F.col("t_o") + F.col("t_t")) / F.lit(float(total["t_o"] + total["t_t"] + 1))
    free = min(1.0, DISCOUNT * (total["h_o"] + total["h_t"]) / (total["n_o"] + total["n_t"]))

    def of_head(c: str):
        return F.lit(1 - free) * F.col(f"n_{c}") / F.lit(float(total[f"n_{c}"])) + F.lit(free) * shared

    known = settle(
        heads.select(
            "head", "n_o", "n_t", "t_o", "t_t",
            F.log(of_head("t") / of_head("o")).alias("head_ratio"),
            (F.lit(DISCOUNT) * (F.col("t_o") + F.col("t_t")) / (F.col("n_o") + F.col("n_t"))).alias("free"),
        ),
        "head-ratios",
    )
    # Within its head: the classes that have the word, over those that have the head's words.
    own = ((F.col("o") > 0).cast("long") + (F.col("t") > 0).cast("long")) / (F.col("t_o") + F.col("t_t"))

    def of_word(c: str):
        direct = (1 - F.col("free")) * F.col(c) / F.col(f"n_{c}")
        return F.when(F.col(f"n_{c}") > 0, direct).otherwise(F.lit(0.0)) + F.col("free") * own

    words = counts.join(known, "head")
    ratio = F.col("head_ratio") + F.log(of_word("t") / of_word("o"))
    by_word = _slotted(words, "word", WORD_BITS, F.col("o") + F.col("t"), ratio)
    by_head = _slotted(known, "head", HEAD_BITS, F.col("n_o") + F.col("n_t"), F.col("head_ratio"))
    return {
        "word": _filled(by_word, WORD_BITS),
        "head": _filled(by_head, HEAD_BITS),
        **_without_slot(by_word, by_head),
    }


def _looked_up(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, other) -> np.ndarray:
    bits = len(table[0]).bit_length() - 1
    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
    fits = table[1][slot] == (key & np.uint64(0xFFFF)).astype(np.int32)
    return np.where(fits, table[0][slot], other)


def _put_right(values: np.ndarray, key: np.ndarray, own: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """``values`` with those of the keys in ``own``, which is sorted, replaced."""
    if not len(own):
        return values
    signed = key.view(np.int64)
    at = np.minimum(np.searchsorted(own, signed), len(own) - 1)
    return np.where(own[at] == signed, ratio[at], values)


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.float32))


def _as_arrays(rest: list[dict]) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    of_kind: dict[bool, dict[int, float]] = {False: {}, True: {}}
    for r in rest:
        of_kind[r["head"]][r["key"]] = r["ratio"]
    return {
        kind: (np.array(sorted(found), np.int64), np.array([found[k] for k in sorted(found)], np.float32))
        for kind, found in of_kind.items()
    }


def evidence(text: str | None, model: dict[str, object], rest: list[dict] | None = None) -> tuple[float, float]:
    """(highest mean log ratio of a window, mean log ratio of the text); zeros without words.

    ``rest`` has the text's keys that are counted but have no slot.
    """
    head, word = hashed_words(text)
    if not len(head):
        return 0.0, 0.0
    others = _as_arrays(rest) if rest else model.get("few", {})
    known = _put_right(_looked_up(model["head"], head, 0.0), head, *others.get(True, _NONE))
    ratio = _put_right(_looked_up(model["word"], word, known), word, *others.get(False, _NONE)).astype(np.float64)
    again = np.ones(len(word), bool)
    again[np.unique(word, return_index=True)[1]] = False
    ratio[again] = 0.0
    sums = np.r_[0.0, np.cumsum(ratio)]
    k = min(WINDOW, len(ratio))
    return float((sums[k:] - sums[:-k]).max()) / WINDOW, float(sums[-1] / len(ratio))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and weights of a ridge logistic regression, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, object], np.ndarray]:
    """The model on all that may be learnt from, and the weights of bias, window and mean."""
    prepare(docs.sparkSession)
    known = known_labels(labels)
    counts = settle(word_counts(training_rows(docs, known)), "word-counts")
    early = build_model(class_counts(counts, False))
    found = _applied(calibration_rows(docs, known), early, ["toxic"]).toArrow()
    y = found["toxic"].to_numpy()
    if len(y) and 0 < y.sum() < len(y):
        weights = fit_logistic(np.c_[found["window"].to_numpy(), found["mean"].to_numpy()], y)
    else:
        weights = np.array([-1.0, 1.0, 0.0])
    return build_model(class_counts(counts, True)), weights


def _rest_of_texts(texts: DataFrame, rest: DataFrame, bits: np.ndarray) -> DataFrame:
    """(_key, _rest): for each different text with words or heads in ``rest``, those it has.

    The set of bits lets few others through, which the join drops. _key is a
    hash of the text; texts that share one get each other's ratios besides,
    which change nothing.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def wanted(batches):
        for batch in batches:
            bits = sent.value
            keys: dict[int, str | None] = dict(zip(batch["_key"].to_pylist(), batch["_text"].to_pylist()))
            found: list[tuple] = []
            for key, text in keys.items():
                for is_head, hashes in zip((True, False), hashed_words(text)):
                    own = np.unique(hashes).view(np.int64)
                    at = own & ((1 << REST_BITS) - 1)
                    own = own[((bits[at >> 6] >> (at & 63)) & 1).astype(bool)]
                    found += [(key, is_head, k) for k in own.tolist()]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.bool_(), pa.int64()))], ["_key", "head", "key"]
            )

    pairs = texts.select("_key", "_text").mapInArrow(wanted, "_key long, head boolean, key long").distinct()
    if is_small(rest):
        joined = pairs.join(F.broadcast(rest), ["head", "key"])
    else:
        joined = pairs.withColumn("salt", F.pmod("_key", F.lit(SALTS)).cast("int")).join(_salted(rest), ["head", "key", "salt"])
    return settle(joined.groupBy("_key").agg(F.collect_list(F.struct("head", "key", "ratio")).alias("_rest")), "rest")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))


def _applied(df: DataFrame, model: dict[str, object], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the evidence of ``text``, as window and mean."""
    sent = df.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "rest"})

    def score(batches):
        for batch in batches:
            texts = batch["_text"].to_pylist()
            rests = batch["_rest"].to_pylist() if "_rest" in batch.schema.names else [None] * len(texts)
            found = [evidence(t, sent.value, r) for t, r in zip(texts, rests)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[n] for n in keep),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                [*keep, "window", "mean"],
            )

    shape = df.select(*keep).schema.add("window", "double").add("mean", "double")
    own = df.select(*keep, F.col("text").cast("string").alias("_text"))
    if "rest" not in model:
        return own.mapInArrow(score, shape)
    rest, bits = model["rest"]
    keyed = own.withColumn("_key", F.xxhash64("_text"))
    of_texts = _rest_of_texts(keyed, rest, bits)
    if is_small(of_texts):
        return keyed.join(F.broadcast(of_texts), "_key", "left").mapInArrow(score, shape)
    # Only texts that may have such words are shuffled; copies of one are dealt over the marks.
    known = IdFilter(of_texts, ["_key"])
    salt = F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int")
    some = known.keep(keyed).withColumn("salt", salt).join(_salted(of_texts), ["_key", "salt"], "left")
    return known.keep(keyed, False).mapInArrow(score, shape).unionByName(some.mapInArrow(score, shape))


def _score(weights: np.ndarray):
    z = sum((F.lit(float(w)) * F.col(n) for w, n in zip(weights[1:], ("window", "mean"))), F.lit(float(weights[0])))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Labels (doc_id, toxic 0 or 1; other values and null ids are no labels, of
    several for one document the highest counts) are learnt from outside fold 0
    of crc32(doc_id). Null and empty texts get the score of no evidence.
    Repeated rows are scored each; a null doc_id has a null held_out. Without
    labels of both classes every score is below a half. Extra columns are
    ignored. An empty table gives no rows.
    """
    model, weights = train(docs, labels)
    score = _score(weights)
    return _applied(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ["doc_id"]).select(
        "doc_id",
        (_fold() == 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model, weights = train(docs, labels)
    names = [f"_{k}" for k in range(len(docs.columns))]  # no clash with what is added
    own = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    return _applied(own, model, names).filter(_score(weights) < 0.5).select(*names).toDF(*docs.columns)
