"""Ordered replay of a mixed edit log.

The log of a meeting is path dependent, but not as a whole: turns only affect
each other where merges reach from one to the next. Turns are therefore cut
into islands that no merge can leave, and each island is replayed on its own,
so a meeting with a third of all edits spreads over its islands. Speaker merges
are resolved per roster and applied to the finished turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import TIGHT_CHARACTERS
from colloquy.operators.edits import of_kind
from colloquy.plans.scan import position_chunk, running
from colloquy.session import settle

TURN_EDITS = ["split", "merge_next", "merge_previous", "edit_text", "remove", "reassign"]

_WORDS = "array<struct<word:string,start:double,end:double>>"
_REPLAYED = (
    "meeting_id string, island long, pos int, kind string, turn_id string, speaker_id string, "
    f"start double, end double, text string, words {_WORDS}, is_edited boolean"
)


def root_of(column: str):
    """Turn a split half came from: ids of halves are ``root/seq``."""
    return F.split_part(F.col(column), F.lit("/"), F.lit(1))


def islands(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns named by edits, and those merges may reach, with the island they are in.

    Reaching past a turn takes one merge for every turn in between that is never
    removed. So the boundary after turn i can be crossed rightwards only if, for
    some earlier turn j, the merges on j..i outnumber such turns in (j, i]; the
    same holds leftwards. Both are running sums and a running maximum.
    """
    log = edits.where(F.col("op").isin(TURN_EDITS)).withColumn("turn_id", root_of("turn_id"))
    per_turn = log.groupBy("meeting_id", "turn_id").agg(
        F.count(F.when(F.col("op").startswith("merge"), 1)).alias("_merges"),
        F.max(F.col("op") == "remove").alias("_removed"),
    )
    merging = per_turn.where("_merges > 0").select("meeting_id").distinct()
    places = turns.select("meeting_id", "turn_id", "turn_idx")
    marked = (
        places.join(merging, "meeting_id", "left_semi")
        .join(per_turn, ["meeting_id", "turn_id"], "left")
        .select(
            "meeting_id",
            "turn_id",
            "turn_idx",
            F.col("_merges").isNotNull().alias("_named"),
            F.coalesce("_merges", F.lit(0)).alias("_m"),
            F.when(F.coalesce("_removed", F.lit(False)), 0).otherwise(1).alias("_stays"),
        )
    )
    key, size = ["meeting_id"], 65_536
    forward, order = position_chunk("turn_idx", size), [F.col("turn_idx")]
    sums = settle(
        running(
            marked, key, forward, order, {"_s": ("sum", F.col("_m")), "_n": ("sum", F.col("_stays"))}
        ),
        "edit-sums",
    )
    s, n, m, stays = F.col("_s"), F.col("_n"), F.col("_m"), F.col("_stays")
    right = running(
        sums, key, forward, order, {"_best": ("max", n - s + m)}, inclusive=False
    ).withColumn("_from_left", s - m - (n - stays) + F.col("_best") > 0)
    both = running(
        right,
        key,
        position_chunk(-F.col("turn_idx"), size),
        [-F.col("turn_idx")],
        {"_ahead": ("max", s - (n - stays))},
    ).withColumn("_from_right", F.col("_ahead") - (s - m) + (n - stays) > 0)
    starts = ~(F.coalesce("_from_left", F.lit(False)) | F.col("_from_right"))
    # The first turn of a meeting starts an island whatever lies to its left.
    joined = running(
        both.withColumn("_start", F.when(starts | F.col("_best").isNull(), F.col("turn_idx"))),
        key,
        forward,
        order,
        {"island": ("max", F.col("_start"))},
    )
    touched = joined.where("_named").select("meeting_id", "island").distinct()
    reached = joined.join(touched, ["meeting_id", "island"], "left_semi").select(
        "meeting_id", "turn_id", "island"
    )
    alone = (
        places.join(per_turn.select("meeting_id", "turn_id"), ["meeting_id", "turn_id"])
        .join(merging, "meeting_id", "left_anti")
        .select("meeting_id", "turn_id", F.col("turn_idx").alias("island"))
    )
    return reached.unionByName(alone)


def _join_words(words: list) -> str:
    out = ""
    for word in (w["word"] for w in words):
        if word:
            out += ("" if not out or word[0] in TIGHT_CHARACTERS else " ") + word
    return out


def _replay_island(key, turns: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
    rows = {r["turn_id"]: r for r in turns.sort_values("turn_idx").to_dict("records")}
    for row in rows.values():
        row["words"] = None if row["words"] is None else list(row["words"])
    # Neighbours by id; None stands before the first and after the last.
    after = dict(zip([None, *rows], [*rows, None]))
    before = {b: a for a, b in after.items()}
    dropped: set[str] = set()

    def link(a: str | None, b: str | None) -> None:
        after[a], before[b] = b, a

    for edit in edits.sort_values("seq").to_dict("records"):
        at, op = edit["turn_id"], edit["op"]
        row = rows.get(at)
        if row is None:
            continue
        if op == "remove":
            dropped.add(at)
            link(before[at], after[at])
            del rows[at]
        elif op == "reassign":
            row["speaker_id"] = edit["arg"]
        elif op == "edit_text":
            text = (edit["arg"] or "").strip()
            if text != row["text"]:
                row.update(text=text, words=None, is_edited=True)
                dropped.add(at)
        elif op == "split":
            k = int(edit["num"])
            if row["words"] is None or not 0 < k < len(row["words"]):
                continue
            half = f"{at}/{edit['seq']}"
            for part, name in ((row["words"][:k], at), (row["words"][k:], half)):
                rows[name] = dict(
                    row,
                    turn_id=name,
                    start=part[0]["start"],
                    end=part[-1]["end"],
                    text=_join_words(part),
                    words=part,
                    is_edited=False,
                )
            link(half, after[at])
            link(at, half)
            dropped.add(at)
        else:
            low = before[at] if op == "merge_previous" else at
            if low is None or after[low] is None:
                continue
            first, second = rows[low], rows[after[low]]
            timed = first["words"] is not None and second["words"] is not None
            words = first["words"] + second["words"] if timed else None
            if timed:
                text = _join_words(words)
            else:
                text = _join_words([{"word": first["text"]}, {"word": second["text"]}])
            rows[low] = dict(
                first,
                start=min(first["start"], second["start"]),
                end=max(first["end"], second["end"]),
                text=text,
                words=words,
                is_edited=first["is_edited"] or second["is_edited"],
            )
            link(low, after[second["turn_id"]])
            del rows[second["turn_id"]]
            dropped |= {low, second["turn_id"]}

    order, at = [], after[None]
    while at is not None:
        order.append(rows[at])
        at = after[at]
    out = [
        (key[0], key[1], i, "turn", r["turn_id"], r["speaker_id"], r["start"], r["end"], r["text"],
         r["words"], r["is_edited"])
        for i, r in enumerate(order)
    ]
    out += [
        (key[0], key[1], 0, "touched", t, None, None, None, None, None, None)
        for t in sorted(dropped)
    ]
    return pd.DataFrame(
        out,
        columns=["meeting_id", "island", "pos", "kind", "turn_id", "speaker_id", "start", "end",
                 "text", "words", "is_edited"],
    )


def _speaker_fates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges of one meeting after another in order; only both-living ones count."""
    meeting, gone = None, set()
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.meeting_id != meeting:
                meeting, gone = row.meeting_id, set()
            if row.speaker_id not in gone and row.arg not in gone:
                gone.add(row.speaker_id)
                out.append((meeting, row.speaker_id, row.arg, row.seq))
        yield pd.DataFrame(out, columns=["meeting_id", "speaker_id", "into", "gone_seq"])


def speaker_fates(speakers: DataFrame, edits: DataFrame) -> DataFrame:
    """Effective speaker merges: who was absorbed by whom, and when."""
    roster = speakers.select("meeting_id", "speaker_id")
    wanted = of_kind(edits, "merge_speakers").where("speaker_id <> arg")
    both = wanted.join(roster, ["meeting_id", "speaker_id"], "left_semi").join(
        roster.withColumnRenamed("speaker_id", "arg"), ["meeting_id", "arg"], "left_semi"
    )
    # Streams through a task in order; what is kept is one set of absorbed
    # speakers, no larger than a roster.
    return (
        both.select("meeting_id", "seq", "speaker_id", "arg")
        .repartition("meeting_id")
        .sortWithinPartitions("meeting_id", "seq")
        .mapInPandas(
            _speaker_fates, "meeting_id string, speaker_id string, into string, gone_seq long"
        )
    )


def final_speakers(fates: DataFrame) -> DataFrame:
    """Absorbed speakers with the one that finally stands for them."""
    # A roster's merges form chains ordered by sequence; they are walked from
    # the last merge back, within one array no longer than the roster.
    chains = fates.groupBy("meeting_id").agg(
        F.reverse(
            F.array_sort(F.collect_list(F.struct("gone_seq", "speaker_id", "into")))
        ).alias("_chain")
    )
    resolved = F.aggregate(
        "_chain",
        F.create_map().cast("map<string,string>"),
        lambda acc, step: F.map_concat(
            acc,
            F.create_map(
                step["speaker_id"], F.coalesce(F.try_element_at(acc, step["into"]), step["into"])
            ),
        ),
    )
    return chains.select("meeting_id", F.explode(resolved).alias("speaker_id", "final_speaker"))


def replay_turn_edits(turns: DataFrame, speakers: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns after the log, plus ``touched`` rows naming turns that were rewritten.

    ``kind`` tells the two apart; turns sort by ``(island, pos)``. An untouched
    turn is an island of its own and never passes through Python.
    """
    fates = settle(speaker_fates(speakers, edits), "speaker-fates")
    reassign = of_kind(edits, "reassign")
    roster = speakers.select("meeting_id", F.col("speaker_id").alias("arg"))
    gone = fates.select("meeting_id", F.col("speaker_id").alias("arg"), "gone_seq")
    valid = (
        reassign.join(roster, ["meeting_id", "arg"], "left_semi")
        .join(gone, ["meeting_id", "arg"], "left")
        .where("gone_seq IS NULL OR seq < gone_seq")
        .select("meeting_id", "seq", "op", "turn_id", "arg", "num")
    )
    others = edits.where(
        F.col("op").isin([op for op in TURN_EDITS if op != "reassign"])
    ).select("meeting_id", "seq", "op", "turn_id", "arg", "num")
    log = others.unionByName(valid)

    place = settle(islands(turns, log), "islands")
    columns = ["meeting_id", "turn_idx", "turn_id", "speaker_id", "start", "end", "text", "words",
               "is_edited"]
    inside = turns.select(*columns).join(place, ["meeting_id", "turn_id"])
    steps = (
        log.withColumn("_root", root_of("turn_id"))
        .join(place.withColumnRenamed("turn_id", "_root"), ["meeting_id", "_root"])
        .drop("_root")
    )
    # Fresh column identities: both sides descend from the same written table.
    steps = steps.select(*[F.col(c).alias(c) for c in steps.columns])
    replayed = (
        inside.groupBy("meeting_id", "island")
        .cogroup(steps.groupBy("meeting_id", "island"))
        .applyInPandas(_replay_island, _REPLAYED)
    )
    untouched = (
        turns.select(*columns)
        .join(place.select("meeting_id", "turn_id"), ["meeting_id", "turn_id"], "left_anti")
        .withColumns(
            {"island": F.col("turn_idx"), "pos": F.lit(0), "kind": F.lit("turn")}
        )
        .drop("turn_idx")
    )
    final = final_speakers(fates)
    return (
        replayed.unionByName(untouched)
        .join(final, ["meeting_id", "speaker_id"], "left")
        .withColumn("speaker_id", F.coalesce("final_speaker", "speaker_id"))
        .drop("final_speaker")
    )


def touched_turns(turns: DataFrame, speakers: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns ``(meeting_id, turn_id)`` that edits of the log really rewrote.

    Edits that change nothing, or do not apply, touch none; a merge touches
    both of its turns.
    """
    return replay_turn_edits(turns, speakers, edits).where("kind = 'touched'").select("meeting_id", "turn_id")
