"""Search, replacement and the replay of edit logs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import edits, replay, search

TURN = (
    "meeting_id string, turn_idx long, turn_id string, speaker_id string, start double, `end` double, "
    "text string, words array<struct<word:string,start:double,`end`:double>>, is_edited boolean"
)


def joined(words):
    out = ""
    for w in words:
        if w:
            out += ("" if not out or w[0] in tx.TIGHT_CHARACTERS else " ") + w
    return out


def turn(meeting, i, words, timed=True):
    spans = [(w, i * 100 + k * 0.4, i * 100 + k * 0.4 + 0.3) for k, w in enumerate(words)]
    return (
        meeting, i, f"{meeting}-{i}", "AB"[i % 2], i * 100.0, spans[-1][2], joined(words),
        spans if timed else None, not timed,
    )


def ranges(words):
    out, at = [], 0
    for k, (w, _, _) in enumerate(words):
        if not w:
            continue
        if at and w[0] not in tx.TIGHT_CHARACTERS:
            at += 1
        out.append((k, at, at + len(w)))
        at += len(w)
    return out


def plain_replace(text, words, query, new):
    q, folded = tx.fold_literal(query.strip()), tx.fold_literal(text)
    found = [i for i in range(len(text)) if q and folded.startswith(q, i)]
    kept = dropped = 0
    for at in reversed(found):
        if at + len(q) > len(text):
            continue
        inside = None
        if words is not None:
            inside = next((r for r in ranges(words) if r[1] <= at and at + len(q) <= r[2]), None)
        if inside:
            k, lo, _ = inside
            w = words[k][0]
            words = words[:k] + [(w[: at - lo] + new + w[at - lo + len(q) :], *words[k][1:])] + words[k + 1 :]
            words = [w for w in words if w[0]]
            text, kept = joined([w[0] for w in words]), kept + 1
        else:
            text, words, dropped = text[:at] + new + text[at + len(q) :], None, dropped + 1
    return text, words, kept, dropped


@pytest.mark.parametrize(
    "query, new",
    [("aa", "b"), ("aa", ""), ("åker", "går"), ("a b", "c"), ("b", ""), ("b", "."), ("x, y", "z"), ("  ", "q")],
)
def test_replace_all(spark, query, new):
    rng = random.Random(query + new)
    stock = ["aaa", "and", "aa", "b", "hon", "Åker", "AKER", "x", ",", "y", "abba", "baab", ""]
    rows = [
        turn("m", i, [rng.choice(stock) for _ in range(rng.randint(1, 9))] + ["b"], rng.random() < 0.8)
        for i in range(60)
    ]
    rows = [r for r in rows if r[6]]
    df = spark.createDataFrame(rows, TURN)
    for r in search.replace_all(df, query, new).collect():
        source = rows[[x[2] for x in rows].index(r.turn_id)]
        text, words, kept, dropped = plain_replace(source[6], source[7], query, new)
        got = None if r.words is None else [tuple(w) for w in r.words]
        assert (r.text, got, r.kept, r.dropped) == (text, words, kept, dropped), source


def test_overlapping_matches(spark):
    df = spark.createDataFrame([("m", "t", "aaa and aaa")], "meeting_id string, turn_id string, text string")
    got = sorted(r.offset for r in search.find_matches(df, "aa").collect())
    assert got == [0, 1, 8, 9]


@pytest.mark.parametrize("query", ["AKER", "åker", " åker "])
def test_case_and_accents_are_ignored(spark, query):
    df = spark.createDataFrame([("m", "t", "hon åker hem")], "meeting_id string, turn_id string, text string")
    assert [r.offset for r in search.find_matches(df, query).collect()] == [4]


def test_split_then_merge_restores_the_turn(spark):
    rows = [turn("m", 0, ["Hej", "allihopa", "."]), turn("m", 1, ["Good", "morning."])]
    df = spark.createDataFrame(rows, TURN)
    cut = spark.createDataFrame([("m", "m-0", 7, 1), ("m", "m-1", 8, 0)], "meeting_id string, turn_id string, seq long, k int")
    halves = edits.split_turns(df, cut).withColumn(
        "turn_idx", F.col("turn_idx") * 2 + F.col("part")
    ).drop("part").where("turn_idx < 2")
    assert [r.text for r in halves.orderBy("turn_idx").collect()] == ["Hej", "allihopa."]
    pair = spark.createDataFrame([("m", 0)], "meeting_id string, turn_idx long")
    back = edits.merge_neighbours(halves, pair).collect()
    assert len(back) == 1
    assert (back[0].turn_id, back[0].text, [tuple(w) for w in back[0].words]) == (
        "m-0", rows[0][6], rows[0][7]
    )


def plain_replay(rows, log, roster):
    """The whole log of one meeting, one edit after another."""
    rows = [dict(zip(["m", "i", "id", "who", "s", "e", "text", "words", "edited"], r)) for r in rows]
    alive, dropped = set(roster), set()
    for e in sorted(log, key=lambda e: e[1]):
        _, seq, op, tid, spk, arg, num = e
        if op == "merge_speakers":
            if spk != arg and spk in alive and arg in alive:
                alive.discard(spk)
                for r in rows:
                    r["who"] = arg if r["who"] == spk else r["who"]
            continue
        at = next((k for k, r in enumerate(rows) if r["id"] == tid), None)
        if at is None:
            continue
        r = rows[at]
        if op == "remove":
            dropped.add(tid)
            del rows[at]
        elif op == "reassign":
            r["who"] = arg if arg in alive else r["who"]
        elif op == "edit_text":
            if arg.strip() != r["text"]:
                r.update(text=arg.strip(), words=None, edited=True)
                dropped.add(tid)
        elif op == "split":
            k = int(num)
            if r["words"] and 0 < k < len(r["words"]):
                a, b = r["words"][:k], r["words"][k:]
                two = [
                    dict(r, id=n, s=p[0][1], e=p[-1][2], text=joined([w[0] for w in p]), words=p, edited=False)
                    for p, n in ((a, tid), (b, f"{tid}/{seq}"))
                ]
                rows[at : at + 1] = two
                dropped.add(tid)
        else:
            low = at - 1 if op == "merge_previous" else at
            if 0 <= low and low + 1 < len(rows):
                x, y = rows[low], rows[low + 1]
                timed = x["words"] is not None and y["words"] is not None
                words = x["words"] + y["words"] if timed else None
                text = joined([w[0] for w in words]) if timed else joined([x["text"], y["text"]])
                rows[low] = dict(x, s=min(x["s"], y["s"]), e=max(x["e"], y["e"]), text=text, words=words,
                                 edited=x["edited"] or y["edited"])
                del rows[low + 1]
                dropped |= {x["id"], y["id"]}
    return [(r["id"], r["who"], r["s"], r["e"], r["text"], r["edited"]) for r in rows], dropped


@pytest.mark.parametrize("seed", range(3))
def test_replay_by_island_equals_the_whole_replay(spark, seed):
    rng = random.Random(seed)
    rows, log, seq = [], [], 0
    for meeting, n, busy in (("hot", 60, 0.9), ("b", 25, 0.3), ("calm", 5, 0.0)):
        rows += [turn(meeting, i, rng.choices(["a", "b", ",", "cd."], k=4), rng.random() < 0.8) for i in range(n)]
        for _ in range(int(n * busy)):
            seq += 1
            i = rng.randrange(n)
            op = rng.choice(["split", "merge_next", "merge_previous", "merge_next", "edit_text", "remove", "reassign"])
            tid = f"{meeting}-{i}"
            if rng.random() < 0.2:
                tid += f"/{rng.randint(1, max(1, seq))}"
            arg = {"edit_text": rng.choice([" new ", "a"]), "reassign": rng.choice(["A", "B", "C", "Z"])}.get(op)
            log.append((meeting, seq, op, tid, None, arg, float(rng.randint(0, 4)) if op == "split" else None))
        if busy:
            seq += 1
            log.append((meeting, seq // 2 * 2 + 1_000 * (seed % 2), "merge_speakers", None, "A", "C", None))
            log.append((meeting, 5_000, "merge_speakers", None, "C", "B", None))
    roster = [(m, s) for m in ("hot", "b", "calm") for s in "ABC"]
    got = replay.replay_turn_edits(
        spark.createDataFrame(rows, TURN),
        spark.createDataFrame(roster, "meeting_id string, speaker_id string"),
        spark.createDataFrame(
            log, "meeting_id string, seq long, op string, turn_id string, speaker_id string, arg string, num double"
        ),
    ).collect()
    for meeting in ("hot", "b", "calm"):
        want, dropped = plain_replay(
            [r for r in rows if r[0] == meeting], [e for e in log if e[0] == meeting], "ABC"
        )
        mine = sorted(
            (r for r in got if r.meeting_id == meeting and r.kind == "turn"),
            key=lambda r: (r.island, r.pos),
        )
        assert [
            (r.turn_id, r.speaker_id, r.start, r.end, r.text, r.is_edited) for r in mine
        ] == want
        touched = {r.turn_id for r in got if r.meeting_id == meeting and r.kind == "touched"}
        assert touched == dropped
