"""Conversation structure repair by error-correcting Earley parsing with a weighted role grammar.

The grammar derives role initials: nothing, or an optional system turn and pairs of a user's and an assistant's turn. Its
error productions delete a turn, give it another role, or insert one, each at a cost. A chart holds, for every item that a
prefix of the conversation allows, the least (cost, audit), where an audit is the initials of the edits so far; the
completed items of the last chart give the repair. The grammar is linear to the left, so every item begins at the first
turn and a chart has a handful of items however long the conversation is.

One audit at an item is never the beginning of another of the same cost there: the longer one would have more
insertions, which cost. So the least audit of a whole is put together from least audits of its parts.

That also lets a conversation be parsed in blocks. Turns are dealt by ranges of (conversation, turn), a task parses what it
has in blocks of bounded size, and a block at the edge of a task is parsed from each item that it may be entered with; such
blocks are chained afterwards. So a conversation that holds a third of all turns is spread over many tasks, and
exact copies of a turn are one counted row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import store

#: Productions by head. S is a conversation, T at least one pair, H what may stand before the pairs.
GRAMMAR = {"S": [(), ("T",)], "T": [("H", "u", "a"), ("T", "u", "a")], "H": [(), ("s",)]}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: Turns, and characters, of one block of a conversation.
TURNS, CHARS = 1024, 4_000_000


def _compiled() -> tuple[list[str], list[tuple[int, ...]], list[int], list[int]]:
    """Items that a chart keeps, as what comes next (a terminal, or nothing where S is complete) and the items kept
    once that is found; the items before the first turn; those that complete a conversation."""

    def spread(items: list[tuple]) -> list[tuple]:
        """With what is predicted and completed from there. What waits for a head begins at the first turn, as all does."""
        found = list(items)
        for head, body, dot in found:
            more = []
            if dot == len(body):
                more = [(h, b, 1) for h, rules in GRAMMAR.items() for b in rules if b[:1] == (head,)]
            elif body[dot] in GRAMMAR:
                more = [(body[dot], b, 0) for b in GRAMMAR[body[dot]]]
            found += [x for x in more if x not in found]
        return [x for x in found if (x[2] == len(x[1]) and x[0] == "S") or (x[2] < len(x[1]) and x[1][x[2]] not in GRAMMAR)]

    start = spread([("S", b, 0) for b in GRAMMAR["S"]])
    items, after = list(start), []
    for head, body, dot in items:
        reached = spread([(head, body, dot + 1)]) if dot < len(body) else []
        items += [x for x in reached if x not in items]
        after.append(tuple(items.index(x) for x in reached))
    return [b[d] if d < len(b) else "" for _, b, d in items], after, [items.index(x) for x in start], [i for i, (_, b, d) in enumerate(items) if d == len(b)]


NEXT, AFTER, START, COMPLETE = _compiled()
Chart = dict[int, tuple[int, str]]


def _put(chart: Chart, item: int, cost: int, audit: str) -> bool:
    if item in chart and chart[item] <= (cost, audit):
        return False
    chart[item] = (cost, audit)
    return True


def inserted(chart: Chart) -> Chart:
    """The chart with insertions, until none is better."""
    work = list(chart)
    while work:
        item = work.pop()
        cost, audit = chart[item]
        if NEXT[item] in ROLES:
            work += [j for j in AFTER[item] if _put(chart, j, cost + INSERT, audit + "I")]
    return chart


def scanned(chart: Chart, initial: str, fault: str) -> Chart:
    """The chart after one more turn, which may be kept, get another role, or go."""
    found: Chart = {}
    kept = TRUNCATED if fault == "truncated" else 0
    for item, (cost, audit) in chart.items():
        _put(found, item, cost + DELETE, audit + "D")
        if fault not in ("blank", "duplicate") and NEXT[item]:
            if NEXT[item] == initial:
                change, name = kept, "K"
            elif NEXT[item] in ROLES:
                change, name = kept + REROLE, "R"
            else:
                continue
            for j in AFTER[item]:
                _put(found, j, cost + change, audit + name)
    return inserted(found)


def deleted(chart: Chart, times: int) -> Chart:
    """The chart after turns that have to go. Insertions between them never have a lesser audit than those behind."""
    return inserted({i: (cost + DELETE * times, audit + "D" * times) for i, (cost, audit) in chart.items()})


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a turn: blank, duplicate or truncated, else nothing."""
    found = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    return "blank" if not found else "duplicate" if seen else "truncated" if found[-1] not in ".!?" else ""


def applied(turns: list[tuple[str, str, int]], enter: int, audit: str) -> list[dict]:
    """The repaired turns: those kept, with the roles that the audit gives them, and those inserted. ``turns`` has copies."""
    left = (t for role, text, copies in turns for t in [(role, text)] * copies)
    expected, out = ("a" if enter >= 0 and NEXT[enter] == "a" else "u"), []
    for edit in audit:
        role, text = (ROLES[expected], "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "R":
            role = ROLES[expected]
        out.append({"role": role, "text": text, "edit": edit})
        expected = "a" if role[:1] == "u" else "u"
    return out


def parsed(turns: list[tuple], enter: int | None = None) -> tuple[dict, dict[int, Chart]]:
    """Counts of the turns of a block, and its charts by the item that it is entered with.

    ``turns`` are (turn, role, text, copies, seen) in order. -1 stands for the start of a conversation.
    """
    found = dict.fromkeys(_STATS, 0) | dict.fromkeys(("first", "last", "low", "high"))
    charts = {-1: inserted({i: (0, "") for i in START})} if enter == -1 else {i: inserted({i: (0, "")}) for i in range(len(NEXT))}
    for turn, role, text, copies, seen in turns:
        fault, initial = fault_of(text, seen), role[:1]
        for name, n in ((fault, 1), (fault if fault == "blank" else "duplicate", copies - 1)):
            if name:
                found[name] += n
        found["illegal"] += (found["last"] is not None and found["last"] + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
        found["first"], found["last"] = initial if found["first"] is None else found["first"], initial
        if turn is not None:
            found["distinct"] += turn != found["high"]
            found["low"], found["high"] = turn if found["low"] is None else found["low"], turn
        charts = {i: scanned(chart, initial, fault) for i, chart in charts.items()}
        if copies > 1:
            charts = {i: deleted(chart, copies - 1) for i, chart in charts.items()}
    return found, charts


_STATS = ["blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "distinct"]
_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, distinct bigint"
_TURNS = "turns array<struct<role:string,text:string,copies:bigint>>"
_CHARTS = "charts array<struct<enter:int,leave:int,cost:bigint,audit:string>>"
_REPAIRED = "repaired array<struct<role:string,text:string,edit:string>>"


def _best(chart: Chart) -> tuple[int, str]:
    return min(chart[i] for i in COMPLETE if i in chart)


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int, chars: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of the conversations of a partition that is sorted by conversation and turn.

    A conversation that begins after another one and ends before another one in this partition, in one block, is whole.
    """
    segment, number, out, size = TaskContext.get().partitionId(), 0, [], 0
    turns: list[tuple] = []
    conv, length, inside = None, 0, False

    def row(whole: bool) -> dict:
        found, charts = parsed(turns, -1 if whole else None)
        cost, audit = _best(charts[-1]) if whole else (None, None)
        shown = [t[1:4] for t in turns]
        return found | {
            "conv_id": conv, "segment": segment, "block": number, "whole": whole, "cost": cost, "audit": audit,
            "turns": [] if whole else [{"role": r, "text": t, "copies": n} for r, t, n in shown],
            "charts": [] if whole else [{"enter": i, "leave": j, "cost": c, "audit": a} for i, chart in charts.items() for j, (c, a) in chart.items()],
            "repaired": applied(shown, -1, audit) if whole else [],
        }

    for b in batches:
        for c, *turn in zip(*(x.to_pylist() for x in b.columns), strict=True):
            ends = bool(turns) and c != conv
            if ends or len(turns) >= most or length >= chars:
                out.append(row(inside and ends))
                size, number = size + length + 1000, number + 1
                # ``inside``: the next block begins its conversation, after another one.
                inside, turns, length = ends, [], 0
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            conv = c
            turns.append(tuple(turn))
            length += len(turn[2])
    if turns:
        out.append(row(False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one conversation in order: the item that each is entered with and its part of the least audit."""
    blocks = blocks.sort_values(["segment", "block"]).reset_index(drop=True)
    chart: dict[int, tuple[int, str]] = {i: (0, "") for i in START}
    before: list[dict[int, tuple[int, str]]] = []
    for charts in blocks["charts"]:
        found: dict[int, tuple[int, str]] = {}
        came: dict[int, tuple[int, str]] = {}
        for x in charts:
            if x["enter"] in chart:
                cost, audit = chart[x["enter"]]
                if _put(found, x["leave"], cost + x["cost"], audit + x["audit"]):
                    came[x["leave"]] = (x["enter"], x["audit"])
        chart = found
        before.append(came)
    item = min((i for i in COMPLETE if i in chart), key=lambda i: chart[i])
    cost, audit = chart[item]
    steps = []
    for came in reversed(before):
        item, piece = came[item]
        steps.append((item, piece))
    steps.reverse()
    total = blocks[["blank", "duplicate", "truncated", "illegal", "distinct"]].sum()
    edges = zip(blocks["last"][:-1], blocks["first"][1:])
    turns = [(low, high) for low, high in zip(blocks["low"], blocks["high"]) if not pd.isna(low)]
    return pd.DataFrame({
        "conv_id": blocks["conv_id"], "segment": blocks["segment"], "block": blocks["block"], "enter": [s[0] for s in steps], "piece": [s[1] for s in steps],
        "blank": total["blank"], "duplicate": total["duplicate"], "truncated": total["truncated"],
        "illegal": total["illegal"] + sum(a + b not in LEGAL for a, b in edges), "low": min((t[0] for t in turns), default=None), "high": max((t[1] for t in turns), default=None),
        "distinct": total["distinct"] - sum(a[1] == b[0] for a, b in zip(turns, turns[1:])), "cost": cost, "audit": audit,
    }).astype({"low": "Int64", "high": "Int64"})


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Different turns, how often each occurs, and whether the same role and text was seen at an earlier turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("said", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.groupBy("conv_id", "said").agg(F.min(place).alias("earliest")).select(F.col("conv_id").alias("of"), F.col("said").alias("what"), "earliest")
    both = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what")), "left")
    return both.select("conv_id", "turn", "role", "text", "copies", (place > F.col("earliest")).alias("seen"))


@dataclass
class Repair:
    """``report``: a row a conversation; ``blocks``: its repaired turns in arrays, by ``part`` in order."""

    report: DataFrame
    blocks: DataFrame

    def turns(self) -> DataFrame:
        """A row for each turn of the repaired conversations: ``conv_id, part, place, role, text, edit``, in order of part and place."""
        shown = self.blocks.select("conv_id", "part", F.posexplode("repaired").alias("place", "t"))
        return shown.select("conv_id", "part", "place", "t.role", "t.text", "t.edit")


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = TURNS, chars: int = CHARS) -> Repair:
    """Repairs each conversation at the least cost, ties by the ASCII-least audit.

    Turns are taken in order of ``turn``, nulls first; turns that tie are in order of role and text. Null roles and texts are
    one space. Each turn's first fault counts: ``blank`` (nothing but white space), ``duplicate`` (role and text occur
    earlier), ``truncated`` (the last visible character isn't one of .!?). Blank and duplicate turns go; a truncated one
    costs more unless it goes. ``illegal`` counts neighbours that aren't system-user, user-assistant or
    assistant-user by their roles' initials; ``gaps`` counts the missing numbers between the least and the largest turn, 0
    if all are null. A null id is a conversation of its own. An empty table gives empty results; other columns are ignored.

    A conversation's audit is one value, so it is bound by what a row can hold; its turns aren't gathered.
    """
    kind = conversations.schema[conv].dataType.simpleString()
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    sorted_rows = _rows(conversations, conv, turn, role, text).repartitionByRange(*order).sortWithinPartitions(*order)
    layout = f"conv_id {kind}, segment bigint, block bigint, whole boolean, {_COUNTS}, cost bigint, audit string, {_TURNS}, {_CHARTS}, {_REPAIRED}"
    schema = _arrow(conversations.sparkSession, layout)
    blocks = store.materialize(sorted_rows.mapInArrow(lambda batches: _blocks(batches, schema, most, chars), layout), "blocks")
    counts = ["blank", "duplicate", "truncated", "illegal", "low", "high", "distinct", "cost", "audit"]
    parts = blocks.where("NOT whole")
    chained = parts.select("conv_id", "segment", "block", *_STATS, "charts").groupBy("conv_id").applyInPandas(
        _chain, f"conv_id {kind}, segment bigint, block bigint, enter int, piece string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, distinct bigint, cost bigint, audit string"
    )
    chained = store.materialize(chained, "chained")
    first = F.struct("segment", "block")
    once = chained.groupBy("conv_id").agg(*[F.min_by(c, first).alias(c) for c in counts])
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct")).cast("long")
    report = blocks.where("whole").select("conv_id", *counts).unionByName(once)
    report = report.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    @F.arrow_udf(_REPAIRED.removeprefix("repaired "))
    def apply(turns: pa.Array, enter: pa.Array, piece: pa.Array) -> pa.Array:
        of = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
        rows = zip(turns.to_pylist(), enter.to_pylist(), piece.to_pylist(), strict=True)
        return pa.array([applied([(t["role"], t["text"], t["copies"]) for t in found], item, audit) for found, item, audit in rows], of)

    steps = chained.select(F.col("segment").alias("s"), F.col("block").alias("b"), "enter", "piece")
    mended = parts.join(steps, (F.col("segment") == F.col("s")) & (F.col("block") == F.col("b"))).withColumn("repaired", apply("turns", "enter", "piece"))
    part = (F.shiftleft("segment", 32) + F.col("block")).alias("part")
    return Repair(report, blocks.where("whole").select("conv_id", part, "repaired").unionByName(mended.select("conv_id", part, "repaired")))


def _arrow(spark, layout: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(layout))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops a turn, 1 empties its text, 2 takes its full stops, exclamation and question marks out, 3 repeats it, 4 makes
    it the user's. Equal rows fare alike; an empty table stays empty.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def digests(blocks: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation's repaired turns, as ``role:text`` joined by line feeds: ``conv_id, repaired_sha256``."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    each = blocks.where(F.size("repaired") > 0).select("conv_id", F.struct("part", lines.alias("text")).alias("p"))
    return each.groupBy("conv_id").agg(_joined(F.sort_array(F.collect_list("p"))).alias("repaired_sha256"))


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 256)
