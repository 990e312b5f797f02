"""Conversation repair against a plain search for the cheapest edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import conversations
from tessella.llm.queries import op11_conversation_repair

ROWS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Cost, audit and repaired turns: Dijkstra's search over (turn, last role, whether any turn is kept), least audits first."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, last, kept = heapq.heappop(todo)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(kept)
        for role, initial in (("user", "u"), ("assistant", "a")):
            if last + initial in ("u", "su", "ua", "au"):
                heapq.heappush(todo, (cost + 5, audit + "I", i, initial, (*kept, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, last, kept))
            extra = 5 * (fault == "truncated")
            if fault not in ("blank", "duplicate"):
                if role and last + role[:1] in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(todo, (cost + extra, audit + "K", i + 1, role[:1], (*kept, (role, text))))
                for name, initial in (("user", "u"), ("assistant", "a")):
                    if last + initial in ("u", "su", "ua", "au"):
                        heapq.heappush(todo, (cost + extra + 1, audit + "R", i + 1, initial, (*kept, (name, text))))


def plain(rows):
    """Results by conversation from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv))
        seen, found, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            shown = VISIBLE.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            found.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(found)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def results(df, **more):
    found = conversations.repair(df, **more)
    digests = {r[0]: r[1] for r in conversations.digests(found.blocks).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    turns = {}
    for r in found.turns().orderBy("part", "place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert digests == {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in turns.items()}
    return {r[0]: (*r[1:], digests.get(r[0], nothing)) for r in found.report.collect()}


def made(seed, n, length):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Yes.", "No!", "open", "", " \n", "Why?", None, "ünd.", "a", "b.", "c.", "d.", "e"]
    return [(rng.choice([c, c, None]) if c == 0 else c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randint(1, length))]


@pytest.mark.parametrize("most, partitions", [(1024, 4), (2, 3), (1, 1)])
def test_cheapest_repairs(spark, most, partitions):
    rows = made(most, 60, 9) + made(9, 1, 60) + [(77, 5, "user", "Same.")] * 5
    df = spark.createDataFrame(rows, ROWS).withColumns({"cost": F.lit(1), "audit": F.lit(""), "said": F.lit(2), "of": F.lit(3)}).repartition(partitions)
    assert results(df, most=most) == plain(rows)


def test_conversation_over_many_tasks(spark):
    rows = [(5, i, ["user", "assistant"][(i + i // 7) % 2], f"Turn {i % 90}{'.!?x'[i % 4]}") for i in range(300)] + [(4, 1, "user", "A."), (6, 0, "system", "B.")]
    assert results(spark.createDataFrame(rows, ROWS).repartition(9), most=16) == plain(rows)


def test_grammar_and_edges(spark):
    assert conversations.NEXT.count("") == len(conversations.COMPLETE) == 2 and len(conversations.NEXT) == 7
    df = spark.createDataFrame([(1, None, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "user", "x" * 100_000 + "."), (None, 0, "system", "s")], ROWS)
    assert results(df)[1] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())
    assert results(df)[2][5:7] == (2, "D") and results(df)[None][:7] == (0, 0, 0, 1, 0, 2, "D")
    assert results(df.where("false")) == {}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    hurt = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
        hurt += [] if k == 0 else [new] * (1 + (k == 3))
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | plain(hurt)
    assert {r[0]: tuple(r[1:]) for r in op11_conversation_repair(spark, SF).collect()} == want
    assert op11_conversation_repair(spark, SF).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
