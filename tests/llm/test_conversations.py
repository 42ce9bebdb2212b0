"""Operator 13 against a search over edit strings, and its damage against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from riskspark.llm import conversations as op
from riskspark.llm.registry import QUERIES
from tests.conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = SPACE.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen
                   else "truncated" if found[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Best-first search by (cost, audit) over all edit strings: no states, only the role pattern's prefixes."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and GOOD.match(initials):
            return cost, audit, out
        # What is to come depends on the place and on how the pattern goes on only.
        seen = (i, initials[-1:] if initials else "", len(initials) > 0)
        if seen in done:
            continue
        done.add(seen)
        def go(c, letter, j, role, text):
            if role is None:
                heapq.heappush(heap, (cost + c, audit + letter, j, initials, out))
            elif any(GOOD.match(initials + role[:1] + rest) for rest in ("", "a", "ua")):
                heapq.heappush(heap, (cost + c, audit + letter, j, initials + role[:1], (*out, f"{role}:{text}")))
        for role in ("user", "assistant"):
            go(3, "I", i, role, "")
        if i < len(rows):
            _, role, text = rows[i]
            extra = 3 if found[i] == "truncated" else 0
            go(4, "D", i + 1, None, None)
            if found[i] not in ("blank", "duplicate"):
                go(extra, "K", i + 1, role if role[:1] in ("s", "u", "a") else "x", text)
                for to in ("user", "assistant"):
                    go(3 + extra, "R", i + 1, to, text)
    raise AssertionError


def brute(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t, r or " ", " " if x is None else x) for t, r, x in ((t, " " if r is None else r, x) for t, r, x in rows)),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"),
            found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def compare(spark, convs, parts=4):
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r["conv"]: tuple(r[c] for c in COLUMNS) for r in op.repair_report(df).collect()}
    assert got == {c: brute(rs) for c, rs in convs.items()}


def test_random_conversations(spark):
    rnd = random.Random(5)
    texts = ["Fine.", "Well!", "Why?", "cut off", "", " \n", "Fine.", "more.  ", "x"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    convs = {c: [(rnd.randint(0, 9) if rnd.random() > 0.05 else None, rnd.choice(roles), rnd.choice(texts) + rnd.choice(["", str(i) + "."]))
                 for i in range(rnd.randint(1, 9))] for c in range(400)}
    compare(spark, convs)


def test_nulls_and_extremes(spark):
    convs = {None: [(0, "user", "A."), (1, "assistant", "B.")], 1: [(None, None, None), (None, "user", "A.")], 2: [(5, "", "A.")],
             3: [(-(2 ** 63), "user", "A."), (2 ** 63 - 1, "assistant", "B.")], 4: [(0, "system", "S.")],
             5: [(0, "user", "A. " * 30_000 + "!")], 6: [(0, "user", "same."), (0, "user", "same."), (0, "assistant", "b")]}
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    got = {r["conv"]: tuple(r[c] for c in COLUMNS) for r in op.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {c: brute(rs) for c, rs in convs.items()}
    want[3] = (2 ** 63 - 1, *want[3][1:])
    assert got == want


def test_giant_conversation_across_batches(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["user", "assistant"]), f"t{i}" + rnd.choice([".", "", "?"])) for i in range(9000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        compare(spark, {1: rows[:2500], 2: [(0, "user", "A.")], 3: [(0, "assistant", "B.")]}, parts=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_rows_give_the_digest(spark):
    df = spark.read.parquet(f"{SF001}/conversations.parquet")
    bad = op.damage(df)
    digests = {r["conv"]: (r["audit"], r["repaired_sha256"]) for r in op.repair_report(bad).collect()}
    rows = op.repaired_rows(bad).collect()
    by_conv: dict = {}
    for r in rows:
        by_conv.setdefault(r["conv"], []).append(r)
    assert set(by_conv) == set(digests)
    for conv, rs in by_conv.items():
        kept = sorted((r for r in rs if r["edit"] != "D"), key=lambda r: r["place"])
        assert [r["place"] for r in kept] == list(range(len(kept)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == digests[conv][1]
        assert sorted(r["edit"] for r in rs) == sorted(digests[conv][0])
        assert GOOD.match("".join(r["role"][:1] for r in kept))


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(c, t, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs: dict = {r[0]: [] for r in rows}
    for c, *r in damaged(rows):
        convs[c].append(tuple(r))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, SF001).collect()}
    assert got == {c: brute(rs) for c, rs in convs.items()}


def test_all_rows_dropped_nulls_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "A."), (None, None, None, None), (gone + 1, None, "user", None)]
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op.conversation_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {gone, None, gone + 1}
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    convs: dict = {}
    for c, *r in damaged(rows):
        convs.setdefault(c, []).append(tuple(r))
    assert all(out[c] == brute(rs) for c, rs in convs.items())
    assert op.conversation_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    from tests.llm.helpers import clashing
    df = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "assistant", "B.")], SCHEMA)
    out = op.repair_report(clashing(df, "conv", "fault", "best", "same", "how")).collect()
    assert [(r["audit"], r["cost"]) for r in out] == [("KK", 0)]


@pytest.mark.parametrize("follow", [(0, 6, 3, 0), (4, 7, 3, 0)])
def test_a_byte_holds_the_edits(follow):
    for initial in "suax":
        for fault in range(4):
            costs, edits = op.choose(initial, fault, follow)
            assert 0 <= edits < 256 and len(costs) == 4
