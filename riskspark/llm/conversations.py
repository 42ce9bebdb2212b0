"""Operator 13: conversation structure repair by secondary-sorted streaming.

Rows are dealt out by conversation and sorted by turn, in one shuffle.  Which
edits are cheapest is a dynamic programme over four states (nothing yet, after
the system row, after a user row, after an assistant row): a first stream, in
descending order of turns, carries the least cost of what follows from each state
across Arrow batches and leaves with each row one byte, the best edit in each of
the four states.  These bytes are the backpointers: they travel with the rows through
Spark's own sort, which spills, so a giant conversation takes no more memory than a batch.  A
second stream, in ascending order, follows them from the first turn on and feeds
the repaired rows to an incremental digest or sends them out.

Ties between cheapest edits go to the ASCII-least letters: an edit leads to one
state only, so taking the least letter among the best at each step gives the
least string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import map_arrow, small_batches

# Fixed values of the repair: costs of the edits, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space around words, as in ``[^\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

# States: nothing yet, after s, after u, after a.  What may follow is u, but for a after u; s only at the start.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Cost of an end in each state: a and nothing are complete, u lacks an answer, s a question and an answer.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: In ASCII order.
EDITS = "DIKR"

FAULTS = ("blank", "duplicate", "truncated")


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, None if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def choose(initial: str, fault: int, follow: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Least costs from each state before a row, and the best edits (two bits a state), given the
    least costs ``follow`` after it.  ``fault`` is 0 for none, else 1 + its place in FAULTS."""
    extra = TRUNCATED if fault == 3 else 0
    row = []                                   # best way through this row without an insertion before it
    for state in range(4):
        ways = [(DELETE + follow[state], 0)]
        if fault in (0, 3):
            to = kept_state(state, initial)
            if to is not None:
                ways.append((KEEP + extra + follow[to], 2))
            ways.append((REROLE + extra + follow[STEP[state]], 3))
        row.append(min(ways))
    best = list(row)
    for _ in range(3):                         # insertions before the row; a path has each state at most once
        best = [min(best[s], (INSERT + best[STEP[s]][0], 1)) for s in range(4)]
    return tuple(b[0] for b in best), sum(b[1] << (2 * s) for s, b in enumerate(best))


def marked(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, fault) in partitions that hold whole conversations.

    NULL roles and texts are read as one space.  The first of equal (role, text) in a conversation is by
    turn, NULL turns first; its window asks for the partitioning that is there already."""
    named = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                        *(F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))))
    dealt = named.repartition("conv").withColumn("same", F.unhex(F.sha2(F.concat("role", F.lit(":"), "text"), 256)))
    seen = F.row_number().over(Window.partitionBy("conv", "same").orderBy(F.col("turn").asc_nulls_first()))
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(core == "", 1).when(seen > 1, 2).when(~F.right(core, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    return dealt.select("conv", "turn", "role", "text", fault.cast("int").alias("fault"))


def _order(descending: bool) -> list[Column]:
    # Equal rows of a turn: the one that is no duplicate comes first, whatever its place was.
    again = F.col("fault") == 2
    if descending:
        return [F.col("conv"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), again.desc()]
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), again]


def with_backpointers(faults: DataFrame) -> DataFrame:
    """``marked`` rows with ``best``, the best edits of the four states, sorted by conversation and turn."""

    def backwards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, follow, known, seen = None, AT_END, {}, False
        for batch in small_batches(batches):
            best = []
            for conv, role, fault in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4))):
                if not seen or conv != at:
                    at, follow, seen = conv, AT_END, True
                low = min(follow)               # choices depend on differences only, so few cases differ
                case = (role[:1], fault, *(x - low for x in follow))
                if case not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[case] = choose(role[:1], fault, case[2:])
                costs, edits = known[case]
                follow = tuple(x + low for x in costs)
                best.append(edits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32())],
                                             names=[*batch.schema.names, "best"])

    schema = T.StructType([*faults.schema.fields, T.StructField("best", T.IntegerType())])
    down = faults.sortWithinPartitions(*_order(True))
    return map_arrow(down, backwards, schema).sortWithinPartitions(*_order(False))


class Trace:
    """Follows the best edits of one conversation, row by row in ascending order."""

    def __init__(self) -> None:
        self.state, self.cost = START, 0

    def insert(self) -> tuple[str, str, str]:
        self.state = STEP[self.state]
        self.cost += INSERT
        return "I", ROLE_OF[self.state], ""

    def row(self, role: str, text: str, fault: int, best: int) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of what goes out before and at this row; role and text are None for a deleted one."""
        while True:
            edit = EDITS[best >> (2 * self.state) & 3]
            if edit == "I":
                yield self.insert()
                continue
            if edit == "D":
                self.cost += DELETE
                yield "D", None, None
                return
            self.cost += (KEEP if edit == "K" else REROLE) + (TRUNCATED if fault == 3 else 0)
            if edit == "K":
                self.state = kept_state(self.state, role[:1])
                yield "K", role, text
            else:
                self.state = STEP[self.state]
                yield "R", ROLE_OF[self.state], text
            return

    def end(self) -> Iterator[tuple[str, str, str]]:
        while AT_END[self.state]:
            yield self.insert()


def _saturated(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


class Report(Trace):
    """Counts and digest of one conversation; all but the audit has a fixed size."""

    def __init__(self) -> None:
        super().__init__()
        self.audit, self.digest, self.first = bytearray(), hashlib.sha256(), True
        self.faults, self.illegal, self.before = [0, 0, 0], 0, None
        self.least = self.most = self.last = None
        self.turns = 0

    def out(self, steps: Iterable[tuple[str, str | None, str | None]]) -> None:
        for edit, role, text in steps:
            self.audit += edit.encode()
            if role is not None:
                self.digest.update(b"" if self.first else b"\n")
                self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                self.first = False

    def take(self, turn: int | None, role: str, text: str, fault: int, best: int) -> None:
        if fault:
            self.faults[fault - 1] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:                    # ascending, so equal turns stand together
            self.turns += self.last is None or turn != self.last
            self.least, self.most, self.last = turn if self.least is None else self.least, turn, turn
        self.out(self.row(role, text, fault, best))

    def values(self) -> tuple:
        self.out(self.end())
        gaps = 0 if self.least is None else _saturated(self.most - self.least + 1 - self.turns)
        return (gaps, *self.faults, self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


LONGS = ("gaps", *FAULTS, "illegal", "cost")


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    A NULL id is a conversation of its own; NULL turns come first; rows of one turn are taken by role and text;
    repeated rows are duplicates; NULL roles and texts are one space; gaps beyond the range of a long are its
    bound; other columns are not read; an empty table gives an empty result."""
    faults = marked(rows, conv_col, turn_col, role_col, text_col)
    schema = T.StructType([faults.schema["conv"], *(T.StructField(c, T.LongType()) for c in LONGS),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    kinds = [*(pa.int64() for _ in LONGS), pa.string(), pa.string()]

    def forwards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, report = None, None

        def send(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, *kinds))], names=schema.names)

        kind = None
        for batch in small_batches(batches):
            kind, done = batch.column(0).type, []
            for conv, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if report is None or conv != at:
                    if report is not None:
                        done.append((at, *report.values()))
                    at, report = conv, Report()
                report.take(*row)
            if done:
                yield send(done, kind)
        if report is not None:
            yield send([(at, *report.values())], kind)

    return map_arrow(with_backpointers(faults), forwards, schema)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, place, turn, edit, role, text): the repaired conversations, and the deleted rows (with
    place NULL and their old role and text).  Inserted rows have no turn.  Places count from 0."""
    faults = marked(rows, conv_col, turn_col, role_col, text_col)
    schema = T.StructType([faults.schema["conv"], T.StructField("place", T.LongType()), faults.schema["turn"],
                           T.StructField("edit", T.StringType()), faults.schema["role"], faults.schema["text"]])

    def forwards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trace, place = None, None, 0

        def send(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=schema.names)

        kinds = None
        for batch in small_batches(batches):
            kinds = [batch.column(0).type, pa.int64(), batch.column(1).type, pa.string(), pa.string(), pa.string()]
            out: list[tuple] = []

            def ended() -> None:
                out.extend((at, place + k, None, *step) for k, step in enumerate(trace.end()))

            for conv, turn, role, text, fault, best in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if trace is None or conv != at:
                    if trace is not None:
                        ended()
                    at, trace, place = conv, Trace(), 0
                for edit, to, body in trace.row(role, text, fault, best):
                    if edit == "D":
                        out.append((at, None, turn, edit, role, text))
                    else:
                        out.append((at, place, None if edit == "I" else turn, edit, to, body))
                        place += 1
            if out:
                yield send(out, kinds)
        if trace is not None:
            rest = [(at, place + k, None, *step) for k, step in enumerate(trace.end())]
            if rest:
                yield send(rest, kinds)

    return map_arrow(with_backpointers(faults), forwards, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the faults that the query puts in, by the CRC-32 of ``conv_id:turn``."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate(text, "".join(ENDS), "")).otherwise(text)
    role = F.when(F.col("how") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    kept = conversations.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("how")).where("how <> 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def conversation_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; a conversation
    that loses all its rows is there with zeros."""
    found = repair_report(damage(conversations))
    every = conversations.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in LONGS),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
