"""Operator 1: remove byte strings of a given length that occur more than once.

Every window of ``length`` bytes holds an anchor: the k-gram with the least hash
among those inside it.  Equal windows have equal anchors, so a repeated window
lies around two anchors of one hash.  An anchor's context is all that a window
with that anchor can reach.  Of the contexts of one hash:

* contexts equal as a whole are repeats as a whole;
* the others, in groups of bounded size, get a suffix array over the segments
  between the places where they part from each other; neighbours in it that have
  ``length`` bytes in common are repeats;
* larger groups are first split by parts of the windows' range: the windows of a
  part share a core, so contexts with unequal cores part; at the last level a
  core is one window and equality is all there is to ask."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import cut, map_arrow, pack, text_blocks, text_or_empty
from riskspark.llm.near_duplicates import text_node
from riskspark.llm.suffix_array import longest_common, suffix_array
from riskspark.llm.textkernel import gram_hashes


@dataclass(frozen=True)
class RepeatParams:
    """``length``: bytes of a window; ``gram``: bytes of an anchor; ``group``: most
    contexts in one suffix array; ``parts``: widths of the ranges that split larger
    groups, again and again (the last must be 1).  A half of the range is enough for groups that share a common line only."""

    length: int = 400
    gram: int = 100
    group: int = 1000
    parts: tuple[int, ...] = (151, 38, 10, 1)

    def members(self, width: int) -> int:
        """Most contexts in one suffix array after a split: contexts of a part agree
        but for ``width`` bytes at either end, so they have that many segments at most."""
        return min(self.group * (self.length + self.reach) // (2 * width), 10 * self.group)

    @property
    def reach(self) -> int:
        """How far before its anchor a window can start."""
        return self.length - self.gram


#: Bytes of text hashed at once, so that the arrays of a block stay in a core's cache.
_BLOCK = 1 << 17


def anchors(data: np.ndarray, off: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every position that is the first least k-gram of some window of its text."""
    none = np.zeros(0, np.int64)
    n, w = len(data), p.reach + 1
    starts = n - p.gram + 1
    if starts < w:
        return none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(data, p.gram)
    # The upper bits rank, the lower ones tell the place; a tie goes to the first place.
    bits = np.uint64(max(28, int(starts).bit_length()))
    least = hashes >> bits
    least <<= bits
    least |= np.arange(starts, dtype=np.uint64)
    # The least of each w neighbours: of ranges twice as wide each time, then of two that overlap.
    wide = 1
    while 2 * wide <= w:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < w:
        least = np.minimum(least[:-(w - wide)], least[w - wide:])
    size = np.diff(off)
    held = np.maximum(size - p.length + 1, 0)       # windows of each text; those that start behind them cross its end
    inside = np.repeat(np.tile([True, False], len(size)), np.column_stack((held, size - held)).reshape(-1))
    least = least[inside[:len(least)]]
    least &= (np.uint64(1) << bits) - np.uint64(1)
    place = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64) if len(least) else none
    place = np.unique(place)
    return np.searchsorted(off, place, side="right") - 1, place, hashes[place]


_ANCHOR = "hash long, context binary, node binary, place long, left int, size int"


def _anchor_hashes(p: RepeatParams):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_blocks(batch.column(0), _BLOCK):
                _, _, hashes = anchors(data, off, p)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])
    return run


def _anchor_rows(p: RepeatParams):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_blocks(batch.column(1), _BLOCK):
                text, place, hashes = anchors(data, off, p)
                begin = np.maximum(off[text], place - p.reach)
                end = np.minimum(off[text + 1], place + p.length)
                body = data.tobytes()
                digest = xxhash.xxh3_128_digest
                context = [digest(body[b:e], seed=a - b) for a, b, e in zip(place.tolist(), begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(context, pa.binary()),
                    batch.column(0).take(pa.array(text + lo)), pa.array(place - off[text]),
                    pa.array((place - begin).astype(np.int32)), pa.array((end - begin).astype(np.int32))],
                    names=["hash", "context", "node", "place", "left", "size"])
    return run


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts: rows (node, text, list of wanted contexts)."""
    names = ["hash", "members", "n", "node", "place", "left", "body"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            node, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
            out: list[tuple] = []
            for c in batch.column(2)[i].as_py():
                begin = c["place"] - c["left"]
                out.append((c["hash"], c["members"], c["n"], node, c["place"], c["left"], data[begin:begin + c["size"]]))
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _shared(strings: list[bytes]) -> list[int]:
    """For each string, the longest prefix it has in common with another of the list."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in zip(order, order[1:]):
        n = _common(strings[i], strings[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _partings(strings: set[bytes]) -> dict[bytes, list[int]]:
    """For each string, in ascending order, the lengths of the prefixes after which it parts from others."""
    order = sorted(strings)
    near = [_common(a, b) for a, b in zip(order, order[1:])]
    out: dict[bytes, set[int]] = {}
    # What a string has in common with the one k places away is the least of the k values between them.
    for strings_, values in ((order, near), (order[::-1], near[::-1])):
        least: list[int] = []
        for s, n in zip(strings_, [-1, *values]):
            while least and least[-1] >= n:
                least.pop()
            if n >= 0:
                least.append(n)
            out.setdefault(s, set()).update(least)
    return {s: sorted(v) for s, v in out.items()}


def covered(contexts: list[tuple[int, bytes, bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """Per context (bytes before the anchor, bytes, its text's node, where it starts there): the ranges,
    relative to the context's start, of strings of ``length`` bytes that the group holds at another place too.

    A context is cut where it parts from any other, counted from the anchor, so two are
    cut alike as far as they go together; a segment's bytes are one symbol, and a repeat
    around the anchor is made of whole segments.
    Contexts of one text may overlap; a place met through two of them is one place."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    # How far each context goes along with any other to the left and to the right; what lies behind is in no repeat
    # around the anchor, and a context that can't reach the length is in none at all.
    left_most = _shared([body[:left][::-1] for left, body, _, _ in contexts])
    right_most = _shared([body[left:] for left, body, _, _ in contexts])
    able = [i for i in range(len(contexts)) if left_most[i] + right_most[i] >= length]
    if len(able) < 2:
        return out
    lefts = {i: contexts[i][1][contexts[i][0] - left_most[i]:contexts[i][0]][::-1] for i in able}
    rights = {i: contexts[i][1][contexts[i][0]:contexts[i][0] + right_most[i]] for i in able}
    cut_left, cut_right = _partings(set(lefts.values())), _partings(set(rights.values()))
    name: dict[bytes, int] = {}

    def side(string: bytes, cuts: list[int]) -> tuple[list[int], list[int], list[int]]:
        """(symbols, weights, starts) of the segments between cuts."""
        bounds = sorted({0, len(string), *cuts})
        return ([name.setdefault(string[a:b], len(name) + 1) for a, b in zip(bounds, bounds[1:])],
                [b - a for a, b in zip(bounds, bounds[1:])], bounds[:-1])

    left_side = {s: side(s[::-1], [len(s) - c for c in cuts]) for s, cuts in cut_left.items()}
    right_side = {s: side(s, cuts) for s, cuts in cut_right.items()}
    text, weight, start, size = [], [], [], []
    for i in able:
        left = contexts[i][0]
        symbols, weights, starts = left_side[lefts[i]]
        symbols_, weights_, starts_ = right_side[rights[i]]
        text += symbols
        text += symbols_
        text.append(-1 - i)                         # ends a context, unlike any other symbol
        weight += weights
        weight += weights_
        weight.append(0)
        low = left - left_most[i]
        start += [low + a for a in starts]
        start += [left + a for a in starts_]
        start.append(left + right_most[i])
        size.append(len(symbols) + len(symbols_) + 1)
    order = suffix_array(text)
    near = np.array([*longest_common(text, order, weight), 0])
    owner, begin = np.repeat(np.arange(len(able)), size), np.array(start)
    ids: dict[bytes, int] = {}
    node = np.array([ids.setdefault(contexts[i][2], len(ids)) for i in able])[owner]
    place = np.array([contexts[i][3] for i in able])[owner] + begin
    at = np.array(order)
    # What each suffix shares with the nearest one of another place, before and behind it.
    same = np.flatnonzero((node[at[1:]] == node[at[:-1]]) & (place[at[1:]] == place[at[:-1]])) + 1
    before, behind = near[:-1].copy(), near[1:].copy()
    for k in same.tolist():
        before[k] = min(before[k], before[k - 1])
    for k in same[::-1].tolist():
        behind[k - 1] = min(behind[k - 1], behind[k])
    most = np.empty(len(at), np.int64)
    most[at] = np.maximum(before, behind)
    hit = np.flatnonzero(most >= length)
    owner, begin = owner[hit], begin[hit]
    end = begin + most[hit]
    # A range that lies in an earlier one of its context adds nothing.
    reached = np.maximum.accumulate(owner * (int(end.max(initial=0)) + 1) + end)
    new = np.concatenate(([True], reached[1:] > reached[:-1])) if len(hit) else hit
    for i, a, b in zip(owner[new].tolist(), begin[new].tolist(), end[new].tolist()):
        out[able[i]].append((a, b))
    return out


_COVER = "node binary, begin long, end long"


def _cover_rows(length: int):
    """Rows with ``members`` (n, node, place, left, body): the ranges of those that occur once as a whole."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, begins, ends = [], [], []
            for members in batch.column(0):
                rows = members.as_py()
                for row, ranges in zip(rows, covered(
                        [(r["left"], r["body"], r["node"], r["place"] - r["left"]) for r in rows], length)):
                    for a, b in _merge(ranges) if row["n"] == 1 else ():
                        nodes.append(row["node"])
                        begins.append(row["place"] - row["left"] + a)
                        ends.append(row["place"] - row["left"] + b)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(begins, pa.int64()),
                                              pa.array(ends, pa.int64())], names=["node", "begin", "end"])
    return run


def _split_rows(width: int, p: RepeatParams):
    """Split contexts (core, n, node, place, left, body) by parts of the windows' range: a row for each part
    with a window.  The new core names the old group, the part and the bytes that its windows share;
    a window is in one part of a group, so no place of a text meets itself."""
    names = ["core", "span", "n", "node", "place", "left", "body"]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                left, body = row["left"], row["body"]
                for x in range(0, p.reach + 1, width):           # windows that start x to x + width - 1 before the anchor
                    if x > left:
                        break
                    widest = min(x + width - 1, left)
                    if left - widest + p.length > len(body):
                        continue
                    core = body[left - x:left - x - (width - 1) + p.length]
                    a, b = left - widest, min(len(body), left - x + p.length)
                    span = body[a:b]
                    out.append((xxhash.xxh3_128_digest(row["core"] + core, seed=x), xxhash.xxh3_128_digest(span, seed=left - x - a),
                                row["n"], row["node"], row["place"] - x, left - x - a, span))
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)
    return run


def _sized(rows: DataFrame) -> DataFrame:
    """Rows with the size of their group, ``members``; a group of one, or in which
    every row has n > 1, has nothing to find."""
    sizes = rows.groupBy("core").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")) \
                .where("members > 1 and least = 1").drop("least")
    # Cut, so that a large group is dealt out in the join and doesn't follow the small ones to their tasks.
    return cut(rows.join(sizes, "core"))


def _groups(sized: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(groups of 2 to ``most`` rows as one row of members, rows of larger groups)."""
    small = sized.where(F.col("members") <= most).groupBy("core").agg(
        F.collect_list(F.struct("n", "node", "place", "left", "body")).alias("members")).select("members")
    return small, sized.where(F.col("members") > most)


def repeated_ranges(docs: DataFrame, text_col: str = "text", p: RepeatParams = RepeatParams()) -> DataFrame:
    """(node, begin, end): byte ranges, possibly overlapping, that together cover what repeats in a text;
    ``node`` stands for the text (``text_node``)."""
    texts = docs.select(text_node(F.col(f"`{text_col}`")).alias("node"), text_or_empty(f"`{text_col}`").alias("text")) \
                .where(F.octet_length("text") >= p.length)
    # Counted by hash alone first; the second reading makes contexts, most of which find no equal hash.
    # Cut, so that both sides of the join are dealt out for it and a hash held by many anchors can be split.
    again = cut(map_arrow(texts.select("text"), _anchor_hashes(p), "hash long").groupBy("hash").agg(
        F.count(F.lit(1)).alias("c")).where("c > 1").select("hash"))
    found = cut(map_arrow(texts, _anchor_rows(p), _ANCHOR).join(again, "hash"))
    kinds = found.groupBy("hash", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "place", "left", "size")).alias("one"))
    kinds = cut(kinds.select("hash", "context", "n", "one.*"))

    whole = found.join(kinds.where("n > 1").select("hash", "context"), ["hash", "context"]) \
                 .where(F.col("size") >= p.length) \
                 .select("node", (F.col("place") - F.col("left")).alias("begin"),
                         (F.col("place") - F.col("left") + F.col("size")).alias("end"))
    covers = [whole]

    # As in _sized, but before the contexts' bytes are there.
    mixed = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where("members > 1 and least = 1")
    wanted = kinds.join(mixed.drop("least"), "hash").groupBy("node").agg(
        F.collect_list(F.struct("hash", "members", "n", "place", "left", "size")).alias("contexts"))
    # Each text is fetched once; copies go before the shuffle.
    held = texts.dropDuplicates(["node"]).join(wanted, "node")
    rows = cut(map_arrow(held.select("node", "text", "contexts"), _bodies,
                         "hash long, members long, n long, node binary, place long, left int, body binary"))
    small, large = _groups(rows.withColumn("core", F.unhex(F.lpad(F.hex("hash"), 16, "0"))), p.group)
    covers.append(map_arrow(small, _cover_rows(p.length), _COVER))
    for width in p.parts:
        if large.isEmpty():
            break
        parts = cut(map_arrow(large.select("core", "n", "node", "place", "left", "body"), _split_rows(width, p),
                              "core binary, span binary, n long, node binary, place long, left int, body binary"))
        spans = parts.groupBy("core", "span").agg(F.sum("n").alias("n"), F.first(F.struct("node", "place", "left", "body")).alias("one"))
        spans = cut(spans.select("core", "span", "n", "one.*"))
        # A span held twice is a repeat as a whole, wherever it stands.
        covers.append(parts.where("n = 1").join(spans.where("n > 1").select("core", "span"), ["core", "span"]).select(
            "node", (F.col("place") - F.col("left")).alias("begin"),
            (F.col("place") - F.col("left") + F.octet_length("body")).alias("end")))
        small, large = _groups(_sized(spans.drop("span")), p.members(width))
        covers.append(map_arrow(small, _cover_rows(p.length), _COVER))
    out = covers[0]
    for c in covers[1:]:
        out = out.union(c)
    return out.distinct()


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text_col: str = "text", p: RepeatParams = RepeatParams(),
                   with_bytes: bool = True) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_bytes) per input row; ``row`` is a struct of its columns.

    Texts are taken as UTF-8 bytes; NULL is the empty text; texts shorter than a window
    lose nothing; repeated rows lose all that repeats, being repeats of each other;
    an empty table gives an empty result."""
    ranges = repeated_ranges(docs, text_col, p).groupBy("node").agg(
        F.collect_list(F.struct("begin", "end")).alias("ranges"))
    # The text crosses the join inside its row alone.
    rows = pack(docs).withColumn("node", text_node(F.col(f"row.`{text_col}`")))
    joined = rows.join(ranges, "node", "left").select("row", "ranges")
    text_at = docs.columns.index(text_col)
    schema = pack(docs).schema
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string",
             "spans": "array<struct<begin:bigint,end:bigint>>", "kept_bytes": "binary"}
    if not with_bytes:
        added.pop("kept_bytes")
    for name, kind in added.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in added}
            for text, ranges in zip(batch.column(0).field(text_at), batch.column(1)):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = _merge([(r["begin"], r["end"]) for r in ranges.as_py() or ()])
                edges = [0, *(x for s in spans for x in s), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                values = (len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                          [{"begin": a, "end": b} for a, b in spans], kept)
                for c, v in zip(added, values):
                    out[c].append(v)
            types = {"kept_sha256": pa.string(), "spans": span_type, "kept_bytes": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], types.get(c, pa.int64())) for c in added)],
                                             names=["row", *added])

    return map_arrow(joined, run, schema)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs.select("doc_id", "text"), with_bytes=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
