"""Operator 8: line deduplication by content-defined chunks.

A rolling hash over the hashes of neighbouring lines chooses the boundaries, so
lines put in or taken out move no boundary further on.  A chunk of two lines
or more that occurs again anywhere in the corpus is removed wherever its bytes
equal those of its first occurrence (least doc_id, then place), which stays.

Boundaries are chosen on two levels, for chunks of about four and about two lines: long
chunks are few, short ones find short passages.  What repeats on either level goes, line
by line.  A chunk is found again only if it lies wholly inside a shared passage, so
short passages between foreign lines may still stay in part.  ``windows=True`` finds them:
every run of two lines with words counts as a chunk too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import content_key, cut, map_arrow, pack, small_batches

#: On each level a boundary follows a line when the hash of it and the line before is 0 modulo this.
DIVISORS = (4, 2)
#: Multiplier of the rolling hash over line hashes.
ROLL = 31
#: Fewest lines with a word in a chunk that may be removed.
MIN_LINES = 2


def rolling_hashes(lines: list[bytes]) -> list[int]:
    """For each line but the first, the hash of it and the line before: the rolling window holds two line hashes,
    and the older one moves up as the next enters."""
    hashes = [int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in lines]
    return [(a * ROLL + b) // 8 for a, b in zip(hashes, hashes[1:])]


def chunk_bounds(lines: list[bytes], divisor: int = DIVISORS[0], rolled: list[int] | None = None) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk of a level; decided by pairs of neighbouring lines only."""
    rolled = rolling_hashes(lines) if rolled is None else rolled
    ends = [i + 2 for i, h in enumerate(rolled) if h % divisor == 0]
    edges = [0, *ends] if ends and ends[-1] == len(lines) else [0, *ends, len(lines)]
    return list(zip(edges, edges[1:]))


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _worth(lines: list[bytes], lo: int, hi: int, least: int) -> bool:
    return hi - lo >= least and sum(1 for x in lines[lo:hi] if x.strip()) >= least


def _candidates(lines: list[bytes], divisors: tuple[int, ...], least: int, windows: bool) -> list[tuple[int, int]]:
    """The ranges of lines that may be removed; with ``windows`` also those from each line with
    a word to the next such line (blank lines between belong to them)."""
    rolled = rolling_hashes(lines)
    out = {x for d in divisors for x in chunk_bounds(lines, d, rolled) if _worth(lines, *x, least)}
    if windows:
        worded = [i for i, x in enumerate(lines) if x.strip()]
        out.update((a, b + 1) for a, b in zip(worded, worded[1:]))
    return sorted(out)


def dedup_line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      divisors: tuple[int, ...] = DIVISORS, min_lines: int = MIN_LINES, windows: bool = False) -> DataFrame:
    """(row, clean_text, n_chunks, n_chunks_removed, n_lines_removed, n_bytes_removed) per input row.

    ``row`` is a struct of the input's columns.  Rows are told apart by id and
    text: rows equal in both are one document and are treated alike, so both
    keep a chunk whose first occurrence is theirs.  A NULL id sorts last; NULL
    text stays NULL; an empty table gives an empty result.  A chunk that repeats
    inside one document is removed there but for its first place.  A line goes if any
    repeated range has it; of each removed line an earlier copy is left.  ``n_chunks`` counts the
    chunks of the first level, ``n_chunks_removed`` the repeated ranges of all levels.

    Shuffled: one digest per chunk, then the documents by key, then the bytes of
    chunks whose digests repeat.  A digest held by a third of all rows is counted
    with partial sums, and its occurrences meet a single row in a join that
    Spark may split."""
    key = content_key(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")).alias("key")
    # The text travels once: alone where chunks are looked for, inside the row where they are removed.
    rows = pack(docs).select(key, F.col(f"row.`{id_col}`").cast("long").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    text_at = docs.columns.index(text_col)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys, places, ends, found = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = _lines(text)
                for lo, hi in _candidates(lines, divisors, min_lines, windows):
                    keys.append(key)
                    places.append(lo)
                    ends.append(hi)
                    found.append(xxhash.xxh3_128_digest(b"\n".join(lines[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.int32()), pa.array(ends, pa.int32()),
                                              pa.array(found, pa.binary())], names=["key", "place", "end", "digest"])

    slim = cut(map_arrow(rows.select("key", "text"), digests, "key binary, place int, end int, digest binary"))
    # Cut, like the first occurrences below: both sides of the joins are dealt out for them, and a hot digest can be split.
    again = cut(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    ranges = F.array_sort(F.collect_list(F.struct("place", "end"))).alias("places")
    suspects = slim.join(again, "digest").select("key", "place", "end").distinct().groupBy("key").agg(ranges)

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list] = [[], [], [], [], [], []]
            for key, i, text, places in zip(*(batch.column(c).to_pylist() for c in range(4))):
                lines = _lines(text)
                for lo, hi in (p.values() for p in places):
                    body = b"\n".join(lines[lo:hi])
                    for values, v in zip(out, (key, i, lo, hi, xxhash.xxh3_128_digest(body), body)):
                        values.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()),
                 pa.array(out[5], pa.large_binary()).cast(pa.binary())],
                names=["key", "id", "place", "end", "digest", "body"])

    # Equal rows give equal occurrences; one of each key is enough.
    held = rows.join(suspects, "key").select("key", "id", "text", "places")
    occ = cut(map_arrow(held, occurrences, "key binary, id long, place int, end int, digest binary, body binary"))
    # A digest's first bytes travel with its first occurrence; partial minima leave one row per digest and task.
    first = cut(occ.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "key", "place", "body")).alias("first")))
    o, f = occ.alias("o"), first.alias("f")
    later = (F.col("o.key") != F.col("f.first.key")) | (F.col("o.place") != F.col("f.first.place"))
    gone = o.join(f, F.col("o.digest") == F.col("f.digest")).where(later & (F.col("o.body") == F.col("f.first.body"))) \
            .select("o.key", "o.place", "o.end").distinct().groupBy("key").agg(ranges)

    out_schema = pack(docs).schema.add("clean_text", "string")
    names = ("n_chunks", "n_chunks_removed", "n_lines_removed", "n_bytes_removed")
    for n in names:
        out_schema = out_schema.add(n, "long")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, figures = [], [[], [], [], []]
            for text, places in zip(batch.column(0).field(text_at).to_pylist(), batch.column(1).to_pylist()):
                lines = _lines(text)
                bounds = chunk_bounds(lines, divisors[0])
                drop = {i for p in places or () for i in range(p["place"], p["end"])}
                left = [x for i, x in enumerate(lines) if i not in drop]
                clean = b"\n".join(left)
                texts.append(None if text is None else clean.decode("utf-8", "surrogatepass"))
                whole = b"\n".join(lines)
                for values, v in zip(figures, (len(bounds) if text else 0, len(places or ()), len(lines) - len(left),
                                               len(whole) - len(clean))):
                    values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()),
                                              *(pa.array(v, pa.int64()) for v in figures)],
                                             names=["row", "clean_text", *names])

    return map_arrow(pack(docs).select("row", key).join(gone, "key", "left").select("row", "places"), remove, out_schema)


def chunk_report(docs: DataFrame) -> DataFrame:
    """doc_id, figures, and the SHA-256 of the text that is left."""
    out = dedup_line_chunks(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_chunks", "n_chunks_removed", "n_lines_removed",
                      "n_bytes_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
e AS (SELECT *, (lag(h) OVER w * {ROLL} + h) // 8 AS rolled FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
v AS (SELECT *, coalesce(rolled % divisor = 0, false) AS ends FROM e, (SELECT unnest({list(DIVISORS)}) AS divisor)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r, divisor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM v),
k AS (SELECT r, doc_id, divisor, c, min(i) AS lo, max(i) + 1 AS hi, string_agg(line, chr(10) ORDER BY i) AS body,
             count(*) >= {MIN_LINES} AND count(*) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) >= {MIN_LINES} AS worth
      FROM c GROUP BY ALL),
u AS (SELECT DISTINCT r, doc_id, lo, hi, body FROM k WHERE worth),
m AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id ASC NULLS LAST, lo) > 1 AS gone FROM u),
g AS (SELECT DISTINCT r, unnest(range(lo, hi)) AS i FROM m WHERE gone),
n AS (SELECT r, count(*) FILTER (divisor = {DIVISORS[0]}) AS n_chunks FROM k GROUP BY r),
x AS (SELECT r, count(*) FILTER (gone) AS n_chunks_removed FROM m GROUP BY r),
f AS (SELECT l.r, l.doc_id, count(g.i) AS n_lines_removed,
             coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS left_text
      FROM l LEFT JOIN g ON l.r = g.r AND l.i = g.i GROUP BY ALL)
SELECT f.doc_id, CASE WHEN t = '' THEN 0 ELSE n_chunks END AS n_chunks, coalesce(n_chunks_removed, 0) AS n_chunks_removed, n_lines_removed,
       strlen(t) - strlen(left_text) AS n_bytes_removed, sha256(left_text) AS kept_sha256
FROM f JOIN d USING (r) JOIN n USING (r) LEFT JOIN x USING (r)
"""
