"""Operator 12: fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (lines) and, at two places drawn from a hash of its id,
into prefix, middle and suffix.  No task puts an output together from a whole
text: each text is emitted as pieces of whole units (longer units as several
pieces), keyed by document and output position.  One shuffle deals the pieces out by
document and sorts them by position within the partitions; a task then streams
them into an incremental digest.  To restore, the same stream reads its own
marks, gives each piece its place in the original, and is sorted again within
the partition (no second shuffle) into a second digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import map_arrow, pack, small_batches, text_bytes

# Fixed values of the transformation: marks, seed, share of transformed texts and of the SPM form among them, in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "7"
RATE = 100
SPM = 50

#: Bytes of a piece, and of the pieces sent on at once.
PIECE_BYTES = 1 << 14
SEND_BYTES = 1 << 22

#: Place of each part in the original, by the mark before it.
ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}


def draws(doc_id: int | str | None, seed: str = SEED) -> list[int]:
    """Four numbers from the SHA-256 of ``seed:id``; a NULL id is an empty one."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i:i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(body: np.ndarray) -> np.ndarray:
    """Byte ends of the units: lines with their line end, the last one with or without."""
    ends = np.flatnonzero(body == 10) + 1
    return ends if not len(body) or (len(ends) and ends[-1] == len(body)) else np.append(ends, len(body))


def plan_parts(raw: bytes, ends: np.ndarray, doc_id: int | str | None, seed: str = SEED, rate: int = RATE,
               spm: int = SPM) -> tuple[str, list[tuple[bytes, int, int]]]:
    """The form, and (mark before it, first byte, end byte) of each part in the order of the output."""
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return "plain", [(b"", 0, len(raw))]
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[x - 1]) if x else 0 for x in (low, high))
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, len(raw))
    return ("spm", [suffix, prefix, middle]) if h4 % 100 < spm else ("psm", [prefix, suffix, middle])


def piece_cuts(ends: np.ndarray, lo: int, hi: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``size`` bytes that end with a unit, where one ends within reach."""
    while lo < hi:
        end = min(lo + size, hi)
        if end < hi:
            k = int(np.searchsorted(ends, end, side="right"))
            if k and int(ends[k - 1]) > lo:
                end = int(ends[k - 1])
        yield lo, end
        lo = end


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = pack(docs)
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text_col]
    return row.select(F.xxhash64(F.col(f"row.`{id_col}`").cast("string"), F.col(f"row.`{text_col}`")).alias("key"),
                      F.spark_partition_id().alias("part"), F.col(f"row.`{id_col}`").cast("string").alias("id"),
                      F.col(f"row.`{text_col}`").alias("text"), F.struct(*rest).alias("rest"))


def fim_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE,
               spm: int = SPM, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(key, part, no, position, piece, head): the outputs as pieces, sorted by document and position
    within partitions that hold whole documents.

    A document is named by a hash of id and text, the task that emitted it and its number there:
    equal rows stay apart, a third of all rows being equal still spreads over the emitting tasks, and
    a task that is run again sends its documents to the same partitions.  ``head`` comes with position 0
    only: (rest: the other columns, n, form, prefix_chars, middle_chars).  NULL and empty texts
    are plain and have one empty piece; a NULL id draws as an empty one."""
    keyed = _keyed(docs, id_col, text_col)
    head = T.StructType([T.StructField("rest", keyed.schema["rest"].dataType), T.StructField("n", T.LongType()),
                         T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                         T.StructField("middle_chars", T.LongType())])
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("part", T.IntegerType()),
                           T.StructField("no", T.LongType()), T.StructField("position", T.LongType()),
                           T.StructField("piece", T.BinaryType()), T.StructField("head", head)])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in small_batches(batches):
            rest, size = batch.column(4), 0
            out: list[list] = [[], [], [], [], [], [], [], [], []]   # key, part, no, position, piece, document, n, form, chars

            def send() -> pa.RecordBatch:
                first = pa.array([d is None for d in out[5]], pa.bool_())
                chars = [[c[i] if c else None for c in out[8]] for i in (0, 1)]
                heads = pa.StructArray.from_arrays(
                    [rest.take(pa.array(out[5], pa.int32())), pa.array(out[6], pa.int64()), pa.array(out[7], pa.string()),
                     pa.array(chars[0], pa.int64()), pa.array(chars[1], pa.int64())],
                    names=["rest", "n", "form", "prefix_chars", "middle_chars"], mask=first)
                return pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()), heads],
                    names=["key", "part", "no", "position", "piece", "head"])

            keys, parts, ids = (batch.column(i).to_pylist() for i in range(3))
            data, off = text_bytes(batch.column(3))
            for k in range(batch.num_rows):
                body = data[off[k]:off[k + 1]]
                raw, ends = body.tobytes(), unit_ends(body)
                form, planned = plan_parts(raw, ends, ids[k], seed, rate, spm)
                by_mark = {m: (lo, hi) for m, lo, hi in planned}
                chars = None if form == "plain" else [_chars(raw[slice(*by_mark[m])]) for m in (PREFIX, MIDDLE)]
                pieces = [x for mark, lo, hi in planned
                          for x in ([mark] if mark else []) + [raw[a:b] for a, b in piece_cuts(ends, lo, hi, piece_bytes)]]
                for position, piece in enumerate(pieces or [b""]):
                    top = position == 0
                    for values, v in zip(out, (keys[k], parts[k], no, position, piece, k if top else None,
                                               len(ends) if top else None, form if top else None, chars if top else None)):
                        values.append(v)
                    size += len(piece) + 64
                    if size > SEND_BYTES:
                        yield send()
                        out, size = [[] for _ in out], 0
                no += 1
            if out[0]:
                yield send()

    pieces = map_arrow(keyed, emit, schema)
    return pieces.repartition("key", "part").sortWithinPartitions("key", "part", "no", "position")


def _documents(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list]]:
    """(document, values) of each row of a sorted stream; the document is (key, part, no)."""
    for batch in small_batches(batches):
        yield from zip(zip(*(batch.column(i).to_pylist() for i in range(3))),
                       zip(*(batch.column(i).to_pylist() for i in range(3, columns))))


def digests(pieces: DataFrame) -> DataFrame:
    """(head, output_sha256, restored_sha256) per document of ``fim_pieces``.

    Both digests are incremental, a piece at a time.  The second pass sees the output's pieces and the
    form alone: the marks that the first one read name the parts."""
    base = pieces.select("key", "part", "no", "position", "piece", F.col("head.form").alias("form"),
                         F.when(F.col("position") == 0, F.col("head")).alias("head"))
    schema = T.StructType([*base.schema.fields[:3], T.StructField("place", T.IntegerType()), T.StructField("position", T.LongType()),
                           T.StructField("piece", T.BinaryType()), T.StructField("output", T.StringType()), base.schema["head"]])

    def read_output(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece with its place in the original; a document's digest follows as a row at place -1."""
        names = ["key", "part", "no", "place", "position", "piece", "output", "head"]
        at, form, place, digest = None, None, 0, hashlib.sha256()

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*at, -1, 0, None, digest.hexdigest()),
                                                  (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()))]
                + [pa.nulls(1, kind)], names=names)

        kind = None
        for batch in small_batches(batches):
            kind = batch.column(6).type
            documents = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            places, outputs = [], []
            for document, piece, shape in zip(documents, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if document != at:
                    if at is not None:
                        outputs.append((*at, digest.hexdigest()))
                    at, form, place, digest = document, shape, 0, hashlib.sha256()
                digest.update(piece)
                mark = form != "plain" and piece in ORDER
                place = ORDER[piece] if mark else place
                places.append(None if mark else place)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(places, pa.int32()), batch.column(3),
                 batch.column(4), pa.nulls(batch.num_rows, pa.string()), batch.column(6)], names=names)
            if outputs:
                cols = list(zip(*outputs))
                n = len(outputs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                     pa.array([-1] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.nulls(n, pa.binary()),
                     pa.array(cols[3], pa.string()), pa.nulls(n, kind)], names=names)
        if at is not None:
            yield ended()

    # The mark at position 0 carries the head, so it stays until the second pass; marks have no place and are left out of the text.
    placed = map_arrow(base, read_output, schema)
    placed = placed.sortWithinPartitions("key", "part", "no", F.coalesce("place", F.lit(-1)), "position", F.col("output").isNull())
    out = T.StructType([base.schema["head"], T.StructField("output_sha256", T.StringType()),
                        T.StructField("restored_sha256", T.StringType())])

    def read_original(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, output, digest = None, None, None, hashlib.sha256()

        def send(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([d[0] for d in done]), pa.array([d[1] for d in done], pa.string()),
                                               pa.array([d[2] for d in done], pa.string())],
                                              names=["head", "output_sha256", "restored_sha256"])

        for batch in small_batches(batches):
            done, heads = [], batch.column(7)
            valid = heads.is_valid().to_pylist()
            rows = zip(zip(*(batch.column(i).to_pylist() for i in range(3))), *(batch.column(i).to_pylist() for i in (3, 5, 6)))
            for i, (document, place, piece, whole) in enumerate(rows):
                if document != at:
                    if at is not None:
                        done.append((head, output, digest.hexdigest()))
                    at, head, output, digest = document, None, None, hashlib.sha256()
                if valid[i]:
                    head = heads.slice(i, 1)
                if place == -1:
                    output = whole
                elif place is not None:
                    digest.update(piece)
            if done:
                yield send(done)
        if at is not None:
            yield send([(head, output, digest.hexdigest())])

    return map_arrow(placed, read_original, out)


def fim_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(rest, n, form, prefix_chars, middle_chars, output): the transformed texts themselves;
    ``rest`` is a struct of the input's other columns.  Each output is as long as its text and three marks."""
    pieces = fim_pieces(docs, id_col, text_col, **options)
    schema = T.StructType([pieces.schema["head"], T.StructField("output", T.StringType())])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, parts = None, None, []

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([head, pa.array([b"".join(parts).decode("utf-8", "surrogatepass")], pa.string())],
                                              names=["head", "output"])

        for batch in small_batches(batches):
            heads = batch.column(5)
            for i, (document, (position, piece)) in enumerate(_documents([batch], 5)):
                if document != at:
                    if at is not None:
                        yield one()
                    at, head, parts = document, heads.slice(i, 1), []
                parts.append(piece)
        if at is not None:
            yield one()

    return map_arrow(pieces, join, schema).select("head.*", "output")


def restore(output: Column, form: Column) -> Column:
    """The original text of an output, as a column expression (an output that is not plain has each mark once)."""
    part = F.split(output, "<P>|<S>|<M>", -1)
    return F.when(form == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))) \
            .when(form == "spm", F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = digests(fim_pieces(docs.select("doc_id", "text")))
    return out.select(F.col("head.rest.doc_id").alias("doc_id"), *(F.col(f"head.{c}").alias(c) for c in
                      ("n", "form", "prefix_chars", "middle_chars")), "output_sha256", "restored_sha256")


def _draw(i: int) -> str:
    return f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
), c AS (
  SELECT *, len(u) AS n, least({_draw(0)} % (len(u) + 1), {_draw(1)} % (len(u) + 1)) AS a,
         greatest({_draw(0)} % (len(u) + 1), {_draw(1)} % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_draw(2)} % 100 >= {RATE} THEN 'plain'
              WHEN {_draw(3)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
         array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
