"""Helpers shared by the operators: reading a table, cutting lineage in the
shared folder, row keys, and walking Arrow text columns in bounded blocks."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels (one longer text is a block of its own).
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder that the session names in
    ``spark.checkpoint.dir``.  Where it names none, a local master (tests) gets
    a scratch folder; a cluster is refused, since its executors share no local disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="riskspark-ckpt-")
    sc.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; later plans read it
    from there, so a lost executor costs no recomputation."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so tasks can import it wherever they run
    (once for each application; Spark's file server hands the archive out)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        at = os.path.join(tempfile.mkdtemp(prefix="riskspark-code-"), "riskspark-code")
        sc.addPyFile(shutil.make_archive(at, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def content_key(*cols: Column) -> Column:
    """16 bytes that stand for the given columns; NULL differs from any value."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"),
                                 c.cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat(*parts)))


def pack(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns inside one struct, so that names of extra columns can't
    clash with the operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; NULL is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) \
        else np.zeros(1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return body[off[0]:off[-1]], off - off[0]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one longer row."""
    data, off = text_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of at most ``rows`` rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
