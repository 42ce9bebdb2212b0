"""Operator 9: mix sources to target weights by systematic sampling.

DataFrame functions only.  Targets come from one row per source; the copies of
a document come from a running sum of expected copies within its source and
one offset per source: a document is emitted once for each integer that the
running sum, moved by the offset, crosses at it.

The running sum is taken in three levels, so neither a source nor a size class ends in one task: documents
fall into cells (source, size class, hash slice); cells hold about the square
root of the number of rows, only cell counts are summed per source and size class, and only class
counts per source.  The documents of a source are ordered by size class and hash, so that the sizes of
what is taken follow those of the source.  Rows without an id all have one hash; they fall into cells of their own, by size
and by a hash of the whole row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import cut, text_or_empty

# Fixed values of the mix: weights by turns of the sorted sources, share of all sizes, most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Targets are min(most * size, level * weight) with the one level at which
    they add up to ``share`` of all sizes: capping a source and sharing its
    excess by weight until none is above ends there.  The windows run over one
    row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - capped) / open_weight)
    # The level rises while the next source still overflows and falls after that: the largest one fits.
    target = F.least(F.col("cap"), F.max("level").over(whole) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _cell_keys(slices: int) -> dict[str, Column]:
    """Columns that name a row's cell within its source and size class, in the order of the running sum.

    Rows with an id fall into slices of their hash.  Rows without one (those with a ``tie``) lie between the ids whose hash
    is less and the others; they are parted by size, as they are ordered, and then by the tie, into about as many cells
    as a class has slices."""
    no_id = F.col("tie").isNotNull()
    parts = F.greatest(F.lit(1), F.floor(F.lit(slices) / (2 * F.col("class") + 1))).cast("long")
    return {"cell": (F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.lit(slices) / F.lit(2.0 ** 32)).cast("long"),
            "side": F.when(no_id, 1).when(F.col("hash") < F.md5(F.lit("")), 0).otherwise(2),
            "no_id_size": F.when(no_id, F.col("size")).otherwise(-1).cast("long"),
            "part": F.when(no_id, F.pmod("tie", parts)).otherwise(0).cast("long")}


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
                weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies) per input row; ``row`` is a
    struct of the input's columns.

    A NULL source is a source of its own (sorted last); a NULL id or text is
    allowed (size 0); rows equal in id, source and size are alike, so that
    exchanging them changes nothing; a source without words has target 0; an
    empty table gives an empty result.  NULL ids by the third of a table are parted by a hash of the whole
    row (rows that are equal in every column stay together).  Reruns agree: order and offset
    come from hashes of ids and source names."""
    size = word_count("text") if size is None else size
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(f"`{source_col}`").alias("source"),
                       F.col(f"`{id_col}`").cast("string").alias("id"), size.alias("size"))
    hashed = [F.col(f"row.`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = rows.withColumn("class", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long")) \
               .withColumn("hash", F.md5(F.coalesce("id", F.lit("")))) \
               .withColumn("tie", F.when(F.col("id").isNull(), F.xxhash64(*hashed)))
    slim = cut(rows.select("source", "size", "class", "hash", "tie"))
    keys = _cell_keys(max(1, math.isqrt(slim.count())))

    cells = slim.withColumns(keys).groupBy("source", "class", *keys).agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    below = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))).alias("k")
    name = F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    offset = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 32)
    targets = source_targets(slim, weights, share, most).withColumn("offset", offset).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("t")
    classes = classes.join(targets, F.col("k.source").eqNullSafe(F.col("t.source"))).select(
        "k.source", "k.class", "below", "source_size", "target", "offset", "rate").alias("k")

    before = Window.partitionBy("source", "class").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("c")
    cells = c.join(classes, F.col("c.source").eqNullSafe(F.col("k.source")) & (F.col("c.class") == F.col("k.class"))).select(
        "c.source", "c.class", *keys, (F.col("below") + F.col("before")).alias("before"), "source_size", "target", "offset", "rate")

    inner = Window.partitionBy("source", "class", *keys).orderBy("hash", F.col("id").asc_nulls_first(), "size")
    ranked = rows.withColumns(keys).withColumn("place", F.row_number().over(inner)).alias("r")
    c = cells.alias("c")
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.class") == F.col("c.class"))
    for k in keys:
        same &= F.col(f"r.{k}") == F.col(f"c.{k}")
    joined = ranked.join(c, same)
    place = F.col("before") + F.col("place")
    copies = F.floor(F.col("offset") + place * F.col("rate")) - F.floor(F.col("offset") + (place - 1) * F.col("rate"))
    return joined.select(F.col("r.row").alias("row"), F.col("r.size").alias("size"), "source_size", "target",
                         copies.cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    out = mix_sources(docs.select("doc_id", "source", "text"), size=word_count("text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, same columns."""
    out = mix_sources(docs)
    return out.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size,
         least(cap, max(level) OVER () * weight) AS target,
         (('0x' || substr(md5('mix-1|' || coalesce('s' || source, 'n')), 1, 8))::BIGINT + 0.5::DOUBLE)
         / 4294967296.0::DOUBLE AS u
  FROM l
), r AS (
  SELECT doc_id, size, source_size, target, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(size::DOUBLE)),
                            md5(coalesce(doc_id::VARCHAR, '')), doc_id ASC NULLS FIRST, size) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(u + i * rate) - floor(u + (i - 1) * rate)) * size)::BIGINT AS taken
FROM r
"""
