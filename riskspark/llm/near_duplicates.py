"""Operator 4: near-duplicates by BagMinHash, banding and exact verification.

Texts are multisets of five-word shingles; a link is a weighted Jaccard
similarity of 0.8 or more.  Equal texts are one node.  Signatures are cut into
bands; nodes that share a band are a bucket.  First each node of a bucket is
compared with one member of it, so a family of near copies costs one comparison
per node and band.  Links are verified on the multisets themselves and joined into
components.  Where a bucket still holds several components, all its nodes are
compared across them, so no candidate that could unite two classes is skipped."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.bagminhash import band_hashes, overlap, signatures, text_shingles
from riskspark.llm.common import cut, map_arrow, pack, ship, text_blocks, text_or_empty
from riskspark.llm.components import components


@dataclass(frozen=True)
class NearParams:
    """Two texts with similarity 0.8 miss each other in all 25 bands of 4 with
    probability 2e-6.  Buckets of up to ``pairs_up_to`` nodes are compared by pairs, larger
    ones by blocks of two ``chunk``s, of fewer texts where these are long; both compare all."""

    words: int = 5
    bands: int = 25
    rows: int = 4
    percent: int = 80
    pairs_up_to: int = 48
    chunk: int = 1000
    chunk_bytes: int = 16 << 20


def text_node(text: Column) -> Column:
    """16 bytes for a text (NULL: as empty): two hashes with different seeds."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(t), F.xxhash64(F.lit(1), t))]))


def _bands(p: NearParams):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_blocks(batch.column(1)):
                got = signatures(*text_shingles(data, off, p.words), hi - lo, p.bands * p.rows)
                bands = band_hashes(got, p.rows).view(np.int64)
                node = np.repeat(np.arange(lo, hi), p.bands)
                flat = bands.reshape(-1)
                keep = flat != 0
                yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), batch.column(0).take(pa.array(node[keep]))],
                                                 names=["band", "node"])
    return run


def _verify(p: NearParams):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_blocks(batch.column(2)):
                other = batch.column(3).slice(lo, hi - lo)
                a = text_shingles(data, off, p.words)
                b = [text_shingles(d, o, p.words) + (x,) for x, _, d, o in text_blocks(other, 1 << 62)][0]
                both, either = overlap(a, b[:3], hi - lo)
                keep = pa.array(np.flatnonzero((100 * both >= p.percent * either) & (either > 0)))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo).take(keep) for i in (0, 1)],
                                                 names=["a", "b"])
    return run


def _links(pairs: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("one")), \
        texts.select(F.col("node").alias("b"), F.col("text").alias("two"))
    return cut(map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two"), _verify(p), "a binary, b binary"))


def near_classes(docs: DataFrame, text_col: str = "text", p: NearParams = NearParams()) -> tuple[DataFrame, DataFrame]:
    """((node, root) for nodes that have links, (a, b) verified links).

    NULL text is the empty text; texts without words have no links; a text of fewer than five
    words is one shingle of all of them; repeated rows are one node; an empty table
    gives empty results."""
    texts = docs.select(text_node(F.col(f"`{text_col}`")).alias("node"), text_or_empty(f"`{text_col}`").alias("text"))
    bands = cut(map_arrow(texts, _bands(p), "band long, node binary"))
    # Nodes of a bucket differ if their halves do; long minima are hash aggregates.
    half = F.xxhash64("node")
    several = bands.groupBy("band").agg(F.min(half).alias("low"), F.max(half).alias("high")).where("low <> high")
    member = bands.join(several.select("band"), "band").distinct()
    member = cut(member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).join(member, "band"))
    # A bucket's star has at its centre the node that meets most others: an original meets more of its near copies
    # than these meet each other.
    meets = member.groupBy("node").agg(F.sum("size").alias("meets"))
    lead = member.join(meets, "node").groupBy("band").agg(F.max(F.struct("meets", "node")).alias("lead"))
    stars = cut(member.join(lead, "band").where("node <> lead.node")
                .select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct())
    bodies = cut(texts.join(meets.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    links = _links(stars, bodies, p)
    roots = components(links)

    # Buckets in which several components still meet: compare across them.
    placed = member.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = cut(placed.join(mixed.select("band"), "band"))
    small, large = open_.where(F.col("size") <= p.pairs_up_to), open_.where(F.col("size") > p.pairs_up_to)
    x, y = small.alias("x"), small.alias("y")
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node"))
                    & (F.col("x.root") != F.col("y.root"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = _links(across.distinct().join(stars, ["a", "b"], "left_anti"), bodies, p)
    more = cut(more.union(_block_links(large, bodies, p)))
    if not more.isEmpty():
        links = cut(links.union(more))
        roots = components(links)
    return roots, links


def _units(large: DataFrame, bodies: DataFrame, p: NearParams) -> DataFrame:
    """Rows (band, i, j, chunk, node, root, text): what meets in the task of the chunks i <= j of a
    bucket.  A chunk has about p.chunk texts or p.chunk_bytes bytes, whichever is fewer (a longer text is whole)."""
    size = bodies.select("node", F.octet_length("text").cast("long").alias("bytes"))
    weight = cut(large.join(size, "node").groupBy("band").agg(F.sum("bytes").alias("bytes")))
    chunks = F.greatest(F.ceil(F.col("size") / p.chunk), F.ceil(F.col("bytes") / p.chunk_bytes)).cast("int")
    mine = F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = large.join(weight, "band").withColumn("chunk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.select("band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk",
                        "node", "root").join(bodies, "node")


def _block_links(large: DataFrame, bodies: DataFrame, p: NearParams) -> DataFrame:
    """Links across components inside large buckets, without a row per pair: the
    nodes of a bucket are dealt into chunks, each two chunks meet in a task, and it gives
    back only links that unite components it did not see united before."""
    units = _units(large, bodies, p)
    ship(large.sparkSession)

    def meet(unit: pa.Table) -> pa.Table:
        i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
        chunk, nodes, roots = (unit.column(c).to_pylist() for c in ("chunk", "node", "root"))
        body = unit.column("text").cast(pa.large_string()).combine_chunks()
        a, b = similar_pairs([x[2:] for x in text_blocks(body, 1 << 62)][0], p)
        up = {r: r for r in roots}

        def top(r: bytes) -> bytes:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        found: list[tuple[bytes, bytes]] = []
        for m, n in zip(a.tolist(), b.tolist()):
            if (i == j or chunk[m] != chunk[n]) and (s := top(roots[m])) != (t := top(roots[n])):
                up[s] = t
                found.append((nodes[m], nodes[n]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return units.groupBy("band", "i", "j").applyInArrow(meet, "a binary, b binary")


def similar_pairs(texts: tuple[np.ndarray, np.ndarray], p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the texts of a block whose multisets are similar enough.

    Shared shingles are counted for all pairs at once: those of few texts pair by pair, the others by
    a matrix product.  The k-th copy of a shingle is a shingle of its own, so minima of counts are counts."""
    n = len(texts[1]) - 1
    row, shingle, count = text_shingles(*texts, p.words)
    size = np.bincount(row, count, n)
    at = np.repeat(np.arange(len(row)), count)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((row[at], copy, shingle[at]))
    at, copy = at[order], copy[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (shingle[at][1:] != shingle[at][:-1]) | (copy[1:] != copy[:-1])
    start = np.flatnonzero(new)
    held = np.diff(np.append(start, len(at)))
    shared = np.zeros((n, n), dtype=np.float32)
    for k in range(2, 33):                                  # shingles of k texts
        first = start[held == k]
        for a in range(k):
            for b in range(a + 1, k):
                np.add.at(shared, (row[at[first + a]], row[at[first + b]]), 1)
    often = np.flatnonzero(held > 32)
    for lo in range(0, len(often), 2048):
        part = often[lo:lo + 2048]
        hold = np.zeros((n, len(part)), dtype=np.float32)
        for c, g in enumerate(part):
            hold[row[at[start[g]:start[g] + held[g]]], c] = 1
        shared += np.triu(hold @ hold.T, 1)
    either = size[:, None] + size[None, :] - shared
    return np.nonzero(np.triu((100 * shared >= p.percent * either) & (either > 0), 1))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearParams = NearParams()) -> DataFrame:
    """Every row as (row, node, root, class_id): rows of one root are near-duplicates;
    class_id is the least id of the class (NULL if it has none)."""
    rows = pack(docs).withColumn("node", text_node(F.col(f"row.`{text_col}`")))
    roots, _ = near_classes(docs, text_col, p)
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    slim = named.select("root", F.col(f"row.`{id_col}`").alias("id")).groupBy("root").agg(F.min("id").alias("class_id"))
    return named.join(slim, "root").select("row", "node", "root", "class_id")


def near_report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_in_class."""
    slim = docs.select("doc_id", text_node(F.col("text")).alias("node"))
    roots, _ = near_classes(docs.select("doc_id", "text"))
    named = cut(slim.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")))
    per = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_in_class"))
    return named.join(per, "root").select("doc_id", "class_id", "n_in_class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearParams = NearParams()) -> DataFrame:
    """One row of each class: the least id (NULL ids last), of repeated rows any one; the input's columns."""
    roots, _ = near_classes(docs, text_col, p)
    rows = pack(docs).withColumn("node", text_node(F.col(f"row.`{text_col}`"))).withColumn("id", F.col(f"row.`{id_col}`"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("node"))
    first = rows.select("node", "id").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")) \
                .agg(F.min(order).alias("o")).select(F.col("o.node").alias("n"), F.col("o.id").alias("i"))
    # A row's node and id name it but for repeated rows, of which the first stays.
    chosen = rows.join(first, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    one = F.row_number().over(Window.partitionBy("node", "id").orderBy(F.lit(1)))
    return chosen.withColumn("place", one).where("place = 1").select("row.*")
