"""Operator 5: nearest neighbours by hierarchical navigable small-world graphs.

Vectors are dealt into shards of bounded size as they lie in the table's
partitions.  Each shard's graph is stored as one row of flat arrays (vectors,
neighbours per layer).  Blocks of queries meet every shard; each pair searches
the layers from the top and then keeps a beam on the lowest one, all queries of
the block in step.  The shards' results are merged.

Nearness is the largest inner product.  Inside a shard a further component makes
all vectors equally long, so the nearest by angle is the one with the largest
inner product.

The graph works in single precision on vectors scaled by a power of two (which changes
no order).  A shard whose lengths lie too far apart for that is scanned in double precision
instead, and so is it for a query that reached fewer of its vectors than were asked for.

Links are not searched for through the layers: a node's candidates are its nearest among
the shard's earlier nodes, found block by block, which the bounded shard allows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import cut, map_arrow


@dataclass(frozen=True)
class GraphParams:
    """``links``: neighbours on upper layers (twice as many on the lowest);
    ``width``: candidates while building; ``beam``: candidates while searching;
    ``shard_rows``, ``block_rows``: vectors in a shard, queries in a block."""

    links: int = 16
    width: int = 64
    beam: int = 256
    shard_rows: int = 8192
    block_rows: int = 512
    seed: int = 5


#: A shard whose longest vector is so many times its median one is scanned.
WIDE = 1e4


class Graph:
    """``layers[l]`` = (nodes of the layer, neighbours of each, -1 where there is none); all in flat arrays."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers
        scaled = _scaled(vectors)
        self.level = _level(scaled)
        lengths = np.sqrt(np.einsum("nd,nd->n", scaled, scaled))
        self.wide = bool(len(lengths)) and lengths.max() > WIDE * np.median(lengths)

    @classmethod
    def build(cls, vectors: np.ndarray, p: GraphParams) -> "Graph":
        n = len(vectors)
        x = _level(_scaled(vectors))
        rng = np.random.default_rng(p.seed)
        top = np.minimum(-np.log(1.0 - rng.random(n)) / np.log(p.links), 12).astype(np.int64)
        layers = []
        for layer in range(int(top.max()) + 1):
            nodes = np.flatnonzero(top >= layer)
            layers.append((nodes.astype(np.int32), _link(x[nodes], nodes, p.links * (2 if layer == 0 else 1), p.width)))
        return cls(vectors, layers)

    def search(self, queries: np.ndarray, k: int, p: GraphParams) -> tuple[np.ndarray, np.ndarray]:
        """(places in the shard, -1 where there is none; approximate inner products), best first."""
        if self.wide:
            return self.scan(queries, k)
        found, sims = self._walk(queries, k, p)
        few = np.flatnonzero((found >= 0).sum(axis=1) < min(k, len(self.vectors)))
        if len(few):
            found, sims = (np.pad(x, ((0, 0), (0, max(0, k - x.shape[1]))), constant_values=v) for x, v in ((found, -1), (sims, -np.inf)))
            places, values = self.scan(queries[few], k)
            found[few, :places.shape[1]], sims[few, :places.shape[1]] = places, values
        return found, sims

    def scan(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing with every vector; an inner product that is no number comes last."""
        with np.errstate(over="ignore", invalid="ignore"):
            sims = queries @ self.vectors.T
        sims = np.where(np.isnan(sims), -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(sims, order, 1)

    def _walk(self, queries: np.ndarray, k: int, p: GraphParams) -> tuple[np.ndarray, np.ndarray]:
        q = np.stack([_scaled(x[None])[0] for x in queries]) if len(queries) else queries
        q = np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(np.float32)
        at = np.full(len(q), int(self.layers[-1][0][0]))
        near = np.einsum("qd,qd->q", self.level[at], q)
        for nodes, links in reversed(self.layers[1:]):
            place = np.full(len(self.level), -1)
            place[nodes] = np.arange(len(nodes))
            moving = np.arange(len(q))
            while len(moving):
                to = links[place[at[moving]]]
                sim = np.einsum("qmd,qd->qm", self.level[to], q[moving])
                sim[to < 0] = -np.inf
                best = sim.argmax(axis=1)
                better = sim[np.arange(len(moving)), best] > near[moving]
                moving, to, sim, best = moving[better], to[better], sim[better], best[better]
                at[moving], near[moving] = to[np.arange(len(moving)), best], sim[np.arange(len(moving)), best]
        return self._beam(q, at, near, max(k, p.beam), k)

    def _beam(self, q: np.ndarray, at: np.ndarray, near: np.ndarray, width: int, k: int):
        links, n, steps = self.layers[0][1], len(self.level), 4
        pool = np.full((len(q), width), -1)
        sims = np.full((len(q), width), -np.inf, dtype=np.float32)
        opened = np.zeros((len(q), width), dtype=bool)
        pool[:, 0], sims[:, 0] = at, near
        seen = np.zeros((len(q), n), dtype=bool)
        seen[np.arange(len(q)), at] = True
        active = np.arange(len(q))
        while len(active):
            open_now = np.where(opened[active] | (pool[active] < 0), -np.inf, sims[active])
            pick = np.argsort(-open_now, axis=1)[:, :steps]           # the best places not looked around yet
            use = np.take_along_axis(open_now, pick, 1) > -np.inf
            some = use.any(axis=1)
            active, pick, use = active[some], pick[some], use[some]
            if not len(active):
                break
            r, c = np.nonzero(use)
            opened[active[r], pick[r, c]] = True
            from_nodes = np.where(use, np.take_along_axis(pool[active], pick, 1), -1)
            to = np.where(from_nodes[:, :, None] >= 0, links[from_nodes], -1).reshape(len(active), -1)
            to = np.sort(to, axis=1)
            to[:, 1:][to[:, 1:] == to[:, :-1]] = -1
            to[(to >= 0) & seen[active[:, None], to]] = -1
            r, c = np.nonzero(to >= 0)
            seen[active[r], to[r, c]] = True
            sim = np.full(to.shape, -np.inf, dtype=np.float32)
            sim[r, c] = np.einsum("nd,nd->n", self.level[to[r, c]], q[active[r]])
            all_sim = np.concatenate((sims[active], sim), axis=1)
            all_to = np.concatenate((pool[active], to), axis=1)
            all_open = np.concatenate((opened[active], np.zeros(to.shape, dtype=bool)), axis=1)
            order = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
            sims[active] = np.take_along_axis(all_sim, order, 1)
            pool[active] = np.take_along_axis(all_to, order, 1)
            opened[active] = np.take_along_axis(all_open, order, 1)
        pool[sims == -np.inf] = -1
        return pool[:, :k], sims[:, :k]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """All divided by the power of two next to the largest component: between -1 and 1, and in the same order."""
    most = np.abs(vectors).max(initial=0.0)
    return np.ldexp(vectors, -int(np.frexp(most)[1])) if most > 0 else vectors


def _level(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a component more that makes them equally long."""
    norms = np.einsum("nd,nd->n", vectors, vectors)
    extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
    return np.concatenate((vectors, extra[:, None]), axis=1).astype(np.float32)


def _choose(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 none) those that are nearer to the
    row than to any chosen before, filled up with the best of the others."""
    keep = np.zeros(cand.shape, dtype=bool)
    vec = x[cand]
    between = np.einsum("bcd,bed->bce", vec, vec)
    for c in range(cand.shape[1]):
        rival = np.where(keep, between[:, c, :], -np.inf).max(axis=1)
        keep[:, c] = (cand[:, c] >= 0) & (sim[:, c] > rival) & (keep.sum(axis=1) < most)
    rank = np.where(cand < 0, 2, np.where(keep, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(cand, order, 1)
    if out.shape[1] < most:
        out = np.concatenate((out, np.full((len(out), most - out.shape[1]), -1)), axis=1)
    return out


def _link(x: np.ndarray, nodes: np.ndarray, most: int, width: int, block: int = 256) -> np.ndarray:
    """Neighbours on one layer.  Nodes enter in order: each links to well-spread ones of
    its nearest earlier nodes, those link back, and crowded nodes choose again."""
    n = len(x)
    out = np.full((n, most), -1)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        sim = x[lo:hi] @ x[:hi].T
        sim[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = -np.inf
        w = min(width, hi)
        cand = np.argpartition(-sim, w - 1, axis=1)[:, :w]
        near = np.take_along_axis(sim, cand, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        cand[near == -np.inf] = -1
        out[lo:hi, :most // 2] = _choose(x, cand, near, most // 2)
    a, c = np.nonzero(out >= 0)
    b = out[a, c]
    src, dst = np.concatenate((a, b)), np.concatenate((b, a))
    pairs = np.unique(src * n + dst)
    src, dst = pairs // n, pairs % n
    first = np.searchsorted(src, np.arange(n + 1))
    degree = np.diff(first)
    place = np.arange(len(src)) - first[src]
    fits = degree[src] <= most
    out[:] = -1
    out[src[fits], place[fits]] = dst[fits]
    crowded = np.flatnonzero(degree > most)
    for lo in range(0, len(crowded), 64):
        rows = crowded[lo:lo + 64]
        w = int(degree[rows].max())
        cand = np.full((len(rows), w), -1)
        for i, r in enumerate(rows):
            cand[i, :degree[r]] = dst[first[r]:first[r + 1]]
        near = np.einsum("bcd,bd->bc", x[cand], x[rows])
        near[cand < 0] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")[:, :4 * most]
        out[rows] = _choose(x, np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1), most)
    return np.where(out >= 0, nodes[out], -1).astype(np.int32)


def usable(vec: Column) -> Column:
    """Not NULL, without NULL or non-finite components, not zero."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))


def _batches(it: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, np.ndarray]]:
    """(dimension, first columns as lists, vectors) for runs of at most ``size`` rows of one dimension;
    the vector is the last column."""
    held: dict[int, list[tuple]] = {}
    for batch in it:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*cols):
            rows = held.setdefault(len(row[-1]), [])
            rows.append(row)
            if len(rows) == size:
                yield _packed(held.pop(len(row[-1])))
    for dim in sorted(held):
        yield _packed(held[dim])


def _packed(rows: list[tuple]) -> tuple[int, list, np.ndarray]:
    cols = list(zip(*rows))
    return len(rows[0][-1]), [list(c) for c in cols[:-1]], np.array(cols[-1], dtype=np.float64)


def shard_graphs(vectors: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """One row per shard: (part, seq, dim, n, vectors, ids, layers) from rows (ids array<long>, vec array<double>)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (dim, (ids,), vec) in enumerate(_batches(batches, p.shard_rows)):
            g = Graph.build(vec, p)
            yield pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "dim": dim, "vectors": vec.tobytes(), "ids": ids,
                "nodes": [nodes.tobytes() for nodes, _ in g.layers], "links": [links.tobytes() for _, links in g.layers],
            }], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dim", pa.int32()), ("vectors", pa.binary()),
                                  ("ids", pa.list_(pa.list_(pa.int64()))), ("nodes", pa.list_(pa.binary())),
                                  ("links", pa.list_(pa.binary()))]))

    return map_arrow(
        vectors.select("ids", "vec"), run, "part int, seq int, dim int, vectors binary, ids array<array<long>>, nodes array<binary>, links array<binary>")


def nearest(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            p: GraphParams = GraphParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its k
    nearest other rows, ties to the smaller id.

    Vectors that are NULL, zero or hold NULL or non-finite components take no part;
    so do rows with a NULL id.  Vectors of different lengths are never neighbours.
    Rows equal in id and vector are rows of their own: each is a candidate of the
    other.  Equal vectors are one point of the graph with its k + 1 smallest ids: no
    result needs more.  An empty table gives an empty result.  An inner product beyond the range of a
    double is infinite, or no number where infinities meet: such come last.

    Shuffled: the vectors once (to unite equal ones) and each query block once per
    shard.  Memory of a task: one shard and one block, both bounded."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    base = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"), queries.alias("is_query")) \
               .where(F.col("id").isNotNull() & usable(F.col("vec")))
    # The limit is applied before the shuffle too, so a vector held by a third of all rows sends k + 1 rows per task.
    order = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    points = base.select("id", "vec").withColumn("n", order).where(F.col("n") <= k + 1) \
                 .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    shards = cut(shard_graphs(points, p))
    n_shards = shards.count()
    number = F.row_number().over(Window.orderBy("part", "seq")) - 1               # one slim row per shard
    names = shards.select("part", "seq").withColumn("shard", number)
    asked = base.where("is_query").select("id", "vec")
    wanted = cut(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()))

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, (ids,), v in _batches(batches, p.block_rows):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                                              pa.array([v.tobytes()], pa.binary())], names=["dim", "queries", "wanted"])

    packed = map_arrow(wanted.select("query", "vec"), blocks, "dim int, queries array<long>, wanted binary") \
                   .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")) if n_shards else \
        wanted.sparkSession.createDataFrame([], "dim int, queries array<long>, wanted binary, shard int")
    meetings = shards.join(names, ["part", "seq"]).join(packed, ["shard", "dim"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, graph, ids = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                dim, shard = row["dim"].as_py(), row["shard"].as_py()
                if shard != last:
                    x = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim)
                    layers = []
                    for nodes, links in zip(row["nodes"].as_py(), row["links"].as_py()):
                        nodes = np.frombuffer(nodes, np.int32)
                        layers.append((nodes, np.frombuffer(links, np.int32).reshape(len(nodes), -1)))
                    last, graph, ids = shard, Graph(x, layers), row["ids"].as_py()
                names_of = row["queries"].as_py()
                q = np.frombuffer(row["wanted"].as_py(), np.float64).reshape(-1, dim)
                found, _ = graph.search(q, k + 1, p)
                out: list[list] = [[], [], []]
                for name, query, places in zip(names_of, q, found):
                    places = places[places >= 0]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = graph.vectors[places] @ query
                    best = sorted((-s if s == s else np.inf, j, s) for s, place in zip(score.tolist(), places.tolist())
                                  for j in ids[place])[:k + 1]
                    out[0].extend([name] * len(best))
                    out[1].extend(s for _, _, s in best)
                    out[2].extend(j for _, j, _ in best)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()),
                                                  pa.array(out[2], pa.int64())], names=["query", "score", "vec_id"])

    found = map_arrow(
        meetings.select("shard", "dim", "vectors", "ids", "nodes", "links", "queries", "wanted"), meet,
        "query long, score double, vec_id long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id"))
    merged = found.withColumn("place", place).where(F.col("place") <= k + 1) \
                  .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    results = wanted.join(merged, "query").select("vec", "near")
    # A query's own row is one entry with its id; without it the first k stay.
    own = F.array_position(F.transform("near", lambda x: x["vec_id"]), F.col("id"))
    others = F.slice(F.filter("near", lambda x, i: (F.col("own") == 0) | (i != F.col("own") - 1)), 1, k)
    return asked.join(results, "vec").withColumn("own", own).select(
        F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"))


def search_report(vectors: DataFrame) -> DataFrame:
    return nearest(vectors.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
