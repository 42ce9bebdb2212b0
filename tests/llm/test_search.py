import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm.graph_search import Graph, GraphParams, nearest, search_report


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def brute(rows, k=20):
    """Every usable query against every other usable row, in double precision."""
    use = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, (q, x) in enumerate(use):
        if q % 20 == 0:
            near = sorted((-float(x @ y), j) for b, (j, y) in enumerate(use) if a != b and len(x) == len(y))[:k]
            out.setdefault(q, []).append([(j, -s) for s, j in near])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), 0) for i in range(120)]
    rows += [(200 + i, [0.5] * 6, 0) for i in range(60)]                       # ties: one vector, many ids
    rows += [(400, [0.0] * 6, 0), (420, None, 0), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (460, [float("nan")] * 6, 0),
             (480, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (500, [3.0, 1.0], 0), (501, [2.0, 1.0], 0)]
    got, want = found(search_report(frame(spark, rows))), brute(rows)
    assert set(got) == set(want)
    for q, (near,) in want.items():
        assert [j for j, _ in got[q]] == [j for j, _ in near]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], rel=1e-12)


def test_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=32) * rng.uniform(0.5, 2)).tolist(), 0) for i in range(4000)]
    p = GraphParams(shard_rows=1000)
    got = found(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, p=p))
    want = brute(rows)
    hits = [len({j for j, _ in got[q]} & {j for j, _ in near}) / 20 for q, (near,) in want.items()]
    assert len(hits) == 200 and np.mean(hits) >= 0.9


def test_layers_are_flat_neighbour_arrays():
    x = np.random.default_rng(3).normal(size=(2000, 8))
    g = Graph.build(x, GraphParams())
    assert len(g.layers) > 1 and len(g.layers[0][0]) == 2000
    for nodes, links in g.layers:
        assert links.dtype == np.int32 and links.shape[0] == len(nodes)
        assert set(links[links >= 0].tolist()) <= set(nodes.tolist())
    assert all(len(a[0]) > len(b[0]) for a, b in zip(g.layers, g.layers[1:]))


def test_odd_tables(spark):
    assert search_report(frame(spark, [])).count() == 0
    assert search_report(frame(spark, [(20, [1.0, 2.0], 1)])).count() == 0
    twice = found(search_report(frame(spark, [(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (3, [1.0, 0.0], 1)])))
    assert sorted(twice[20]) == [(3, 1.0), (3, 1.0), (20, 5.0), (20, 5.0)]      # each of two equal rows is the other's
    more = frame(spark, [(20, [1.0, 2.0], 1), (3, [1.0, 0.0], 1)]).withColumns({"id": F.lit(1), "vec": F.lit(2), "own": F.lit(3)})
    assert search_report(more).count() == 1


def test_components_beyond_single_precision(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(10)] + [(20, [1e200, 1.0, 0.0, 0.0]), (40, [0.0, 1e39, -1e39, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = found(search_report(df))
    assert set(got) == {0, 20, 40}
    for q, near in got.items():
        x = dict(rows)[q]
        want = sorted(((-float(np.dot(x, y)), i) for i, y in rows if i != q))
        assert [j for j, _ in near] == [i for _, i in want]               # all other rows, nearest first
        assert [s for _, s in near] == pytest.approx([-s for s, _ in want], rel=1e-12)


def test_small_scales_are_not_lost():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    for scale in (1e-300, 1e-60, 1e150):
        g = Graph.build(x * scale, GraphParams())
        assert not g.wide
        f, _ = g.search(x[:50] * scale, 20, GraphParams())
        want = np.argsort(-(x[:50] @ x.T), axis=1)[:, :20]
        assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(f.tolist(), want.tolist())]) >= 0.9


@pytest.mark.parametrize("lengths", ["even", "log-normal"])
def test_recall_of_one_full_shard(lengths):
    """The largest shard there is, at the defaults: more rows make more shards, not larger ones."""
    p, rng = GraphParams(), np.random.default_rng(7)
    x = rng.normal(size=(p.shard_rows, 64))
    if lengths == "log-normal":
        x *= rng.lognormal(0, 1, size=(len(x), 1))
    q = rng.normal(size=(200, 64))
    f, _ = Graph.build(x, p).search(q, 20, p)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(f.tolist(), want.tolist())]) >= 0.9


def test_unreached_vectors_are_scanned_for():
    x = np.random.default_rng(8).normal(size=(60, 5))
    g = Graph.build(x, GraphParams())
    g.layers = [(nodes, np.full_like(links, -1)) for nodes, links in g.layers]     # no way from one node to another
    f, _ = g.search(x[:7], 20, GraphParams())
    assert (f == np.argsort(-(x[:7] @ x.T), axis=1, kind="stable")[:, :20]).all()
