from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from riskspark.llm import mixing
from tests.llm.helpers import clashing, empty, odd


def fair_targets(sizes):
    """By turns: share what is left by weight, stop sources at twice their size, share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 70, None: 3}, {"x": 7}, {"a": 0, "b": 10},
    {"a": 50, "b": 1, "c": 2, "d": 3, "e": 400, "f": 8}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx({s: float(t) for s, t in fair_targets(sizes).items()})


def test_taken_words_follow_targets_and_reruns_agree(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"),
        F.expr("repeat('w ', int(id * 37 % 60))").alias("text"))
    rows = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs.repartition(13)).collect()
    assert sorted(rows) == sorted(again)
    taken, target = {}, {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        key = r.source_size, r.target
        taken[key] = taken.get(key, 0) + r.taken
    for (_, t), got in taken.items():
        assert abs(got - t) < 0.01 * t + 60


def test_odd_rows(spark):
    rows = mixing.mix_report(odd(spark)).collect()
    assert len(rows) == 10 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix_report(empty(spark)).count() == 0
    docs = clashing(odd(spark), "size", "class", "cell", "hash", "id", "row", "copies", "target", "__mix_size")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.where("size <> 'theirs' OR __mix_size <> 'theirs'").count() == 0
    no_words = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix_report(no_words).collect()} == {0}


@pytest.mark.parametrize("first", [1, 0])
def test_many_rows_without_an_id(spark, first):
    """Half of a source has no id and sizes of one class: the same copies as the SQL, in cells of bounded size."""
    n = 3000
    docs = spark.range(first, n).select(
        F.when(F.col("id") % 2 == 1, F.col("id")).alias("doc_id"), F.when(F.col("id") % 5 > 0, "a").alias("source"),
        F.expr("concat(repeat('w ', 16 + int(id * 7 % 9)), id)").alias("text"))
    documents = docs.toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(f"SELECT size, source_size, target, taken, count(*) FROM ({mixing.ORACLE_SQL}) GROUP BY ALL").fetchall()
    got = mixing.mix_report(docs).groupBy("size", "source_size", "target", "taken").count().collect()
    assert sorted(map(tuple, got)) == sorted(want)
    keyed = docs.select(F.lit("").alias("hash"), F.lit(4).cast("long").alias("class"), mixing.word_count().alias("size"),
                        F.xxhash64("text").alias("tie")).withColumns(mixing._cell_keys(54))
    assert keyed.groupBy("cell", "side", "no_id_size", "part").count().agg({"count": "max"}).first()[0] < n / 20
