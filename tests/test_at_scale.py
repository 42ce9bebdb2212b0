"""Distributed dictionaries, CSV records from blocks, rejected rows, bracketed quantiles, heavy hitters,
digest-first duplicates, bottom-k samples: against plain Python, and both ways where there are two."""

import csv
import hashlib
import io
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskspark.operators import chartdata, dictionary, profile, statistics
from riskspark.operators.features import fit_indexers
from riskspark.plans import analyses
from riskspark.roles import Roles
from riskspark.sources.readers import NA_TOKENS, SourceError, read_csv
from riskspark.sources.records import csv_records, read_csv_keeping_rejects


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of 2000 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


# ---- dictionaries ------------------------------------------------------------------

def _ranked(values):
    return {v: i for i, (v, _) in enumerate(sorted(Counter(v for v in values if v is not None).items(), key=lambda e: (-e[1], e[0])))}


def _mixed(spark, n=6000):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["x", "y", None, "zz"]), f"v{rnd.randint(0, n // 3)}" if rnd.random() > 0.3 else "hot", f"u{i:05d}")
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, few string, many string, own string").repartition(6)


def test_dictionary_equals_sorting(spark):
    rows, df = _mixed(spark)
    cols = {"few": 1, "many": 2, "own": 3}
    got = {c: {} for c in cols}
    for r in dictionary.fit_dictionary(df, list(cols)).collect():
        got[r["column_name"]][r["value"]] = r["idx"]
    assert got == {c: _ranked(r[i] for r in rows) for c, i in cols.items()}
    assert dictionary.fit_dictionary(df.where("false"), ["few"]).count() == 0


def test_dictionary_agrees_with_string_indexer(spark):
    _, df = _mixed(spark, 900)
    labels = dict(zip(["few", "many"], fit_indexers(df.dropna(), ["few", "many"]).labelsArray))
    for r in dictionary.fit_dictionary(df.dropna(), ["few", "many"]).collect():
        assert labels[r["column_name"]][r["idx"]] == r["value"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_encoding_by_broadcast_and_by_shuffle(spark, few):
    rows, df = _mixed(spark)
    entries = dictionary.fit_dictionary(df.where("id % 2 = 0"), ["few", "many"])
    idx = {"few": _ranked(r[1] for r in rows if r[0] % 2 == 0), "many": _ranked(r[2] for r in rows if r[0] % 2 == 0)}
    clash = df.withColumn("dictionary_value", F.lit("theirs"))
    cols = {"few": "few_indexed", "many": "many_indexed"}
    kept = dictionary.encode(clash, entries, cols, "keep", broadcast_values=few)
    assert kept.columns == [*clash.columns, "few_indexed", "many_indexed"]
    want = {r[0]: (float(idx["few"].get(r[1], len(idx["few"]))), float(idx["many"].get(r[2], len(idx["many"])))) for r in rows}
    assert {r["id"]: (r["few_indexed"], r["many_indexed"]) for r in kept.collect()} == want
    skipped = dictionary.encode(df, entries, cols, "skip", broadcast_values=few)
    assert {r["id"] for r in skipped.collect()} == {r[0] for r in rows if r[1] in idx["few"] and r[2] in idx["many"]}
    with pytest.raises(Exception, match="has no index for"):
        dictionary.encode(df, entries, cols, broadcast_values=few).collect()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) == bool(few)


def test_prepare_with_a_wide_column(spark):
    rows = [(i, f"name{i % 211}", "abc"[i % 3], float(i % 17)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, name string, cls string, x double")
    roles = Roles(id="id", label="cls", date=None, time=None)
    a = analyses.prepare(df, roles, handle_invalid="keep")
    b = analyses.prepare(df, roles, handle_invalid="keep", wide=("name",))
    try:
        assert a.feature_names == b.feature_names
        vectors = lambda p: {r["id"]: (tuple(r["features"]), r[p.label_index]) for r in p.data.collect()}
        assert vectors(a) == vectors(b)
    finally:
        a.release()
        b.release()


# ---- CSV ---------------------------------------------------------------------------

def _write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def _untidy(seed, n=500):
    rnd = random.Random(seed)
    texts = ["plain", "two\nlines", 'say "x"\n\nmore', 'q"uo,te', "\n", '"', '""', "é\n日"]
    return [("id", "t", "x")] + [(str(i), rnd.choice(texts) if rnd.random() > 0.05 else "many\n" * rnd.randint(1, 900), str(i / 2))
                                 for i in range(n)]


def _records(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["file"], r["line"])):
        out.setdefault(r["file"], []).append(r)
    return [[tuple(next(csv.reader(io.StringIO(r["record"], newline="")))) for r in rs] for rs in out.values()], out


def test_records_across_blocks(spark, tmp_path, small_blocks):
    tables = [_untidy(1), _untidy(2, 40), [("id", "t", "x")]]
    for i, t in enumerate(tables):
        _write(tmp_path / f"{i}.csv", t)
    df = csv_records(spark, str(tmp_path))
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got, by_file = _records(df)
    assert got == tables
    text = (tmp_path / "0.csv").read_text().split("\n")
    for r in next(iter(by_file.values())):            # line numbers point at the records' first lines
        assert text[r["line"] - 1] == r["record"].split("\n")[0]


def test_parallel_read_equals_the_single_task_read(spark, tmp_path, small_blocks):
    _write(tmp_path / "a.csv", _untidy(3))
    path = str(tmp_path / "a.csv")
    ours = read_csv(spark, path, schema="id long, t string, x double", multi_line=True, na_tokens=("",))
    theirs = spark.read.schema("id long, t string, x double").option("header", True).option("multiLine", True) \
        .option("escape", '"').csv(path)
    assert theirs.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_carriage_returns_blank_lines_and_open_quotes(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes(b'id,t\r\n\r\n1,"a\r\nb"\r\n2,c')
    got, _ = _records(csv_records(spark, str(tmp_path / "a.csv")))
    assert got == [[("id", "t"), ("1", "a\r\nb"), ("2", "c")]]
    (tmp_path / "b.csv").write_text('id,t\n1,"never closed\n2,x\n3,y')
    rows = csv_records(spark, str(tmp_path / "b.csv")).orderBy("line").collect()
    assert [(r["line"], r["record"]) for r in rows] == [(1, "id,t"), (2, '1,"never closed\n2,x\n3,y')]
    (tmp_path / "c.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "c.csv")).count() == 0


def test_rejected_rows_are_kept_aside(spark, tmp_path, small_blocks):
    text = 'x,id,f\n1.5,1,"a\nb"\nbad,2,c\n3,3\n4,4,d,e\nNA,5,\n6,six,"g\nh"\n' + "".join(f"{i},{i},z\n" for i in range(100, 900))
    (tmp_path / "a.csv").write_text(text)
    read = read_csv_keeping_rejects(spark, str(tmp_path), "id long, x double, f string", NA_TOKENS)
    assert [(r["line"], r["reason"]) for r in read.rejected.orderBy("line").collect()] == [
        (4, "column x can't hold bad"), (5, "not 3 fields"), (6, "not 3 fields"), (8, "column id can't hold six")]
    assert read.rejected.where("line = 8").first()["record"] == '6,six,"g\nh"'
    assert [tuple(r) for r in read.rows.where("id < 10").orderBy("id").collect()] == [(1, 1.5, "a\nb"), (5, None, None)]
    assert read.rows.count() == 802


def test_errors_name_the_input(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    with pytest.raises(SourceError, match="no columns"):
        read_csv_keeping_rejects(spark, str(tmp_path), "id long, y double", NA_TOKENS)
    with pytest.raises(SourceError):
        read_csv_keeping_rejects(spark, str(tmp_path / "none.csv"), "id long", NA_TOKENS)
    (tmp_path / "b.csv").write_text("id,y\n1,2\n")
    with pytest.raises(SourceError, match="different headers"):
        read_csv(spark, str(tmp_path), multi_line=True)
    (tmp_path / "short.csv").write_text('id,x\n1,"a"\n2\n')
    with pytest.raises(Exception, match="not 2 fields in line 3"):
        read_csv(spark, str(tmp_path / "short.csv"), multi_line=True).collect()
    assert read_csv(spark, str(tmp_path / "short.csv"), multi_line=True, mode="DROPMALFORMED").count() == 1


# ---- statistics --------------------------------------------------------------------

def _numbers(spark, n=20_000):
    rnd = random.Random(9)
    rows = [(rnd.gauss(0, 1) if rnd.random() > 0.4 else 0.25, float(rnd.randint(0, 5)), None if rnd.random() < 0.9 else rnd.random(),
             rnd.choice([math.inf, -math.inf, math.nan, 1.0, rnd.random()]), None) for _ in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)


@pytest.mark.parametrize("margin,late", [(None, []), (0.02, []), (0.0, None)])
def test_bracketed_quantiles_are_exact(spark, margin, late):
    df = _numbers(spark)
    cols, probs = ["a", "b", "c", "d", "e"], [0.0, 0.25, 0.5, 0.9, 1.0]
    missed: list = []
    got = statistics.bracketed_quantiles(df, cols, probs, accuracy=200 if margin == 0.0 else 1000, margin=margin, missed=missed)
    assert got == statistics.quantiles(df, cols, probs)
    assert missed == late if late is not None else missed    # a bracket of no width misses: the rounds take over


def test_bracketed_quantiles_refine_large_brackets(spark, monkeypatch):
    df = _numbers(spark)
    monkeypatch.setattr(statistics, "DEFAULT_EXACT_LIMIT", 50)
    got = statistics.quantiles(df, ["a", "c"], [0.25, 0.75], method="bracketed", accuracy=100)
    assert got == statistics.quantiles(df, ["a", "c"], [0.25, 0.75])


def test_frequent_modes_equal_modes(spark):
    _, df = _mixed(spark)
    missed: list = []
    cols = ["few", "many", "own"]
    assert statistics.frequent_modes(df.withColumn("none", F.lit(None).cast("string")), [*cols, "none"], missed=missed) \
        == {**statistics.modes(df, cols), "none": (None, 0)}
    assert missed == ["own"]                       # no value is frequent: counted whole
    missed.clear()
    got = statistics.frequent_modes(df, cols, candidates=2, tracked=16, missed=missed)
    assert got == statistics.modes(df, cols) and "own" in missed
    ties = spark.createDataFrame([(v,) for v in "bbaaccd"], "v string")
    assert statistics.frequent_modes(ties, ["v"])["v"] == ("a", 2)


@pytest.mark.parametrize("few", [500_000, 0])
def test_duplicates_by_digest(spark, few):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (None, None, math.nan), (None, None, math.nan), (2, "", 1.0), (2, None, 1.0),
            (3, "1:x", 2.0), (None, "n", 2.0)] + [(7, "hot", 1.0)] * 500
    df = spark.createDataFrame(rows, "i long, s string, x double").repartition(4)
    want = profile.duplicate_rows(df).first()
    assert profile.duplicate_rows_by_digest(df, broadcast_digests=few).first() == want
    assert want["duplicate_rows"] == 1 + 1 + 499
    assert tuple(profile.duplicate_rows_by_digest(df.where("false")).first()) == (0, 0, 0)
    odd = df.withColumn("digest", F.lit(1)).withColumn("n", F.array("i"))
    assert profile.duplicate_rows_by_digest(odd).first() == want


def test_equal_digests_of_different_rows_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(profile, "row_digest", lambda df, cols: F.lit(b"same"))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None)], "i long, s string")
    assert tuple(profile.duplicate_rows_by_digest(df).first()) == (4, 3, 1)


def test_sample_of_points_is_the_same_for_any_partitions(spark):
    points = spark.range(5000).select((F.col("id") % 3).alias("cluster"), "id", (F.col("id") * 0.5).alias("x"))
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = {(i % 3, i) for c in range(3) for i in sorted(range(c, 5000, 3), key=key)[:40]}
    for parts in (1, 7):
        got = chartdata.sample_points(points.repartition(parts), F.col("id"), 40)
        assert {(r["cluster"], r["id"]) for r in got.collect()} == want
    halves = points.where("id < 2000"), points.where("id >= 2000")
    merged = chartdata.sample_points(halves[0], F.col("id"), 40).unionAll(chartdata.sample_points(halves[1], F.col("id"), 40)).drop("place")
    assert {(r["cluster"], r["id"]) for r in chartdata.sample_points(merged, F.col("id"), 40).collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_order_of_reports(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5), (None, 6)], "v string, k int").repartition(5)
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    sizes = chartdata.cluster_sizes(df.withColumn("prediction", 9 - F.col("k")))
    assert [r["cluster"] for r in sizes.collect()] == [3, 4, 5, 6, 7, 8]
    imp = spark.createDataFrame([("f", 0.2), ("a", 0.2), ("z", 0.6)], "feature string, importance double")
    assert [(r["rank"], r["feature"]) for r in chartdata.top_features(imp, 2).collect()] == [(1, "z"), (2, "a")]
