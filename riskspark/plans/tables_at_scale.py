"""Registered queries of the operators for wide, long and untidy tables: distributed dictionaries,
CSV records in parallel, rejected rows, bracketed quantiles, heavy hitters, digests, samples, importances."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.exprs import round_half_up, sql_round_half_up
from riskspark.operators import chartdata, dictionary, features, formats, models, profile, statistics
from riskspark.operators.clean import bounds_frame, bounds_of, fit_cleaning
from riskspark.roles import Roles
from riskspark.session import shared_dir
from riskspark.sources.readers import NA_TOKENS, read_csv
from riskspark.sources.records import read_csv_keeping_rejects
from riskspark.sources.tables import ACCIDENT_ROLES, ACCIDENT_SQL, accident_frame, table

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---- E1, E2: dictionaries ---------------------------------------------------------

def _coded_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """A text column of many values (a part and its supplier), one of few, and the key."""
    li = table(spark, sf, "lineitem", [*KEY, "l_returnflag"])
    return li.withColumn("part", F.concat_ws("/", "l_partkey", "l_suppkey"))


def q_dictionary_table(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.fit_dictionary(_coded_lineitem(spark, sf), ["part", "l_returnflag"])


_SQL_DICTIONARY = """
li AS (SELECT *, l_partkey || '/' || l_suppkey AS part FROM lineitem),
dict AS (SELECT 'part' AS column_name, part AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, part) - 1 AS idx
         FROM li GROUP BY part
         UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1
         FROM li GROUP BY l_returnflag)"""

SQL_DICTIONARY_TABLE = f"WITH {_SQL_DICTIONARY} SELECT * FROM dict"


def q_dictionary_encoded(spark: SparkSession, sf: str) -> DataFrame:
    li = _coded_lineitem(spark, sf)
    entries = dictionary.fit_dictionary(li, ["part", "l_returnflag"])
    coded = dictionary.encode(li, entries, {"part": "part_indexed", "l_returnflag": "flag_indexed"})
    return coded.select(*KEY, "part_indexed", "flag_indexed")


SQL_DICTIONARY_ENCODED = f"""WITH {_SQL_DICTIONARY}
SELECT {', '.join(KEY)}, CAST(p.idx AS DOUBLE) AS part_indexed, CAST(f.idx AS DOUBLE) AS flag_indexed
FROM li JOIN dict p ON p.column_name = 'part' AND p.value = li.part
        JOIN dict f ON f.column_name = 'l_returnflag' AND f.value = li.l_returnflag"""


# ---- S1, S2: CSV -------------------------------------------------------------------

def _noted(spark: SparkSession, sf: str) -> DataFrame:
    """The accident table with a note that holds quotes, commas and, in every third row, line ends."""
    acc = accident_frame(spark, sf)
    note = F.concat(F.lit('said "'), F.coalesce("sev", F.lit("nothing")), F.lit('", at '), F.col("time"),
                    F.when(F.col("id") % 3 == 0, F.concat(F.lit("\n\nthen left\non "), F.col("day"))).otherwise(""))
    return acc.select("id", "day", note.alias("note"), F.floor(F.col("v") * 100).cast("bigint").alias("cents"))


def q_csv_multi_line(spark: SparkSession, sf: str) -> DataFrame:
    """The table, written as CSV to the shared folder and read back in parallel."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    _noted(spark, sf).write.option("header", True).option("escape", '"').csv(folder)
    return read_csv(spark, folder, schema="id long, day string, note string, cents long", multi_line=True)


_SQL_NOTED = f"""{ACCIDENT_SQL},
noted AS (SELECT id, day, 'said "' || coalesce(sev, 'nothing') || '", at ' || time
                 || CASE WHEN id % 3 = 0 THEN chr(10) || chr(10) || 'then left' || chr(10) || 'on ' || day ELSE '' END AS note,
                 CAST(floor(v * 100) AS BIGINT) AS cents FROM accident)"""

SQL_CSV_MULTI_LINE = f"WITH {_SQL_NOTED} SELECT id, day, note, cents FROM noted"


def q_csv_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Rows kept and rejected from one parse of CSV text in which every 101st row has a word for a number, every 103rd a
    field too many, every 107th one too few."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    i = F.col("id")
    number = F.when(i % 101 == 0, F.lit("many")).otherwise(F.coalesce(F.col("cents").cast("string"), F.lit("NA")))
    quoted = F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", i.cast("string"), quoted, number, F.when(i % 103 == 0, F.lit("more")))
    line = F.when((i % 107 == 0) & (i % 103 != 0), F.concat_ws(",", i.cast("string"), quoted)).otherwise(line)
    _noted(spark, sf).select(line.alias("value")).write.text(folder)
    read = read_csv_keeping_rejects(spark, folder, "id long, note string, cents long", NA_TOKENS, header=False)
    kept = read.rows.select(F.lit("kept").alias("kind"), F.lit(None).cast("string").alias("reason"), F.col("id").cast("string").alias("item"),
                            "note", "cents")
    out = read.rejected.select(F.lit("rejected").alias("kind"), "reason", F.col("record").alias("item"),
                               F.lit(None).cast("string").alias("note"), F.lit(None).cast("bigint").alias("cents"))
    return kept.unionByName(out)


SQL_CSV_REJECTED = f"""WITH {_SQL_NOTED},
f AS (SELECT *, '"' || replace(note, '"', '""') || '"' AS quoted,
             CASE WHEN id % 101 = 0 THEN 'many' ELSE coalesce(CAST(cents AS VARCHAR), 'NA') END AS number FROM noted),
r AS (SELECT *, CASE WHEN id % 107 = 0 AND id % 103 <> 0 THEN id || ',' || quoted
                     ELSE id || ',' || quoted || ',' || number || CASE WHEN id % 103 = 0 THEN ',more' ELSE '' END END AS line,
             CASE WHEN id % 103 = 0 OR id % 107 = 0 THEN 'not 3 fields'
                  WHEN id % 101 = 0 THEN 'column cents can''t hold many' END AS reason FROM f)
SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS kind, reason,
       CASE WHEN reason IS NULL THEN CAST(id AS VARCHAR) ELSE line END AS item,
       CASE WHEN reason IS NULL THEN note END AS note, CASE WHEN reason IS NULL THEN cents END AS cents FROM r"""


# ---- S1, L8: types and formats -------------------------------------------------------

_STAMPED = ["event_id", "ts", "event_type", "value"]


def q_column_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Types and formats of text columns: dates written in four ways (in one of them month and day are both at most 12),
    two ways mixed, timestamps, truth values, numbers, and whole numbers but for a word in every 1009th row."""
    i, ts = F.col("event_id"), F.col("ts")
    us = F.date_format(ts, "M/d/yyyy")
    events = table(spark, sf, "events", _STAMPED).select(
        F.date_format(ts, "yyyy-MM-dd").alias("iso"), us.alias("us"), F.date_format(ts, "d.M.yyyy").alias("dotted"),
        F.when(F.dayofmonth(ts) <= 12, us).alias("either"), F.when(i % 3 == 0, us).otherwise(F.date_format(ts, "yyyy/MM/dd")).alias("two_ways"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.date_format(ts, "H:mm:ss").alias("clock"),
        F.when(i % 2 == 0, "True").when(i % 3 == 0, "False").alias("truth"), i.cast("string").alias("id"),
        F.when(i % 17 != 0, F.col("value").cast("decimal(18,4)").cast("string")).alias("value"),
        F.when(i % 1009 == 0, "many").otherwise(i.cast("string")).alias("spoilt"), F.lit(None).cast("string").alias("nothing"),
        F.col("event_type"))
    return formats.formats_frame(spark, formats.column_formats(events))


def _sql_column_formats() -> str:
    """Each candidate's count by DuckDB's own parser, and the same choice among them."""
    codes = {"yyyy": "%Y", "MMM": "%b", "M": "%m", "d": "%d", "H": "%H", "m": "%M", "s": "%S", "'": ""}

    def strptime(fmt: str) -> str:
        return re.sub("yyyy|MMM|[MdHms']", lambda m: codes[m.group()], fmt)

    truth = ", ".join(f"'{t}'" for t in formats.TRUTH)
    reads = [("boolean", "boolean", f"x IN ({truth})"),
             ("bigint", "bigint", "regexp_full_match(x, '[+-]?[0-9]+') AND TRY_CAST(x AS BIGINT) IS NOT NULL"),
             ("double", "double", "regexp_full_match(x, '[+-]?[0-9]*[.]?[0-9]+') AND TRY_CAST(x AS DOUBLE) IS NOT NULL")]
    for kind, fs in zip(formats.KINDS[3:], (formats.DATES, formats.STAMPS, formats.TIMES)):
        reads += [(kind, f, f"try_strptime(x, '{strptime(f)}') IS NOT NULL") for f in fs]
    quoted = [(k, f.replace("'", "''"), test) for k, f, test in reads]
    counted = "\nUNION ALL ".join(
        f"SELECT column_name, {p} AS place, '{k}' AS kind, '{f}' AS name, count(x) AS n, count(*) FILTER ({test}) AS c FROM l GROUP BY column_name"
        for p, (k, f, test) in enumerate(quoted))
    us = "month(ts) || '/' || day(ts) || '/' || year(ts)"
    columns = {"iso": "strftime(ts, '%Y-%m-%d')", "us": us, "dotted": "day(ts) || '.' || month(ts) || '.' || year(ts)",
               "either": f"CASE WHEN day(ts) <= 12 THEN {us} END", "two_ways": f"CASE WHEN event_id % 3 = 0 THEN {us} ELSE strftime(ts, '%Y/%m/%d') END",
               "stamp": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "clock": "hour(ts) || strftime(ts, ':%M:%S')",
               "truth": "CASE WHEN event_id % 2 = 0 THEN 'True' WHEN event_id % 3 = 0 THEN 'False' END", "id": "CAST(event_id AS VARCHAR)",
               "value": "CASE WHEN event_id % 17 <> 0 THEN CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) END",
               "spoilt": "CASE WHEN event_id % 1009 = 0 THEN 'many' ELSE CAST(event_id AS VARCHAR) END", "nothing": "CAST(NULL AS VARCHAR)",
               "event_type": "event_type"}
    rows = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, {x} AS x FROM events" for c, x in columns.items())
    return f"""WITH l AS ({rows}),
c AS ({counted}),
k AS (SELECT column_name, max(n) AS n, arg_min(kind, place) FILTER (c = n) AS whole, arg_min(name, place) FILTER (c = n) AS name,
             max(c) AS most FROM c GROUP BY column_name),
t AS (SELECT c.column_name, string_agg(c.name, ' | ' ORDER BY place) AS ties FROM c JOIN k USING (column_name)
      WHERE c.c = c.n AND c.n > 0 AND c.kind = k.whole AND c.name <> k.name GROUP BY c.column_name),
m AS (SELECT column_name, arg_min(c.name, place) AS nearest FROM c JOIN k USING (column_name) WHERE c.c = k.most AND most > 0 GROUP BY column_name)
SELECT column_name, n AS n_values, CASE WHEN n = 0 THEN 'double' ELSE coalesce(whole, 'string') END AS kind,
       CASE WHEN n > 0 AND whole NOT IN ('boolean', 'bigint', 'double') THEN k.name END AS format, ties, nearest, most AS n_nearest
FROM k LEFT JOIN t USING (column_name) LEFT JOIN m USING (column_name)"""


SQL_COLUMN_FORMATS = _sql_column_formats()


def q_csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Types found in a CSV file, its dates and timestamps included, and what its rows hold by type."""
    ts = F.col("ts")
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "events", _STAMPED).select(
        F.col("event_id").alias("id"), F.date_format(ts, "d.M.yyyy").alias("day"), F.date_format(ts, "M/d/yyyy H:mm:ss").alias("at"),
        F.when(F.col("event_id") % 7 != 0, F.initcap((F.col("event_id") % 2 == 0).cast("string"))).alias("even"),
        F.col("event_type").alias("kind")).write.option("header", True).csv(folder)
    read = read_csv(spark, folder, roles=Roles(id="id", label="kind", date=None, time=None), infer=True, infer_dates=True)
    return read.select("id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "even", "kind",
                       F.lit(" ".join(t for _, t in read.dtypes)).alias("types"))


SQL_CSV_INFERRED = """
SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at,
       CASE WHEN event_id % 7 <> 0 THEN event_id % 2 = 0 END AS even, event_type AS kind,
       'bigint date timestamp_ntz boolean string' AS types FROM events"""


def q_mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning of a date column written in three ways, none of them stated."""
    day = F.to_date("day")
    acc = accident_frame(spark, sf).select(
        "id", "sev", F.when(F.col("id") % 3 == 0, F.date_format(day, "M/d/yyyy")).when(F.col("id") % 3 == 1, F.date_format(day, "d.M.yyyy"))
        .otherwise(F.col("day")).alias("day"), "time")
    model = fit_cleaning(acc, ACCIDENT_ROLES, parts=(), date_format="mixed")
    return model.transform(acc).select("id", F.date_format("day", "yyyy-MM-dd").alias("day"), "month", "hour")


SQL_MIXED_DATES = f"""WITH {ACCIDENT_SQL}
SELECT id, day, CAST(substr(day, 6, 2) AS INTEGER) AS month, CAST(substr(time, 1, 2) AS INTEGER) AS hour FROM accident"""


# ---- L3 to L5, P2: selection, heavy hitters, digests -------------------------------

def q_iqr_bounds_bracketed(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", NUMERIC)
    quartiles = statistics.quantiles(li, NUMERIC, [0.25, 0.75], method="bracketed")
    return bounds_frame(spark, {c: bounds_of(*quartiles[c]) for c in NUMERIC})


SQL_IQR_BOUNDS_BRACKETED = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, q1, q3, q3 - q1 AS iqr, q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi, q3 - q1 = 0 AS collapsed
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)""" for c in NUMERIC)


def q_frequent_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Modes of a column of few values, of one with a hot value among many, and of a near-unique one."""
    li = _coded_lineitem(spark, sf)
    cols = {"l_returnflag": F.col("l_returnflag"), "hot": F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.concat_ws("/", *KEY)),
            "part": F.col("part")}
    found = statistics.frequent_modes(li.select(*[x.alias(c) for c, x in cols.items()]), list(cols))
    return spark.createDataFrame([(c, v, n) for c, (v, n) in found.items()], "column_name string, value string, n bigint")


SQL_FREQUENT_MODES = """
WITH c AS (SELECT l_returnflag, l_partkey || '/' || l_suppkey AS part,
                  CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber) END AS hot
           FROM lineitem),
n AS (SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS n FROM c GROUP BY l_returnflag
      UNION ALL SELECT 'hot', hot, count(*) FROM c GROUP BY hot
      UNION ALL SELECT 'part', part, count(*) FROM c GROUP BY part)
SELECT column_name, value, n FROM n QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) = 1"""


def q_duplicate_rows_by_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``duplicate_rows``: a third of an accident table's rows are repeated."""
    acc = accident_frame(spark, sf).drop("id")
    return profile.duplicate_rows_by_digest(acc.unionAll(accident_frame(spark, sf).where("id % 3 = 0").drop("id")))


SQL_DUPLICATE_ROWS_BY_DIGEST = f"""
WITH {ACCIDENT_SQL},
t AS (SELECT * EXCLUDE (id) FROM accident UNION ALL SELECT * EXCLUDE (id) FROM accident WHERE id % 3 = 0),
g AS (SELECT sev, day, time, user_id, v, count(*) AS n FROM t GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g"""


# ---- C3, M5, C1: points and importances --------------------------------------------

POINTS = 200


def q_scatter_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points of a scatter chart by return flag: a fixed number of each, whatever the partitions."""
    li = table(spark, sf, "lineitem", [*KEY, "l_returnflag", "l_quantity", "l_extendedprice"])
    points = li.select(F.col("l_returnflag").alias("cluster"), F.concat_ws("|", *KEY).alias("id"),
                       F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return chartdata.sample_points(points, F.col("id"), POINTS)


SQL_SCATTER_POINTS = f"""
SELECT l_returnflag AS cluster, concat_ws('|', {', '.join(KEY)}) AS id, l_quantity AS x, l_extendedprice AS y,
       CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws('|', {', '.join(KEY)})),
                               concat_ws('|', {', '.join(KEY)}), l_quantity, l_extendedprice) AS INTEGER) AS place
FROM lineitem QUALIFY place <= {POINTS}"""

IMPORTANCE_DIGITS = 6


def q_feature_importance_table(spark: SparkSession, sf: str) -> DataFrame:
    """The whole importance table of a tree whose gains are known: the class is a up to quantity 25, else b
    up to line 3, else c."""
    names = ["l_discount", "l_linenumber", "l_quantity", "l_tax"]
    li = table(spark, sf, "lineitem", names)
    label = F.when(F.col("l_quantity") <= 25, 0.0).when(F.col("l_linenumber") <= 3, 1.0).otherwise(2.0)
    data = features.assemble(li, names).select("features", label.alias("label"))
    params = models.ForestParams(num_trees=1, max_depth=2, bootstrap=False, feature_subset="all", max_bins=64)
    model = models.fit_forest(data, "label", params=params)
    top = chartdata.top_features(models.importance_frame(spark, model, names), 10)
    return top.select("rank", "feature", round_half_up(F.col("importance"), IMPORTANCE_DIGITS).alias("importance"))


SQL_FEATURE_IMPORTANCE_TABLE = f"""
WITH n AS (SELECT CAST(count(*) FILTER (WHERE l_quantity <= 25) AS DOUBLE) AS a,
                  CAST(count(*) FILTER (WHERE l_quantity > 25 AND l_linenumber <= 3) AS DOUBLE) AS b,
                  CAST(count(*) FILTER (WHERE l_quantity > 25 AND l_linenumber > 3) AS DOUBLE) AS c FROM lineitem),
g AS (SELECT (a + b + c) - (a * a + b * b + c * c) / (a + b + c) AS root, (b + c) - (b * b + c * c) / (b + c) AS below FROM n),
i AS (SELECT 'l_quantity' AS feature, (root - below) / root AS importance FROM g
      UNION ALL SELECT 'l_linenumber', below / root FROM g
      UNION ALL SELECT unnest(['l_discount', 'l_tax']), CAST(0 AS DOUBLE))
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature,
       {sql_round_half_up("importance", IMPORTANCE_DIGITS)} AS importance FROM i"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dictionary_table": q_dictionary_table,
    "dictionary_encoded": q_dictionary_encoded,
    "csv_multi_line": q_csv_multi_line,
    "csv_rejected": q_csv_rejected,
    "column_formats": q_column_formats,
    "csv_inferred": q_csv_inferred,
    "mixed_dates": q_mixed_dates,
    "iqr_bounds_bracketed": q_iqr_bounds_bracketed,
    "frequent_modes": q_frequent_modes,
    "duplicate_rows_by_digest": q_duplicate_rows_by_digest,
    "scatter_points": q_scatter_points,
    "feature_importance_table": q_feature_importance_table,
}

ORACLE_SQL: dict[str, str] = {
    "dictionary_table": SQL_DICTIONARY_TABLE,
    "dictionary_encoded": SQL_DICTIONARY_ENCODED,
    "csv_multi_line": SQL_CSV_MULTI_LINE,
    "csv_rejected": SQL_CSV_REJECTED,
    "column_formats": SQL_COLUMN_FORMATS,
    "csv_inferred": SQL_CSV_INFERRED,
    "mixed_dates": SQL_MIXED_DATES,
    "iqr_bounds_bracketed": SQL_IQR_BOUNDS_BRACKETED,
    "frequent_modes": SQL_FREQUENT_MODES,
    "duplicate_rows_by_digest": SQL_DUPLICATE_ROWS_BY_DIGEST,
    "scatter_points": SQL_SCATTER_POINTS,
    "feature_importance_table": SQL_FEATURE_IMPORTANCE_TABLE,
}
