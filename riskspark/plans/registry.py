"""Registered queries over the driver's test tables, and their SQL oracles.

Every query reads whole tables (or tables Spark derives from them); its
work grows with the data.  Queries that fit a model run the fit eagerly
(MLlib fits are actions) and return a small report table; the others return
lazy DataFrames.  ``ORACLE_SQL`` holds, for each query with a SQL
equivalent, the same computation as DuckDB SQL over the same parquet views.
Model queries run on tables with a planted signal, so their numbers are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.exprs import HASH_DIGITS, HASH_SPACE, composite_key, round_half_up, sql_round_half_up
from riskspark.functions.vectors import vector_columns
from riskspark.operators import chartdata, cluster, evaluate, features, models, profile
from riskspark.operators.clean import bounds_frame, constant_report, fit_cleaning, iqr_bounds
from riskspark.operators.split import enough_partitions, hash_split, spread, union_parts, with_split
from riskspark.plans import analyses, tables_at_scale
from riskspark.roles import Roles
from riskspark.sources.tables import (ACCIDENT_ROLES, ACCIDENT_SQL, PLANTED_ACCIDENT_SQL, SEVERE_ACCIDENT_SQL,
                                      accident_frame, planted_accident_frame, severe_accident_frame, table)

Query = Callable[[SparkSession, str], DataFrame]

# ---- fixed parameters of the registered queries -----------------------------
TRAIN_FRACTION = 0.8
LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINEITEM_IDS = ("l_orderkey", "l_partkey", "l_suppkey")
LINEITEM_NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STUMP_QUANTITY = 25          # planted label: l_quantity > 25
ROUND_STAT = 9               # digits for statistics compared with SQL
ROUND_SCALED = 6             # digits for scaled feature values
ROUND_PROJ = 4               # digits for PCA coordinates


def _train_sql(key_sql: str, fraction: float = TRAIN_FRACTION) -> str:
    """SQL form of the hash split test (see ``functions.exprs.in_train``)."""
    return (f"(CAST('0x' || substr(md5(CAST({key_sql} AS VARCHAR)), 1, {HASH_DIGITS}) AS BIGINT)"
            f" < {fraction * HASH_SPACE!r})")


def _split_sql(key_sql: str) -> str:
    return f"CASE WHEN {_train_sql(key_sql)} THEN 'train' ELSE 'test' END"


LINEITEM_KEY_SQL = "concat_ws('|', " + ", ".join(LINEITEM_KEY) + ")"
R = sql_round_half_up


# ---- accident-style table: profiling and cleaning ----------------------------

def q_column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.column_profile(accident_frame(spark, sf), with_total=True)


_ACC_COLS = [("id", "bigint", False), ("sev", "string", False), ("day", "string", False),
             ("time", "string", False), ("user_id", "bigint", False), ("v", "double", True)]


def _sql_column_profile() -> str:
    miss = ", ".join(
        f"count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if fl else ''}) AS m{i}"
        for i, (c, _, fl) in enumerate(_ACC_COLS))
    parts = [f"SELECT CAST({i} AS INTEGER) AS pos, '{c}' AS column_name, '{t}' AS dtype, "
             f"rows - m{i} AS non_null, m{i} AS missing FROM a" for i, (c, t, _) in enumerate(_ACC_COLS)]
    total = " + ".join(f"m{i}" for i in range(len(_ACC_COLS)))
    parts.append(f"SELECT CAST(-1 AS INTEGER), '*', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), {total} FROM a")
    return (f"WITH {ACCIDENT_SQL}, a AS (SELECT count(*) AS rows, {miss} FROM accident)\n"
            + "\nUNION ALL\n".join(parts))


def q_duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole rows of an accident table without its id, in which a third of the rows are repeated."""
    acc = accident_frame(spark, sf).drop("id")
    return profile.duplicate_rows(acc.unionAll(accident_frame(spark, sf).where("id % 3 = 0").drop("id")))


SQL_DUPLICATE_ROWS = f"""
WITH {ACCIDENT_SQL},
t AS (SELECT * EXCLUDE (id) FROM accident UNION ALL SELECT * EXCLUDE (id) FROM accident WHERE id % 3 = 0),
g AS (SELECT sev, day, time, user_id, v, count(*) AS n FROM t GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g"""


def q_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """L14 on the raw accident-style table's text columns (sev has NULLs)."""
    acc = accident_frame(spark, sf)
    cols = [f.name for f in acc.schema.fields if f.dataType.simpleString() == "string"]
    return profile.distinct_counts(acc, cols)


SQL_DISTINCT_COUNTS = f"""
WITH {ACCIDENT_SQL}
SELECT 'sev' AS column_name, count(DISTINCT sev) AS n_distinct FROM accident
UNION ALL SELECT 'day', count(DISTINCT day) FROM accident
UNION ALL SELECT 'time', count(DISTINCT time) FROM accident"""


def q_label_counts_raw(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(accident_frame(spark, sf), "sev")


SQL_LABEL_COUNTS_RAW = f"""
WITH {ACCIDENT_SQL}
SELECT sev AS label, count(*) AS n FROM accident WHERE sev IS NOT NULL GROUP BY sev"""

# Mode of sev (ties: smallest), median of v, then the filled table.
_SQL_FILLED = f"""{ACCIDENT_SQL},
sevc AS (SELECT sev, count(*) AS n FROM accident WHERE sev IS NOT NULL GROUP BY sev),
sev_mode AS (SELECT min(sev) AS m FROM sevc WHERE n = (SELECT max(n) FROM sevc)),
v_med AS (SELECT quantile_cont(CASE WHEN NOT isnan(v) THEN v END, 0.5) AS m FROM accident),
filled AS (
  SELECT id, coalesce(sev, (SELECT m FROM sev_mode)) AS sev, day, time, user_id,
         coalesce(v, (SELECT m FROM v_med)) AS v
  FROM accident),
q AS (SELECT quantile_cont(CAST(user_id AS DOUBLE), 0.25) AS u1, quantile_cont(CAST(user_id AS DOUBLE), 0.75) AS u3,
             quantile_cont(v, 0.25) AS v1, quantile_cont(v, 0.75) AS v3 FROM filled),
b AS (SELECT u1, u3, u3 - u1 AS uiqr, u1 - 3.0 * (u3 - u1) AS ulo, u3 + 3.0 * (u3 - u1) AS uhi,
             v1, v3, v3 - v1 AS viqr, v1 - 3.0 * (v3 - v1) AS vlo, v3 + 3.0 * (v3 - v1) AS vhi FROM q)"""


def _clean_accident(spark: SparkSession, sf: str, parts: tuple[str, ...] = ("fill", "clip")):
    acc = accident_frame(spark, sf)
    model = fit_cleaning(acc, ACCIDENT_ROLES, parts=parts)
    return model, model.transform(acc)


def q_severity_share(spark: SparkSession, sf: str) -> DataFrame:
    """The label alone is filled: the share needs no other column."""
    labels = accident_frame(spark, sf).select("sev")
    cleaned = fit_cleaning(labels, Roles(id=None, label="sev", date=None, time=None), parts=("fill",)).transform(labels)
    return chartdata.severity_share(cleaned, "sev")


SQL_SEVERITY_SHARE = f"""
WITH {_SQL_FILLED},
counts AS (SELECT sev AS label, count(*) AS n FROM filled GROUP BY sev)
SELECT label, n, {R("CAST(100.0 AS DOUBLE) * n / sum(n) OVER ()", 1)} AS pct FROM counts"""


def q_impute_clip_timeparts(spark: SparkSession, sf: str) -> DataFrame:
    _, cleaned = _clean_accident(spark, sf)
    return cleaned.select("id", "sev", "day", "user_id", "v", "month", "hour", "is_peak_hour")


SQL_IMPUTE_CLIP_TIMEPARTS = f"""
WITH {_SQL_FILLED}
SELECT id, sev, CAST(day AS DATE) AS day,
       CASE WHEN CAST(user_id AS DOUBLE) < ulo THEN ulo WHEN CAST(user_id AS DOUBLE) > uhi THEN uhi
            ELSE CAST(user_id AS DOUBLE) END AS user_id,
       CASE WHEN v < vlo THEN vlo WHEN v > vhi THEN vhi ELSE v END AS v,
       CAST(month(CAST(day AS DATE)) AS INTEGER) AS month,
       CAST(hour(strptime(time, '%H:%M:%S')) AS INTEGER) AS hour,
       CAST(CASE WHEN hour(strptime(time, '%H:%M:%S')) BETWEEN 7 AND 9
                   OR hour(strptime(time, '%H:%M:%S')) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS INTEGER)
         AS is_peak_hour
FROM filled, b"""


def q_fill_statistics(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _clean_accident(spark, sf, parts=("fill",))
    return model.fills_frame(spark)


SQL_FILL_STATISTICS = f"""
WITH {_SQL_FILLED}
SELECT 'sev' AS column_name, 'mode' AS method, CAST(NULL AS DOUBLE) AS num_value,
       (SELECT m FROM sev_mode) AS text_value,
       (SELECT count(*) FROM accident WHERE sev IS NULL) AS missing
UNION ALL
SELECT 'v', 'median', (SELECT m FROM v_med), CAST(NULL AS VARCHAR),
       (SELECT count(*) FROM accident WHERE v IS NULL OR isnan(v))"""


def q_accident_bounds(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _clean_accident(spark, sf)
    return model.bounds_frame(spark)


SQL_ACCIDENT_BOUNDS = f"""
WITH {_SQL_FILLED}
SELECT 'user_id' AS column_name, u1 AS q1, u3 AS q3, uiqr AS iqr, ulo AS lo, uhi AS hi, uiqr = 0 AS collapsed FROM b
UNION ALL
SELECT 'v', v1, v3, viqr, vlo, vhi, viqr = 0 FROM b"""


def q_one_digit_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times such as 8:05:00 and dates such as 01/15/2024, as users write them."""
    hour = F.regexp_replace("time", "^0", "")
    acc = accident_frame(spark, sf).select("id", "sev", F.date_format(F.to_date("day"), "MM/dd/yyyy").alias("day"),
                                           hour.alias("time"))
    model = fit_cleaning(acc, ACCIDENT_ROLES, parts=("fill",), date_format="MM/dd/yyyy")
    return model.transform(acc).select("id", "day", "month", "hour", "is_peak_hour")


SQL_ONE_DIGIT_TIMES = f"""
WITH {ACCIDENT_SQL}
SELECT id, CAST(day AS DATE) AS day, CAST(month(CAST(day AS DATE)) AS INTEGER) AS month,
       CAST(split_part(time, ':', 1) AS INTEGER) AS hour,
       CAST(CAST(split_part(time, ':', 1) AS INTEGER) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_peak_hour
FROM accident"""


def q_cleaned_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and non-missing values of every column left after cleaning; a constant text column is gone."""
    acc = accident_frame(spark, sf).withColumn("site", F.lit("north"))
    cleaned = fit_cleaning(acc, ACCIDENT_ROLES).transform(acc)
    counts = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("non_null")) for c in cleaned.columns]
    return cleaned.agg(F.array(*counts).alias("c")).select(F.inline("c"))


SQL_CLEANED_COLUMNS = f"""
WITH {ACCIDENT_SQL}
SELECT unnest(['id', 'sev', 'day', 'time', 'user_id', 'v', 'month', 'hour', 'is_peak_hour']) AS column_name,
       count(*) AS non_null FROM accident"""


def q_feature_lists(spark: SparkSession, sf: str) -> DataFrame:
    """E3 under the default and under the reference's type filter, with each feature's place."""
    rows = []
    for option, kinds in (("default", None), ("reference", ["int", "double"])):
        prep = analyses.prepare(planted_accident_frame(spark, sf), ACCIDENT_ROLES, feature_types=kinds, persist=False)
        rows += [(option, i, c) for i, c in enumerate(prep.feature_names)]
    return spark.createDataFrame(rows, "option string, pos int, feature string")


# user_id stays a whole number in the reference unless it is clipped to a bound that is none.
SQL_FEATURE_LISTS = f"""
WITH {_SQL_FILLED},
clipped AS (SELECT (min(user_id) < any_value(ulo) AND any_value(ulo) <> floor(any_value(ulo)))
                OR (max(user_id) > any_value(uhi) AND any_value(uhi) <> floor(any_value(uhi))) AS yes FROM filled, b),
f AS (SELECT unnest(['user_id', 'v', 'month', 'hour', 'is_peak_hour']) AS feature, unnest(range(5)) AS place)
SELECT 'default' AS option, CAST(place AS INTEGER) AS pos, feature FROM f
UNION ALL
SELECT 'reference', CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER), feature FROM f, clipped
WHERE feature <> 'is_peak_hour' AND (feature <> 'user_id' OR clipped.yes)"""


# ---- lineitem statistics ------------------------------------------------------

_LI_ALL_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                   "l_extendedprice", "l_discount", "l_tax"]


def q_iqr_bounds(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    cols = [f.name for f in li.schema.fields if f.name in _LI_ALL_NUMERIC]
    return bounds_frame(spark, iqr_bounds(li, cols))


def _sql_iqr_bounds() -> str:
    parts = []
    for c in _LI_ALL_NUMERIC:
        parts.append(
            f"SELECT '{c}' AS column_name, q1, q3, q3 - q1 AS iqr, q1 - 3.0 * (q3 - q1) AS lo, "
            f"q3 + 3.0 * (q3 - q1) AS hi, (q3 - q1) = 0 AS collapsed FROM "
            f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)")
    return "\nUNION ALL\n".join(parts)


def q_constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("src", F.lit("lineitem"))
    cols = [f.name for f in li.schema.fields if f.dataType.simpleString() == "string"]
    return constant_report(li, cols)


def _sql_constant_columns() -> str:
    parts = [f"SELECT '{c}' AS column_name, count({c}) AS non_null, min({c}) AS min_value, "
             f"max({c}) AS max_value, coalesce(min({c}) = max({c}), true) AS is_constant FROM li"
             for c in ("l_returnflag", "l_linestatus", "src")]
    return ("WITH li AS (SELECT *, 'lineitem' AS src FROM lineitem)\n" + "\nUNION ALL\n".join(parts))


# ---- splitting ------------------------------------------------------------------

def q_hash_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    ev = with_split(table(spark, sf, "events", ["event_id"]), "event_id", TRAIN_FRACTION)
    return profile.group_counts(ev, "split")


SQL_HASH_SPLIT_COUNTS = f"""
SELECT {_split_sql('event_id')} AS split, count(*) AS n FROM events GROUP BY 1"""


def q_union_split_parts(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events", ["event_id", "value"])
    train, test = hash_split(ev, "event_id", TRAIN_FRACTION)
    both = spread(union_parts(train.withColumn("split", F.lit("train")),
                              test.withColumn("split", F.lit("test"))))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"),
                                     F.min("event_id").alias("id_min"), F.max("event_id").alias("id_max"))


SQL_UNION_SPLIT_PARTS = f"""
SELECT {_split_sql('event_id')} AS split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum,
       min(event_id) AS id_min, max(event_id) AS id_max
FROM events GROUP BY 1"""


# ---- encoding, assembling, scaling --------------------------------------------

def q_string_index_map(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events", ["event_id", "event_type"])
    train, _ = hash_split(ev, "event_id", TRAIN_FRACTION)
    model = features.fit_indexers(train, ["event_type"])
    return features.index_map_frame(spark, model, ["event_type"])


SQL_STRING_INDEX_MAP = f"""
SELECT 'event_type' AS column_name, event_type AS value,
       CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS DOUBLE) AS idx
FROM events WHERE {_train_sql('event_id')} GROUP BY event_type"""


def _lineitem_split(spark: SparkSession, sf: str) -> DataFrame:
    return with_split(table(spark, sf, "lineitem"), LINEITEM_KEY, TRAIN_FRACTION)


def q_assembled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    li = _lineitem_split(spark, sf)
    enc = ["l_returnflag", "l_linestatus"]
    indexers = features.fit_indexers(li.where(F.col("split") == "train"), enc)
    coded = indexers.transform(li)
    names = features.feature_columns(coded, [features.indexed_name(c) for c in enc],
                                     exclude=set(LINEITEM_IDS))
    vec = features.assemble(coded, names)
    return vector_columns(vec, "features", [f"f{i}" for i in range(len(names))], LINEITEM_KEY + ["split"])


SQL_ASSEMBLED_VECTORS = f"""
WITH s AS (SELECT *, {_split_sql(LINEITEM_KEY_SQL)} AS split FROM lineitem),
rf AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS DOUBLE) AS idx
       FROM s WHERE split = 'train' GROUP BY l_returnflag),
ls AS (SELECT l_linestatus, CAST(row_number() OVER (ORDER BY count(*) DESC, l_linestatus) - 1 AS DOUBLE) AS idx
       FROM s WHERE split = 'train' GROUP BY l_linestatus)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, split,
       rf.idx AS f0, ls.idx AS f1, CAST(l_linenumber AS DOUBLE) AS f2, l_quantity AS f3,
       l_extendedprice AS f4, l_discount AS f5, l_tax AS f6
FROM s JOIN rf USING (l_returnflag) JOIN ls USING (l_linestatus)"""


def q_binary_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    ev = with_split(table(spark, sf, "events", ["event_id", "event_type"]), "event_id", TRAIN_FRACTION)
    idx = features.fit_label_indexer(ev.where(F.col("split") == "train"), "event_type", "label_idx")
    labelled = idx.transform(ev).withColumn("is_severe", features.binary_label("label_idx"))
    return labelled.groupBy("split", "is_severe").agg(F.count(F.lit(1)).alias("n"))


SQL_BINARY_LABEL_COUNTS = f"""
WITH s AS (SELECT event_type, {_split_sql('event_id')} AS split FROM events),
m AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS idx
      FROM s WHERE split = 'train' GROUP BY event_type)
SELECT split, CAST(CASE WHEN m.idx > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_severe, count(*) AS n
FROM s JOIN m USING (event_type) GROUP BY 1, 2"""


def q_scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    li = features.assemble(_lineitem_split(spark, sf), LINEITEM_NUMERIC)
    scaler = features.fit_scaler(li.where(F.col("split") == "train"))
    out = vector_columns(scaler.transform(li), "scaledFeatures",
                         [f"s{i}" for i in range(len(LINEITEM_NUMERIC))], LINEITEM_KEY + ["split"])
    return out.select(*LINEITEM_KEY, "split",
                      *[round_half_up(F.col(f"s{i}"), ROUND_SCALED).alias(f"s{i}")
                        for i in range(len(LINEITEM_NUMERIC))])


def _sql_scaled_features() -> str:
    sds = ", ".join(f"stddev_samp(CAST({c} AS DOUBLE)) AS sd{i}" for i, c in enumerate(LINEITEM_NUMERIC))
    cols = ", ".join(
        R(f"CAST({c} AS DOUBLE) * (CASE WHEN sd{i} = 0 THEN 0.0 ELSE 1.0 / sd{i} END)", ROUND_SCALED) + f" AS s{i}"
        for i, c in enumerate(LINEITEM_NUMERIC))
    return (f"WITH s AS (SELECT *, {_split_sql(LINEITEM_KEY_SQL)} AS split FROM lineitem),\n"
            f"sd AS (SELECT {sds} FROM s WHERE split = 'train')\n"
            f"SELECT {', '.join(LINEITEM_KEY)}, split, {cols} FROM s, sd")


# ---- evaluation -------------------------------------------------------------------

def q_accuracy_f1(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels", ["quality", "toxic"])
    m = evaluate.accuracy_f1(lab, "quality", "toxic")
    return m.select(round_half_up(F.col("accuracy"), ROUND_STAT).alias("accuracy"),
                    round_half_up(F.col("f1"), ROUND_STAT).alias("f1"))


SQL_ACCURACY_F1 = f"""
WITH conf AS (SELECT CAST(quality AS DOUBLE) AS label, CAST(toxic AS DOUBLE) AS prediction, count(*) AS n
              FROM labels GROUP BY 1, 2),
per AS (SELECT k, CAST(sum(ap) AS DOUBLE) AS ap, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(pp) AS DOUBLE) AS pp FROM (
          SELECT label AS k, n AS ap, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, 0 AS pp FROM conf
          UNION ALL SELECT prediction, 0, 0, n FROM conf) GROUP BY k)
SELECT {R("sum(tp) / sum(ap)", ROUND_STAT)} AS accuracy,
       {R("sum(CASE WHEN tp > 0 THEN 2.0 * tp / (pp + ap) ELSE 0.0 END * ap) / sum(ap)", ROUND_STAT)} AS f1
FROM per"""


def q_roc_pr_area(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice"])
    scored = li.select((F.col("l_returnflag") == "R").cast("double").alias("label"),
                       F.col("l_extendedprice").cast("double").alias("score"))
    areas = evaluate.binary_areas(scored, "label", "score", num_bins=0)
    out = spark.createDataFrame([(areas["area_roc"], areas["area_pr"])], "area_roc double, area_pr double")
    return out.select(round_half_up(F.col("area_roc"), ROUND_STAT).alias("area_roc"),
                      round_half_up(F.col("area_pr"), ROUND_STAT).alias("area_pr"))


SQL_ROC_PR_AREA = f"""
WITH g AS (SELECT CAST(l_extendedprice AS DOUBLE) AS score,
                  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS DOUBLE) AS neg
           FROM lineitem GROUP BY 1),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
      FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT sum(pos) AS p, sum(neg) AS q FROM g),
pts AS (SELECT score, tp / p AS tpr, fp / q AS fpr, tp / (tp + fp) AS prec FROM c, t),
seq AS (SELECT tpr, fpr, prec,
               lag(fpr, 1, 0.0) OVER (ORDER BY score DESC) AS pf,
               lag(tpr, 1, 0.0) OVER (ORDER BY score DESC) AS pt,
               lag(prec, 1) OVER (ORDER BY score DESC) AS pp,
               first_value(prec) OVER (ORDER BY score DESC) AS p0
        FROM pts)
SELECT {R("sum((fpr - pf) * (tpr + pt) / 2.0)", ROUND_STAT)} AS area_roc,
       {R("sum((tpr - pt) * (prec + coalesce(pp, p0)) / 2.0)", ROUND_STAT)} AS area_pr
FROM seq"""


# ---- forests ----------------------------------------------------------------------

# Planted lineitem: a class that follows l_linenumber, and points far apart by class, so that the numbers of
# forests and clusterings with the reference's parameters are known.
PLANTED_ROLES = Roles(id=None, label="cls", date=None, time=None, passthrough=(*LINEITEM_IDS, "row_key"))
PLANTED_FEATURES = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
# The reference's forest and clustering partitions; tables too large for them get more (enough_partitions).
FOREST_PARTITIONS, CLUSTER_PARTITIONS = 20, 10


def planted_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", [*LINEITEM_IDS, *PLANTED_FEATURES])
    n = F.col("l_linenumber")
    # The split key is text made before cleaning, which turns clipped numbers into doubles.
    return li.withColumn("cls", F.when(n <= 2, "a").when(n <= 4, "b").otherwise("c")) \
             .withColumn("row_key", composite_key(*LINEITEM_KEY))


_SQL_PLANTED = f"""
s AS (SELECT *, CASE WHEN l_linenumber <= 2 THEN 'a' WHEN l_linenumber <= 4 THEN 'b' ELSE 'c' END AS cls,
             {_split_sql(LINEITEM_KEY_SQL)} AS split FROM lineitem),
m AS (SELECT cls, row_number() OVER (ORDER BY count(*) DESC, cls) - 1 AS idx FROM s WHERE split = 'train' GROUP BY cls)"""


def q_forest_stump_split(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_tax"])
    names = ["l_quantity", "l_discount", "l_tax"]
    data = features.assemble(li, names).withColumn(
        "label", (F.col("l_quantity") > STUMP_QUANTITY).cast("double"))
    # The fit reads its input several times (metadata, split candidates,
    # binned points): keep the vectors between those passes.
    data = spread(data.select("features", "label"), enough_partitions(li, FOREST_PARTITIONS)).persist(StorageLevel.MEMORY_AND_DISK)
    params = models.ForestParams(num_trees=1, max_depth=1, bootstrap=False, feature_subset="all", max_bins=64)
    try:
        model = models.fit_forest(data, "label", params=params)
    finally:
        data.unpersist()
    split = models.root_split(model)
    if split is None:
        raise RuntimeError("the stump did not split")
    feat, thr = split
    return li.agg(F.lit(names[feat]).alias("feature"), F.lit(thr).alias("threshold"),
                  F.count(F.when(F.col(names[feat]) <= thr, True)).alias("n_left"),
                  F.count(F.when(F.col(names[feat]) > thr, True)).alias("n_right"))


SQL_FOREST_STUMP_SPLIT = f"""
WITH t AS (SELECT (max(l_quantity) FILTER (WHERE l_quantity <= {STUMP_QUANTITY})
                   + min(l_quantity) FILTER (WHERE l_quantity > {STUMP_QUANTITY})) / 2.0 AS thr FROM lineitem)
SELECT 'l_quantity' AS feature, thr AS threshold,
       count(*) FILTER (WHERE l_quantity <= thr) AS n_left,
       count(*) FILTER (WHERE l_quantity > thr) AS n_right
FROM lineitem, t GROUP BY thr"""


REPORT = "section string, rank int, name string, value double"


def _report_rows(spark: SparkSession, metrics: dict[str, float], top: DataFrame,
                 counts: list[tuple[str, float]] = ()) -> DataFrame:
    """Metrics, counts, and the name of the first feature (its share depends on the trees' growth)."""
    rows = [("metric", 0, k, float(v)) for k, v in metrics.items()]
    rows += [("count", 0, k, float(v)) for k, v in counts]
    rows += [("importance", int(r["rank"]), r["feature"], None) for r in top.where("rank = 1").collect()]
    return spark.createDataFrame(rows, REPORT)


def _confusion_rows(conf: DataFrame) -> list[tuple[str, float]]:
    return [(f"{r['label']:.0f}->{r['prediction']:.0f}", r["n"]) for r in conf.collect()]   # classes squared


def _multiclass(prep: analyses.Prepared) -> DataFrame:
    try:
        rep = analyses.multiclass_report(prep)
        m = rep["metrics"].first()
        conf = evaluate.confusion(rep["model"].transform(prep.test), prep.label_index)
        return _report_rows(prep.train.sparkSession, {"accuracy": round(m["accuracy"], ROUND_STAT), "f1": round(m["f1"], ROUND_STAT)},
                            rep["top_features"], _confusion_rows(conf))
    finally:
        prep.release()


def _binary(prep: analyses.Prepared) -> DataFrame:
    try:
        rep = analyses.binary_report(prep)
        m = rep["metrics"].first()
        counts = [(f"is_severe={r['is_severe']}", r["n"]) for r in rep["label_counts"].collect()]
        return _report_rows(prep.train.sparkSession,
                            {"area_roc": round(m["area_roc"], ROUND_STAT), "area_pr": round(m["area_pr"], ROUND_STAT)},
                            rep["top_features"], counts)
    finally:
        prep.release()


def _dealt(df: DataFrame, roles: Roles, **options) -> analyses.Prepared:
    return analyses.prepare(df, roles, partitions=enough_partitions(df, FOREST_PARTITIONS), **options)


def _planted_prepared(spark: SparkSession, sf: str) -> analyses.Prepared:
    return _dealt(planted_lineitem(spark, sf), PLANTED_ROLES, split_key="row_key")


def q_forest_multiclass_report(spark: SparkSession, sf: str) -> DataFrame:
    return _multiclass(_planted_prepared(spark, sf))


SQL_FOREST_MULTICLASS_REPORT = f"""
WITH {_SQL_PLANTED}
SELECT 'metric' AS section, CAST(0 AS INTEGER) AS rank, unnest(['accuracy', 'f1']) AS name, CAST(1 AS DOUBLE) AS value
UNION ALL SELECT 'count', 0, format('{{}}->{{}}', idx, idx), CAST(count(*) AS DOUBLE)
          FROM s JOIN m USING (cls) WHERE split = 'test' GROUP BY idx
UNION ALL SELECT 'importance', 1, 'l_linenumber', NULL"""


def q_forest_binary_report(spark: SparkSession, sf: str) -> DataFrame:
    return _binary(_planted_prepared(spark, sf))


SQL_FOREST_BINARY_REPORT = f"""
WITH {_SQL_PLANTED}
SELECT 'metric' AS section, CAST(0 AS INTEGER) AS rank, unnest(['area_roc', 'area_pr']) AS name, CAST(1 AS DOUBLE) AS value
UNION ALL SELECT 'count', 0, 'is_severe=' || CASE WHEN idx > 0 THEN 1 ELSE 0 END, CAST(count(*) AS DOUBLE)
          FROM s JOIN m USING (cls) WHERE split = 'train' GROUP BY 3
UNION ALL SELECT 'importance', 1, 'l_linenumber', NULL"""


# ---- clustering and projection ----------------------------------------------------

def _planted_clustering(spark: SparkSession, sf: str) -> analyses.Clustering:
    li = planted_lineitem(spark, sf)
    cls = F.col("cls")
    points = li.select(*LINEITEM_KEY, (F.col("l_tax") + F.when(cls == "b", 100.0).when(cls == "c", 200.0).otherwise(0.0)).alias("x"),
                       (F.col("l_discount") + F.when(cls == "b", 100.0).otherwise(0.0)).alias("y"))
    marked = with_split(features.assemble(points, ["x", "y"]), LINEITEM_KEY, TRAIN_FRACTION)
    return analyses.Clustering(marked, LINEITEM_KEY, partitions=enough_partitions(li, CLUSTER_PARTITIONS))


def _numbered(c: analyses.Clustering, df: DataFrame) -> DataFrame:
    """Clusters numbered by their centres' first coordinate instead of MLlib's arbitrary number."""
    order = sorted(range(c.k), key=lambda i: cluster.centers(c.kmeans)[i])
    number = F.element_at(F.create_map(*[F.lit(x) for i, j in enumerate(order) for x in (j, i)]), F.col("cluster"))
    return df.withColumn("cluster", number.cast("int"))


def _table_of(spark: SparkSession, c: analyses.Clustering, make: Callable[[analyses.Clustering], DataFrame]) -> DataFrame:
    """A bounded report table, rebuilt locally so that the cached vectors can go."""
    try:
        df = make(c)
        return spark.createDataFrame(df.collect(), df.schema)
    finally:
        c.release()


_SQL_POINTS = f"""{_SQL_PLANTED},
p AS (SELECT *, l_tax + CASE cls WHEN 'b' THEN 100.0 WHEN 'c' THEN 200.0 ELSE 0.0 END AS px,
             l_discount + CASE cls WHEN 'b' THEN 100.0 ELSE 0.0 END AS py,
             CAST(CASE cls WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END AS INTEGER) AS cluster FROM s),
sd AS (SELECT stddev_samp(px) AS sx, stddev_samp(py) AS sy FROM p WHERE split = 'train'),
z AS (SELECT p.*, px * (1.0 / sx) AS x, py * (1.0 / sy) AS y FROM p, sd),
ctr AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM z GROUP BY cluster)"""


def q_kmeans_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _table_of(spark, _planted_clustering(spark, sf), lambda c: _numbered(c, c.sizes()))


SQL_KMEANS_SIZES = f"WITH {_SQL_POINTS} SELECT cluster, count(*) AS n FROM z GROUP BY cluster"


def q_kmeans_centers(spark: SparkSession, sf: str) -> DataFrame:
    """M8: the k centres, each coordinate rounded (cluster, dim, value)."""
    return _table_of(spark, _planted_clustering(spark, sf), lambda c: _numbered(c, c.centers(ROUND_SCALED)))


SQL_KMEANS_CENTERS = f"""WITH {_SQL_POINTS}
SELECT cluster, CAST(0 AS INTEGER) AS dim, {R("cx", ROUND_SCALED)} AS value FROM ctr
UNION ALL SELECT cluster, 1, {R("cy", ROUND_SCALED)} FROM ctr"""

# PCA of two columns in closed form, over a table z with columns x and y.
_SQL_PCA_PARTS = """
cv AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM z),
e AS (SELECT a, b, c, (a + c) / 2.0 + sqrt(((a - c) / 2.0) * ((a - c) / 2.0) + b * b) AS l1,
                      (a + c) / 2.0 - sqrt(((a - c) / 2.0) * ((a - c) / 2.0) + b * b) AS l2 FROM cv),
v AS (SELECT l1, l2, a, c,
             b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u2,
             b / sqrt(b * b + (l2 - a) * (l2 - a)) AS w1, (l2 - a) / sqrt(b * b + (l2 - a) * (l2 - a)) AS w2
      FROM e),
sg AS (SELECT *,
         CASE WHEN abs(round(u2, 9)) > abs(round(u1, 9)) THEN sign(u2) ELSE sign(u1) END AS su,
         CASE WHEN abs(round(w2, 9)) > abs(round(w1, 9)) THEN sign(w2) ELSE sign(w1) END AS sw
       FROM v)"""


def q_kmeans_centers_projected(spark: SparkSession, sf: str) -> DataFrame:
    def make(c: analyses.Clustering) -> DataFrame:
        return _numbered(c, c.centers_xy()).select("cluster", *[round_half_up(F.col(x), ROUND_PROJ).alias(x)
                                                               for x in ("pca_x", "pca_y")])
    return _table_of(spark, _planted_clustering(spark, sf), make)


SQL_KMEANS_CENTERS_PROJECTED = f"""WITH {_SQL_POINTS}, {_SQL_PCA_PARTS}
SELECT cluster, {R("su * (cx * u1 + cy * u2)", ROUND_PROJ)} AS pca_x, {R("sw * (cx * w1 + cy * w2)", ROUND_PROJ)} AS pca_y
FROM ctr, sg"""


def q_cluster_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Points per cluster and grid cell (bounded by the grid); the centres are a query of their own."""
    def make(c: analyses.Clustering) -> DataFrame:
        return _numbered(c, c.scatter().where("not is_center").select("cluster", "cell_x", "cell_y", "n"))
    return _table_of(spark, _planted_clustering(spark, sf), make)


SQL_CLUSTER_SCATTER = f"""WITH {_SQL_POINTS}, {_SQL_PCA_PARTS},
xy AS (SELECT cluster, su * (x * u1 + y * u2) AS px, sw * (x * w1 + y * w2) AS py FROM z, sg),
ext AS (SELECT min(px) AS x0, (max(px) - min(px)) / 100 AS wx, min(py) AS y0, (max(py) - min(py)) / 100 AS wy FROM xy)
SELECT cluster, CAST(least(floor((px - x0) / wx), 99) AS BIGINT) AS cell_x,
       CAST(least(floor((py - y0) / wy), 99) AS BIGINT) AS cell_y, count(*) AS n
FROM xy, ext GROUP BY 1, 2, 3"""


def q_cluster_pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    """E8 for the scatter's axes: explained share per component."""
    def make(c: analyses.Clustering) -> DataFrame:
        return c.explained().select("component", round_half_up(F.col("explained"), ROUND_STAT).alias("explained"))
    return _table_of(spark, _planted_clustering(spark, sf), make)


SQL_CLUSTER_PCA_VARIANCE = f"""WITH {_SQL_POINTS}, {_SQL_PCA_PARTS}
SELECT CAST(1 AS INTEGER) AS component, {R("l1 / (a + c)", ROUND_STAT)} AS explained FROM sg
UNION ALL SELECT CAST(2 AS INTEGER), {R("l2 / (a + c)", ROUND_STAT)} FROM sg"""


# The reference's own flow end to end on the accident-style table: clean ->
# split -> encode -> forest (entry A), binary forest (entry B), and scale -> K-Means (entry C).

def _accident_prepared(spark: SparkSession, sf: str) -> analyses.Prepared:
    return _dealt(planted_accident_frame(spark, sf), ACCIDENT_ROLES)


def q_accident_forest_report(spark: SparkSession, sf: str) -> DataFrame:
    return _multiclass(_accident_prepared(spark, sf))


# Severity follows the hour but for rows whose missing label is filled with the most frequent one.
_SQL_ACCIDENT_LABELS = f"""{PLANTED_ACCIDENT_SQL},
top AS (SELECT min(sev) AS sev FROM (SELECT sev, count(*) AS n FROM planted WHERE sev IS NOT NULL GROUP BY sev
                                     QUALIFY n = max(n) OVER ())),
t AS (SELECT coalesce(sev, (SELECT sev FROM top)) AS sev, {_split_sql('id')} AS split,
             CASE WHEN CAST(substr(time, 1, 2) AS INTEGER) < 8 THEN 'minor'
                  WHEN CAST(substr(time, 1, 2) AS INTEGER) < 16 THEN 'major' ELSE 'fatal' END AS seen FROM planted),
m AS (SELECT sev, row_number() OVER (ORDER BY count(*) DESC, sev) - 1 AS idx FROM t WHERE split = 'train' GROUP BY sev),
c AS (SELECT a.idx AS label, b.idx AS pred, count(*) AS n FROM t JOIN m a ON t.sev = a.sev JOIN m b ON t.seen = b.sev
      WHERE split = 'test' GROUP BY 1, 2),
per AS (SELECT k, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(ap) AS DOUBLE) AS ap, CAST(sum(pp) AS DOUBLE) AS pp FROM (
          SELECT label AS k, CASE WHEN label = pred THEN n ELSE 0 END AS tp, n AS ap, 0 AS pp FROM c
          UNION ALL SELECT pred, 0, 0, n FROM c) GROUP BY k)"""

SQL_ACCIDENT_FOREST_REPORT = f"""
WITH {_SQL_ACCIDENT_LABELS}
SELECT 'metric' AS section, CAST(0 AS INTEGER) AS rank, 'accuracy' AS name, round(sum(tp) / sum(ap), {ROUND_STAT}) AS value FROM per
UNION ALL SELECT 'metric', 0, 'f1', round(sum(2.0 * tp / (pp + ap) * ap) / sum(ap), {ROUND_STAT}) FROM per
UNION ALL SELECT 'count', 0, format('{{}}->{{}}', label, pred), CAST(n AS DOUBLE) FROM c
UNION ALL SELECT 'importance', 1, 'hour', NULL"""


def q_accident_binary_report(spark: SparkSession, sf: str) -> DataFrame:
    """Entry B: is_severe = not the most frequent training label, as it is (true areas)."""
    prep = _dealt(severe_accident_frame(spark, sf), ACCIDENT_ROLES)
    return _binary(prep)


SQL_ACCIDENT_BINARY_REPORT = f"""
WITH {SEVERE_ACCIDENT_SQL}, s AS (SELECT *, {_split_sql('id')} AS split FROM severe)
SELECT 'metric' AS section, CAST(0 AS INTEGER) AS rank, unnest(['area_roc', 'area_pr']) AS name, CAST(1 AS DOUBLE) AS value
UNION ALL SELECT 'count', 0, 'is_severe=' || CASE WHEN coalesce(sev, 'major') = 'major' THEN 0 ELSE 1 END, CAST(count(*) AS DOUBLE)
          FROM s WHERE split = 'train' GROUP BY 3
UNION ALL SELECT 'importance', 1, 'hour', NULL"""


def q_accident_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = accident_frame(spark, sf)
    prep = _dealt(rows, ACCIDENT_ROLES)
    try:
        clusters = analyses.Clustering(prep.data, ["id"], partitions=enough_partitions(rows, CLUSTER_PARTITIONS))
        return _table_of(spark, clusters, lambda c: c.sizes())
    finally:
        prep.release()


def _lineitem_pca(spark: SparkSession, sf: str):
    cols = ["l_quantity", "l_extendedprice"]
    li = features.assemble(_lineitem_split(spark, sf), cols).select(*LINEITEM_KEY, "features", "split")
    # Two fits read the vectors: keep them for the fits only; the returned
    # projection is recomputed from the scan.
    kept = spread(li, enough_partitions(li, CLUSTER_PARTITIONS)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scaler = features.fit_scaler(kept.where(F.col("split") == "train"))
        pca = cluster.fit_pca(scaler.transform(kept), "scaledFeatures", k=2)
    finally:
        kept.unpersist()
    return scaler.transform(li), pca


def q_pca_variance_2d(spark: SparkSession, sf: str) -> DataFrame:
    _, pca = _lineitem_pca(spark, sf)
    ex = cluster.explained_frame(spark, pca)
    return ex.select("component", round_half_up(F.col("explained"), ROUND_STAT).alias("explained"))


_SQL_PCA = f"""
WITH s AS (SELECT *, {_split_sql(LINEITEM_KEY_SQL)} AS split FROM lineitem),
sd AS (SELECT stddev_samp(l_quantity) AS sx, stddev_samp(l_extendedprice) AS sy FROM s WHERE split = 'train'),
z AS (SELECT {', '.join(LINEITEM_KEY)}, l_quantity * (1.0 / sx) AS x, l_extendedprice * (1.0 / sy) AS y FROM s, sd),""" + _SQL_PCA_PARTS

SQL_PCA_VARIANCE_2D = _SQL_PCA + f"""
SELECT CAST(1 AS INTEGER) AS component, {R("l1 / (a + c)", ROUND_STAT)} AS explained FROM sg
UNION ALL
SELECT CAST(2 AS INTEGER), {R("l2 / (a + c)", ROUND_STAT)} FROM sg"""


def q_pca_projection_2d(spark: SparkSession, sf: str) -> DataFrame:
    scaled, pca = _lineitem_pca(spark, sf)
    xy = cluster.project_xy(scaled, pca, LINEITEM_KEY)
    return xy.select(*LINEITEM_KEY, round_half_up(F.col("pca_x"), ROUND_PROJ).alias("pca_x"),
                     round_half_up(F.col("pca_y"), ROUND_PROJ).alias("pca_y"))


SQL_PCA_PROJECTION_2D = _SQL_PCA + f"""
SELECT {', '.join(LINEITEM_KEY)},
       {R("su * (x * u1 + y * u2)", ROUND_PROJ)} AS pca_x,
       {R("sw * (x * w1 + y * w2)", ROUND_PROJ)} AS pca_y
FROM z, sg"""


# ---- registry ---------------------------------------------------------------------

QUERIES: dict[str, Query] = {
    "column_profile": q_column_profile,
    "duplicate_rows": q_duplicate_rows,
    "label_counts_raw": q_label_counts_raw,
    "distinct_counts": q_distinct_counts,
    "severity_share": q_severity_share,
    "impute_clip_timeparts": q_impute_clip_timeparts,
    "fill_statistics": q_fill_statistics,
    "accident_bounds": q_accident_bounds,
    "one_digit_times": q_one_digit_times,
    "cleaned_columns": q_cleaned_columns,
    "feature_lists": q_feature_lists,
    "iqr_bounds": q_iqr_bounds,
    "constant_columns": q_constant_columns,
    "hash_split_counts": q_hash_split_counts,
    "union_split_parts": q_union_split_parts,
    "string_index_map": q_string_index_map,
    "assembled_vectors": q_assembled_vectors,
    "binary_label_counts": q_binary_label_counts,
    "scaled_features": q_scaled_features,
    "accuracy_f1": q_accuracy_f1,
    "roc_pr_area": q_roc_pr_area,
    "forest_stump_split": q_forest_stump_split,
    "forest_multiclass_report": q_forest_multiclass_report,
    "forest_binary_report": q_forest_binary_report,
    "kmeans_sizes": q_kmeans_sizes,
    "kmeans_centers_projected": q_kmeans_centers_projected,
    "pca_variance_2d": q_pca_variance_2d,
    "pca_projection_2d": q_pca_projection_2d,
    "cluster_scatter": q_cluster_scatter,
    "kmeans_centers": q_kmeans_centers,
    "cluster_pca_variance": q_cluster_pca_variance,
    "accident_forest_report": q_accident_forest_report,
    "accident_binary_report": q_accident_binary_report,
    "accident_cluster_sizes": q_accident_cluster_sizes,
}

ORACLE_SQL: dict[str, str] = {
    "column_profile": _sql_column_profile(),
    "duplicate_rows": SQL_DUPLICATE_ROWS,
    "label_counts_raw": SQL_LABEL_COUNTS_RAW,
    "distinct_counts": SQL_DISTINCT_COUNTS,
    "severity_share": SQL_SEVERITY_SHARE,
    "impute_clip_timeparts": SQL_IMPUTE_CLIP_TIMEPARTS,
    "fill_statistics": SQL_FILL_STATISTICS,
    "accident_bounds": SQL_ACCIDENT_BOUNDS,
    "iqr_bounds": _sql_iqr_bounds(),
    "constant_columns": _sql_constant_columns(),
    "hash_split_counts": SQL_HASH_SPLIT_COUNTS,
    "union_split_parts": SQL_UNION_SPLIT_PARTS,
    "string_index_map": SQL_STRING_INDEX_MAP,
    "assembled_vectors": SQL_ASSEMBLED_VECTORS,
    "binary_label_counts": SQL_BINARY_LABEL_COUNTS,
    "scaled_features": _sql_scaled_features(),
    "accuracy_f1": SQL_ACCURACY_F1,
    "roc_pr_area": SQL_ROC_PR_AREA,
    "forest_stump_split": SQL_FOREST_STUMP_SPLIT,
    "forest_multiclass_report": SQL_FOREST_MULTICLASS_REPORT,
    "forest_binary_report": SQL_FOREST_BINARY_REPORT,
    "kmeans_sizes": SQL_KMEANS_SIZES,
    "kmeans_centers": SQL_KMEANS_CENTERS,
    "kmeans_centers_projected": SQL_KMEANS_CENTERS_PROJECTED,
    "cluster_scatter": SQL_CLUSTER_SCATTER,
    "cluster_pca_variance": SQL_CLUSTER_PCA_VARIANCE,
    "accident_forest_report": SQL_ACCIDENT_FOREST_REPORT,
    "accident_binary_report": SQL_ACCIDENT_BINARY_REPORT,
    "one_digit_times": SQL_ONE_DIGIT_TIMES,
    "cleaned_columns": SQL_CLEANED_COLUMNS,
    "feature_lists": SQL_FEATURE_LISTS,
    "pca_variance_2d": SQL_PCA_VARIANCE_2D,
    "pca_projection_2d": SQL_PCA_PROJECTION_2D,
}

QUERIES.update(tables_at_scale.QUERIES)
ORACLE_SQL.update(tables_at_scale.ORACLE_SQL)
