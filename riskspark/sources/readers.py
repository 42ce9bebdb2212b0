"""Readers: CSV with a role-based schema (S1, S2), parquet, and the small
literal table of k vectors (S4)."""

from __future__ import annotations

from pyspark.ml.linalg import Vectors
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.formats import ColumnFormat, column_formats, parse
from riskspark.roles import Roles
from riskspark.sources.records import read_records


class SourceError(RuntimeError):
    """The input could not be read; raised instead of printing and exiting."""


# The texts that pandas reads as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: The column types of the kinds that inference finds (times of day stay text).
INFERRED = {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(),
            "timestamp": T.TimestampNTZType(), "string": T.StringType()}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             roles: Roles = Roles(), infer: bool = False, mode: str = "FAILFAST",
             multi_line: bool = False, na_tokens: tuple[str, ...] = NA_TOKENS, probe: bool = False,
             infer_dates: bool = False) -> DataFrame:
    """Read a CSV file or folder with a header line, as its users have it.

    Every field is read as text, columns by the header's names; quotes
    inside quoted fields are doubled; ``multi_line`` allows line ends inside them (a file is
    still many tasks: ``records.csv_records``).  Missing-value texts become NULL, and only then are columns
    typed: by ``schema`` (matched by name, extra file columns are left out), or with
    ``infer=True`` as truth values, whole numbers, numbers or text by one pass over all rows, with ``infer_dates`` also as
    dates and timestamps where one known format reads every value (``operators.formats``); with neither every
    column stays text.  The date and time roles stay text; cleaning parses them.

    ``mode='FAILFAST'`` makes malformed rows and values that don't fit their type fail, others
    give NULL.  A path that can't be read or a missing column is a ``SourceError`` now; bad rows
    are one too with ``probe=True`` (a pass over the file), else the job that meets them fails."""
    if multi_line:
        raw = _from_records(spark, path, mode)
    else:
        reader = spark.read.option("header", True).option("mode", mode).option("escape", '"').option("quote", '"') \
                           .option("enforceSchema", False)
        try:
            raw = reader.csv(path)
        except AnalysisException as exc:
            raise SourceError(f"cannot read {path}: {exc}") from exc
    raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(*na_tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    keep_text = {c for c in (roles.date, roles.time) if c}
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        absent = [f.name for f in wanted.fields if f.name not in raw.columns]
        if absent:
            raise SourceError(f"{path} has no columns {absent}")
        kinds = {f.name: f.dataType for f in wanted.fields}
    elif infer:
        found = _inferred(raw, keep_text, infer_dates)
        raw = raw.select(*[(parse(F.col(f"`{c}`"), f.format) if f.format else F.col(f"`{c}`")).alias(c) for c, f in found.items()])
        kinds = {c: INFERRED[f.kind] for c, f in found.items()}
    else:
        kinds = {c: T.StringType() for c in raw.columns}
    out = raw.select(*[_typed(c, T.StringType() if c in keep_text else t, mode).alias(c) for c, t in kinds.items()])
    if probe:
        try:
            out.write.format("noop").mode("overwrite").save()
        except Exception as exc:      # Spark names a bad row's fault by several classes
            raise SourceError(f"cannot read {path}: {exc}") from exc
    return out


def _from_records(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """Text columns of a CSV whose fields may hold line ends."""
    parsed, names = read_records(spark, path)
    bad = F.col("corrupt").isNotNull()
    if mode == "DROPMALFORMED":
        parsed = parsed.where(~bad)
    checked = F.col("fields")
    if mode == "FAILFAST":
        says = F.concat(F.lit(f"not {len(names)} fields in line "), F.col("line").cast("string"))
        checked = F.when(bad, F.raise_error(says).cast(parsed.schema["fields"].dataType)).otherwise(checked)
    return parsed.select(checked.alias("fields")).select(*[F.col(f"fields.f{i}").alias(n) for i, n in enumerate(names)])


def _typed(name: str, kind: T.DataType, mode: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c
    if mode == "FAILFAST":
        bad = F.raise_error(F.concat(F.lit(f"column {name} can't hold "), c)).cast(kind)
        return F.when(c.isNotNull() & c.try_cast(kind).isNull(), bad).otherwise(c.try_cast(kind))
    return c.try_cast(kind)


def _inferred(raw: DataFrame, keep_text: set[str], dates: bool) -> dict[str, ColumnFormat]:
    """Each column's type from one pass over all rows; those of ``keep_text``, and times of day, stay text."""
    found = column_formats(raw, [c for c in raw.columns if c not in keep_text], dates)
    text = ColumnFormat(0, "string", None, (), {})
    return {c: text if found.get(c, text).kind == "time" else found.get(c, text) for c in raw.columns}


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        raise SourceError(f"cannot read {path}: {exc}") from exc
    return df.select(*columns) if columns else df


def literal_vectors(spark: SparkSession, vectors: list[list[float]], col: str = "features",
                    id_col: str | None = "cluster") -> DataFrame:
    """A k-row table of dense vectors (k is small: cluster centres)."""
    rows = [((i,) if id_col else ()) + (Vectors.dense([float(v) for v in vec]),)
            for i, vec in enumerate(vectors)]
    names = ([id_col] if id_col else []) + [col]
    return spark.createDataFrame(rows, names)
