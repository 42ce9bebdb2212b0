"""Cleaning (L1-L15): fit small per-column statistics, then apply them as
plain column expressions in one projection.

Fit order follows the reference:

1. one profiling aggregate over all columns: rows, missing per column,
   min/max of numeric and text columns;
2. columns that are entirely missing are dropped and reported;
3. numeric columns with missing values get the exact median, other atomic
   columns (text, boolean, date, timestamp) the mode (ties: smallest value);
4. quartiles of the *imputed* numeric columns (all but the id) give the clip
   range [Q1 - 3*IQR, Q3 + 3*IQR]; a zero IQR collapses the column and is
   flagged;
5. text columns with at most one distinct value are dropped (min = max,
   from step 1: the mode fill never adds a new value).

The fitted model holds one number or text per column; ``transform`` turns it
into literals (``coalesce``, ``least``/``greatest``), so the cleaned table is
a single codegen'd projection with no join, whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.columns import is_atomic, is_floating, is_numeric
from riskspark.functions.exprs import IQR_FACTOR, clip, missing, peak_hour
from riskspark.operators.formats import date_formats, parse_date
from riskspark.operators.statistics import medians_and_quartiles, modes, quantiles, value_expr
from riskspark.roles import Roles

# Fixed value: the reference parses the time column with this pattern.
# One letter reads one or two digits, as the reference's pattern does.
TIME_FORMAT = "H:m:s"


@dataclass(frozen=True)
class Bounds:
    q1: float
    q3: float
    iqr: float
    lo: float
    hi: float
    collapsed: bool


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = IQR_FACTOR, method: str = "exact",
               stats: dict | None = None) -> dict[str, Bounds]:
    """L5 + L6: quartiles and the clip range of each numeric column."""
    qs = quantiles(df, cols, [0.25, 0.75], method=method, stats=stats)
    return {c: bounds_of(*qs[c], factor) for c in cols if qs[c][0] is not None}


def bounds_of(q1: float, q3: float, factor: float = IQR_FACTOR) -> Bounds:
    iqr = q3 - q1
    return Bounds(q1, q3, iqr, q1 - factor * iqr, q3 + factor * iqr, iqr == 0.0)


def constant_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, non_null, min_value, max_value, is_constant)
    per text column from one aggregate; a column is constant when it has
    at most one distinct non-missing value (min = max, or all missing)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_null"),
                      F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
                      F.coalesce(F.col(f"lo{i}") == F.col(f"hi{i}"), F.lit(True)).alias("is_constant"))
             for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def bounds_frame(spark: SparkSession, bounds: dict[str, Bounds]) -> DataFrame:
    schema = ("column_name string, q1 double, q3 double, iqr double, lo double, hi double, "
              "collapsed boolean")
    rows = [(c, b.q1, b.q3, b.iqr, b.lo, b.hi, b.collapsed) for c, b in bounds.items()]
    return spark.createDataFrame(rows, schema)


@dataclass
class CleaningModel:
    roles: Roles
    columns: list[str]
    types: dict[str, T.DataType]
    rows: int
    missing: dict[str, int]
    numeric_fill: dict[str, float] = field(default_factory=dict)
    other_fill: dict[str, str] = field(default_factory=dict)
    bounds: dict[str, Bounds] = field(default_factory=dict)
    all_null: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    derive_time: bool = True
    bad_time: str = "raise"
    date_format: str | tuple[str, ...] | None = None      # None: ISO dates; several: the first that reads a value
    time_format: str = TIME_FORMAT
    num_minmax: dict[str, tuple] = field(default_factory=dict)

    # ---- apply ---------------------------------------------------------
    def _base(self, name: str) -> Column:
        dtype = self.types[name]
        if name in self.numeric_fill:
            x = F.coalesce(F.col(name).cast("double") if not is_floating(dtype)
                           else F.when(~F.isnan(F.col(name)), F.col(name)).cast("double"),
                           F.lit(float(self.numeric_fill[name])))
        elif name in self.other_fill:
            x = F.coalesce(F.col(name), F.lit(self.other_fill[name]).cast(dtype))
        else:
            x = F.col(name)
        if name in self.bounds:
            b = self.bounds[name]
            x = clip(x, b.lo, b.hi)
        return x

    def _parse_date(self, x: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            if isinstance(self.date_format, tuple):
                found = parse_date(x, self.date_format)
                if self.bad_time != "raise":
                    return found
                unread = F.raise_error(F.concat(F.lit(f"no date format of {', '.join(self.date_format)} reads "), x)).cast("date")
                return F.when(x.isNotNull() & found.isNull(), unread).otherwise(found)
            args = [x] if self.date_format is None else [x, self.date_format]
            return F.to_date(*args) if self.bad_time == "raise" else F.try_to_date(*args)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return x.cast("date")
        return x

    def _parse_time(self, x: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            if self.bad_time == "raise":
                return F.to_timestamp_ntz(x, F.lit(self.time_format))
            return F.try_to_timestamp(x, F.lit(self.time_format)).cast("timestamp_ntz")
        return x

    def kept(self) -> list[str]:
        gone = set(self.all_null) | set(self.constant)
        return [c for c in self.columns if c not in gone]

    def transform(self, df: DataFrame) -> DataFrame:
        r = self.roles
        exprs = {}
        for c in self.kept():
            x = self._base(c)
            if self.derive_time and c == r.date:
                x = self._parse_date(x, self.types[c])
            elif self.derive_time and c == r.time:
                x = self._parse_time(x, self.types[c])
            exprs[c] = x
        out = df.select(*[x.alias(c) for c, x in exprs.items()])
        derived = {}
        if self.derive_time and r.date and r.date in exprs:
            derived["month"] = F.month(F.col(r.date))
        if self.derive_time and r.time and r.time in exprs:
            hour = F.hour(F.col(r.time))
            derived["hour"] = hour
            derived["is_peak_hour"] = peak_hour(hour)
        return out.withColumns(derived) if derived else out

    def reference_types(self) -> dict[str, str]:
        """The Spark type that each numeric column has in the reference, where
        pandas reads and cleans the table first: whole numbers are bigint unless
        a value is missing, or is clipped to a bound that is no whole number; month and hour are int; the peak flag is
        bigint."""
        out = {}
        for c in self.kept():
            if c not in self.num_minmax:
                continue
            kind = "double" if is_floating(self.types[c]) or self.missing[c] else "bigint"
            if kind == "bigint" and c in self.bounds:
                (lo, hi), b = self.num_minmax[c], self.bounds[c]
                if (lo is not None and lo < b.lo and not b.lo.is_integer()) or \
                        (hi is not None and hi > b.hi and not b.hi.is_integer()):
                    kind = "double"
            out[c] = kind
        out.update({"month": "int", "hour": "int", "is_peak_hour": "bigint"})
        return out

    # ---- reports -------------------------------------------------------
    def fills_frame(self, spark: SparkSession) -> DataFrame:
        """(column_name, method, num_value, text_value, missing) per filled column."""
        rows = [(c, "median", float(v), None, self.missing[c]) for c, v in self.numeric_fill.items()]
        rows += [(c, "mode", None, v, self.missing[c]) for c, v in self.other_fill.items()]
        return spark.createDataFrame(
            rows, "column_name string, method string, num_value double, text_value string, missing bigint")

    def bounds_frame(self, spark: SparkSession) -> DataFrame:
        return bounds_frame(spark, self.bounds)


def fit_cleaning(df: DataFrame, roles: Roles, iqr_factor: float = IQR_FACTOR,
                 quantile_method: str = "exact", impute_id: bool = True,
                 clip_label: bool = True, derive_time: bool = True,
                 bad_time: str = "raise", date_format: str | None = None, time_format: str = TIME_FORMAT,
                 parts: tuple[str, ...] = ("fill", "clip")) -> CleaningModel:
    """Fit the cleaning statistics on ``df`` (pass the training part to fit on train only).

    ``date_format``: a pattern, None for ISO dates, ``"infer"`` for the one known format that reads every date of ``df``
    (a ``ValueError`` if none does; with ``bad_time='null'`` the one that reads most), or ``"mixed"`` for the first
    known format that reads each value (``operators.formats``; a pass over the date column).
    ``parts``: what the caller will use; statistics of other parts are not worked out."""
    fields = [f for f in df.schema.fields if is_atomic(f.dataType) and f.name not in set(roles.passthrough)]
    types = {f.name: f.dataType for f in fields}
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]

    if date_format in ("infer", "mixed"):
        is_text = derive_time and isinstance(types.get(roles.date), T.StringType)
        date_format = date_formats(df, roles.date, date_format == "mixed", bad_time == "raise") if is_text else None

    # 1. one profiling pass
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count(F.when(missing(F.col(f.name), is_floating(f.dataType)), True)).alias(f"m{i}"))
    for i, c in enumerate(numeric):
        x = value_expr(df, c)
        aggs += [F.min(x).alias(f"nlo{i}"), F.max(x).alias(f"nhi{i}")]
    for i, c in enumerate(text):
        aggs += [F.min(c).alias(f"tlo{i}"), F.max(c).alias(f"thi{i}")]
    row = df.agg(*aggs).first()
    rows = int(row["rows"])
    miss = {f.name: int(row[f"m{i}"]) for i, f in enumerate(fields)}
    num_minmax = {c: (row[f"nlo{i}"], row[f"nhi{i}"]) for i, c in enumerate(numeric)}
    text_minmax = {c: (row[f"tlo{i}"], row[f"thi{i}"]) for i, c in enumerate(text)}

    model = CleaningModel(roles=roles, columns=[f.name for f in df.schema.fields], types=types,
                          rows=rows, missing=miss, derive_time=derive_time, bad_time=bad_time,
                          date_format=date_format, time_format=time_format, num_minmax=num_minmax)
    model.types.update({f.name: f.dataType for f in df.schema.fields})
    model.missing.update({c: 0 for c in model.columns if c not in model.missing})

    # 2. entirely missing columns
    if rows > 0:
        model.all_null = [c for c in types if miss[c] == rows]
    present = [c for c in types if c not in model.all_null]

    # 5 (decided early). constant text columns (roles are never dropped): the
    # mode fill never adds a new value, so min = max of the raw column decides
    # it, and a column about to be dropped needs no fill statistics.
    protected = set(roles.named())
    model.constant = [c for c in text if c in present and c not in protected
                      and text_minmax[c][0] == text_minmax[c][1]]

    # 3. fills, 4. clip range from quartiles of the imputed values
    to_median = [c for c in numeric if c in present and miss[c] > 0 and (impute_id or c != roles.id)] \
        if "fill" in parts else []
    to_mode = [c for c in present if c not in numeric and miss[c] > 0 and c not in model.constant] \
        if "fill" in parts else []
    clip_cols = [c for c in numeric if c in present and c != roles.id and (clip_label or c != roles.label)] \
        if "clip" in parts else []
    stats = {c: (rows - miss[c], *num_minmax[c]) for c in numeric}
    if to_mode:
        found = modes(df, to_mode)
        model.other_fill = {c: found[c][0] for c in to_mode if found[c][0] is not None}
    if quantile_method != "exact":
        if to_median:
            med = quantiles(df, to_median, [0.5], method=quantile_method, stats=stats)
            model.numeric_fill = {c: med[c][0] for c in to_median}
        if clip_cols:
            imputed = df.select(*[model._base(c).alias(c) if c in model.numeric_fill else F.col(c) for c in clip_cols])
            model.bounds = iqr_bounds(imputed, clip_cols, iqr_factor, quantile_method)
        return model
    filled = {c: (rows - miss[c], miss[c]) for c in to_median}
    medians, quartiles = medians_and_quartiles(df, to_median, clip_cols, filled, stats)
    model.numeric_fill = medians
    model.bounds = {c: bounds_of(*q, iqr_factor) for c, q in quartiles.items() if q[0] is not None}

    return model
