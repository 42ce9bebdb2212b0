"""Types and formats of text columns, found from all their values.

One aggregate counts, per column, how many values each candidate reads: truth values, whole numbers, numbers, and
each date, timestamp and time format.  The columns are turned into rows first, so the plan is as large
for a hundred columns as for one; a task sends on one row per column, whatever the table's size.

A column has the first kind of ``KINDS`` that reads all its values; within a kind the first format does (month before
day, as pandas has it), and the others that read all of them too are reported as ties."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The texts that pandas reads as truth values.
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf|[iI]nfinity)\s*$"

#: Candidate formats by kind; the order decides ties.
DATES = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d, yyyy")
STAMPS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy/M/d H:m:s", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s", "d.M.yyyy H:m:s",
          "yyyy-M-d H:m", "M/d/yyyy H:m", "d/M/yyyy H:m")
TIMES = ("H:m:s", "H:m")
KINDS = ("boolean", "bigint", "double", "date", "timestamp", "time")


@dataclass(frozen=True)
class ColumnFormat:
    """What a column's values are.  ``read``: how many values each candidate format or plain kind reads."""

    values: int
    kind: str
    format: str | None
    ties: tuple[str, ...]
    read: dict[str, int]

    def nearest(self) -> tuple[str | None, int]:
        """The candidate that reads most values, and how many; the first of equal ones."""
        best = max(self.read, key=lambda k: self.read[k], default=None)
        return (best, self.read[best]) if best is not None and self.read[best] else (None, 0)


def shape(fmt: str) -> str:
    """A regular expression for the texts that a format can read: its digits' places and the signs between them.
    It spares the parser (and the exceptions inside it) the values that can't fit."""
    out, quoted = [], False
    for token in re.findall(r"yyyy|MMM|[MdHms]|'|.", fmt):
        if token == "'":
            quoted = not quoted
        elif quoted:
            out.append(re.escape(token))
        else:
            out.append({"yyyy": "[0-9]{4}", "MMM": "[A-Z][a-z]{2}"}.get(token, "[0-9]{1,2}" if token in "MdHms" else re.escape(token)))
    return "^" + "".join(out) + "$"


def parse(x: Column, fmt: str) -> Column:
    """A local timestamp, NULL where the value doesn't fit."""
    return F.when(x.rlike(shape(fmt)), F.try_to_timestamp(x, F.lit(fmt)).cast("timestamp_ntz"))


def parse_date(x: Column, formats: tuple[str, ...]) -> Column:
    """The date by the first format that reads the value."""
    return F.coalesce(*[parse(x, f) for f in formats]).cast("date")


def _candidates(dates: bool) -> dict[str, list[tuple[str, str | None]]]:
    plain = {k: [(k, None)] for k in KINDS[:3]}
    return plain | ({k: [(f, f) for f in fs] for k, fs in zip(KINDS[3:], (DATES, STAMPS, TIMES))} if dates else {})


def column_formats(df: DataFrame, cols: list[str] | None = None, dates: bool = True) -> dict[str, ColumnFormat]:
    """The type and format of each text column of ``df`` (or of ``cols``), from one pass over all rows.

    NULLs don't count; a column without values is ``double``, as in pandas; a column whose values no candidate reads
    whole is ``string``.  Whole numbers beyond 64 bits are ``double``.  ``dates=False`` leaves out date and time formats."""
    cols = [c for c, t in df.dtypes if t == "string"] if cols is None else cols
    if not cols:
        return {}
    # Names may clash with anything: the long table has its own two columns only.
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").cast("string").alias("x"))
                                        for i, c in enumerate(cols)])))
    x = F.col("x")
    reads = {"boolean": x.isin(*TRUTH), "bigint": x.rlike(WHOLE) & x.try_cast("bigint").isNotNull(),
             "double": x.rlike(NUMBER)}
    lattice = _candidates(dates)
    names = [name for options in lattice.values() for name, _ in options]
    aggs = [F.count(F.when(reads[n] if n in reads else parse(x, n).isNotNull(), True)).alias(f"c{i}") for i, n in enumerate(names)]
    found = {r["place"]: r for r in long.groupBy("place").agg(F.count("x").alias("n"), *aggs).collect()}    # a row per column
    out = {}
    for place, c in enumerate(cols):
        row = found.get(place)
        n = int(row["n"]) if row else 0
        read = {name: int(row[f"c{i}"]) if row else 0 for i, name in enumerate(names)}
        kind, fmt, ties = ("double", None, ()) if n == 0 else ("string", None, ())
        for k, options in lattice.items() if n else ():
            whole = [f for name, f in options if read[name] == n]
            if whole:
                kind, fmt, ties = k, whole[0], tuple(f for f in whole[1:] if f)
                break
        out[c] = ColumnFormat(n, kind, fmt, ties, read)
    return out


def formats_frame(spark: SparkSession, found: dict[str, ColumnFormat]) -> DataFrame:
    """(column_name, n_values, kind, format, ties, nearest, n_nearest) per column."""
    rows = [(c, f.values, f.kind, f.format, " | ".join(f.ties) or None, *f.nearest()) for c, f in found.items()]
    return spark.createDataFrame(rows, "column_name string, n_values bigint, kind string, format string, ties string, "
                                       "nearest string, n_nearest bigint")


def date_formats(df: DataFrame, col: str, mixed: bool = False, whole: bool = True) -> tuple[str, ...]:
    """The date and timestamp formats to read a text column with.

    One that reads every value; with ``mixed`` all that read any value, in order of preference (a value that several
    read is read by the first: month before day).  If none reads all values: a ``ValueError`` naming how many the best
    one reads, or with ``whole=False`` that best one.  A column without values gives the first format."""
    found = column_formats(df, [col])[col]
    read = {f: found.read[f] for f in (*DATES, *STAMPS)}
    if mixed:
        return tuple(f for f in read if read[f]) or DATES[:1]
    best = max(read, key=lambda f: read[f])
    if read[best] < found.values and whole:
        raise ValueError(f"no date format reads all {found.values} values of {col}: {best} reads {read[best]}")
    return (best,)
