"""CSV records from byte blocks in parallel (S1), and a parse that keeps bad rows aside.

A CSV file whose quoted fields hold line ends can't be cut at any line end:
whether one ends a record depends on the quotes before it.  But only on their
number: a line starts a record when an even number of quotes stands before it.
So files are read as lines, in as many tasks as there are blocks; quotes are
counted per block; the running parity of the blocks (a row per block) tells each
block how it begins; and running counts within the blocks tell each line.  Lines of
records that hold line ends are put together, across blocks too; all
others are records as they are."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.session import cut_lineage

PARSE = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "corrupt"}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record) of a CSV file or folder: ``line`` is the number, from 1, of the record's first line
    in its file.  Records may hold line ends inside quotes, of which an escaped one is doubled; a carriage
    return before a record's line end is no part of it; a last quote that is never closed takes the rest of its file; empty
    lines between records are left out.

    Shuffled once by block (for the running counts), and records of several lines once more.  A block is
    what one task reads, so no task holds more than that and one record."""
    meta = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    lines = meta.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A row per block of a file: its window is as long as the file has blocks.
    blocks = blocks.select("file", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
                                              for c in ("quotes", "lines")))
    inner = Window.partitionBy("file", "block").orderBy("at")
    held = lines.join(blocks, ["file", "block"])
    here = F.coalesce(F.sum("quotes").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("starts", (F.col("quotes_before") + here) % 2 == 0) \
               .withColumn("line", F.col("lines_before") + F.row_number().over(inner))
    # A record of one line: it starts one and ends with an even number of quotes.
    whole = F.col("starts") & (F.col("quotes") % 2 == 0)
    single = held.where(whole).select("file", "line", F.col("value").alias("record"))
    return single.unionAll(_joined(held.where(~whole))) \
        .withColumn("record", F.regexp_replace("record", "\r\\z", "")).where("record <> ''")


def _joined(parts: DataFrame) -> DataFrame:
    """Records of several lines.  The lines that are left come in runs: one that starts a record, those inside
    it, and the one that closes it, which neither starts one nor leaves it open.  Only these lines are
    numbered across blocks, by the starts before them."""
    first = parts.groupBy("file", "block").agg(F.count(F.when(F.col("starts"), True)).alias("records"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("file", "block", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("records_before"))
    inner = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.join(first, ["file", "block"]).withColumn(
        "record_no", F.col("records_before") + F.sum(F.col("starts").cast("long")).over(inner))
    rows = numbered.groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    return rows.select("file", F.get("parts", F.lit(0))["line"].alias("line"),
                       F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))


@dataclass
class CsvParse:
    """``rows``: typed rows; ``rejected``: (file, line, record, reason).  Both read one written parse."""

    rows: DataFrame
    rejected: DataFrame


def header_names(records: DataFrame) -> list[str]:
    """Column names from the files' first records, which must agree (one row per distinct header)."""
    first = records.groupBy("file").agg(F.min_by("record", "line").alias("header")).select("header").distinct().limit(2).collect()
    if not first:
        return []
    if len(first) > 1:
        raise ValueError("files have different headers")
    return next(csv.reader(io.StringIO(first[0]["header"], newline="")))


def parse_records(records: DataFrame, names: list[str], header: bool = True) -> DataFrame:
    """(file, line, record, fields, corrupt): fields is a struct of texts by position (f0, f1, ...);
    ``corrupt`` is set where a record has too few or too many fields.  With ``header`` the files' first records are left out."""
    schema = ", ".join([f"f{i} string" for i in range(len(names))] + ["corrupt string"])
    if header:
        first = records.groupBy("file").agg(F.min("line").alias("line"))
        records = records.join(first, ["file", "line"], "left_anti")
    parsed = records.withColumn("p", F.from_csv("record", schema, PARSE))
    return parsed.select("file", "line", "record", F.struct(*[F.col(f"p.f{i}") for i in range(len(names))]).alias("fields"),
                         F.col("p.corrupt").alias("corrupt"))


def read_records(spark: SparkSession, path: str, header: bool = True, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(parsed records, column names).  The records are written to the shared folder once: the header and the
    rows read them there.  Without a header the columns are ``names``."""
    from riskspark.sources.readers import SourceError
    try:
        records = cut_lineage(csv_records(spark, path))
        names = header_names(records) if header else list(names or [])
    except (AnalysisException, ValueError) as exc:
        raise SourceError(f"cannot read {path}: {exc}") from exc
    return parse_records(records, names, header), names


def read_csv_keeping_rejects(spark: SparkSession, path: str, schema: T.StructType | str, na_tokens: tuple[str, ...],
                             header: bool = True) -> CsvParse:
    """Typed rows, and the rows that can't be: with file, line, text and the first reason.

    A record with too few or too many fields, or with a value that its column's type can't hold, is rejected as
    a whole; missing-value texts are NULL in any column.  Columns are matched by the header's names, without a
    header by place.  One pass parses and types; its result is written to the shared folder, where both
    tables read it."""
    from riskspark.sources.readers import SourceError
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed, names = read_records(spark, path, header, wanted.names)
    absent = [f.name for f in wanted.fields if f.name not in names]
    if absent:
        raise SourceError(f"{path} has no columns {absent}")

    def text(name: str) -> Column:
        c = F.col(f"fields.f{names.index(name)}")
        return F.when(~c.isin(*na_tokens), c)

    reasons = [F.when(F.col("corrupt").isNotNull(), F.lit(f"not {len(names)} fields"))]
    reasons += [F.when(text(f.name).isNotNull() & text(f.name).try_cast(f.dataType).isNull(),
                       F.concat(F.lit(f"column {f.name} can't hold "), text(f.name)))
                for f in wanted.fields if not isinstance(f.dataType, T.StringType)]
    typed = F.struct(*[text(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    kept = cut_lineage(parsed.select("file", "line", "record", typed.alias("row"), F.coalesce(*reasons).alias("reason")))
    return CsvParse(kept.where("reason IS NULL").select("row.*"),
                    kept.where("reason IS NOT NULL").select("file", "line", "record", "reason"))
