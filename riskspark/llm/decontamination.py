"""Operator 11: benchmark decontamination by winnowing.  DataFrame functions only.

A text is its words (ASCII capitals lower-cased).  Every benchmark item is cut
into windows of ten words; a shorter item is one window.  A k-gram hash is
taken at every word, and of each run of w neighbouring hashes the least one is
kept, where k + w - 1 is the window's length: any shared span of that length
holds the same w hashes on both sides, hence the same least one, so equal
fingerprints find every shared span.  A hit is then extended: all the windows
whose least hash it is are compared word for word, so the fingerprints decide
what is looked at and never what is reported.

Where the benchmark's fingerprints are few (a checked count) they are broadcast
and the documents' hashes never leave their task; beyond, slim fingerprints
are shuffled and only documents with hits are read again.  Both ways give the
same rows.  Work is done per distinct text, so copies of a text add rows to
the first partial sums only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import cut, pack, text_or_empty

#: Words of a window; a shorter item is one window of all its words.
SPAN = 10
#: Windows of the benchmark that may be broadcast (about 150 bytes each).
BROADCAST_WINDOWS = 400_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts words, whether or not capitals are lower-cased: all of ASCII but letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Words of a text as they are.  Split between them: extracting them one by one takes ten times as long."""
    inner = F.btrim(text, F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATOR))


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for NULL."""
    return _split(F.translate(text_or_empty(text), UPPER, LOWER))


def gram_length(span: int) -> int:
    """k for spans of this many words; the sliding window then has span - k + 1 hashes."""
    return (span + 1) // 2


def _grams(tokens: Column, k: int) -> Column:
    """Hash of the k words at each place that has k words."""
    hashes = F.transform(tokens, lambda _, i: F.xxhash64(F.slice(tokens, i + 1, F.lit(k))))
    return F.slice(hashes, F.lit(1), F.greatest(F.size(tokens) - F.lit(k - 1), F.lit(0)))


def _least(grams: Column, w: int) -> Column:
    """Least hash of each run of w neighbours."""
    least = F.transform(grams, lambda _, i: F.array_min(F.slice(grams, i + 1, F.lit(w))))
    return F.slice(least, F.lit(1), F.greatest(F.size(grams) - F.lit(w - 1), F.lit(0)))


def _starts(least: Column) -> Column:
    """Places at which another minimum is kept than at the place before."""
    begins = F.transform(least, lambda x, i: F.when((i == 0) | (x != F.get(least, i - 1)), i))
    return F.filter(begins, lambda i: i.isNotNull())


def _runs(least: Column, starts: Column, span: int) -> Column:
    return F.transform(starts, lambda at, j: F.struct(
        F.lit(span).alias("span"), F.get(least, at).alias("f"), at.alias("start"),
        (F.coalesce(F.get(starts, j + 1), F.size(least)) - 1).alias("stop")))


def fingerprints(df: DataFrame, tokens: str, spans: list[int], out: str = "prints") -> DataFrame:
    """Adds ``out``: array<struct<span, f, start, stop>>, one entry per kept minimum:
    f is the least k-gram hash of each of the windows start..stop (from 0).
    Each step is a select of its own whose arrays are named more than once, so that
    none is worked out again inside another's lambda.  (Read ``out`` with ``inline_outer``: ``inline`` makes
    Spark push a test of the array's size, and with it all these steps, down to the scan.)"""
    keep = list(df.columns)
    for step, column in (("g", lambda span: _grams(F.col(tokens), gram_length(span))),
                         ("m", lambda span: _least(F.col(f"__g{span}"), span - gram_length(span) + 1)),
                         ("s", lambda span: _starts(F.col(f"__m{span}")))):
        for span in spans:
            df = df.withColumn(f"__{step}{span}", column(span))
    runs = [_runs(F.col(f"__m{span}"), F.col(f"__s{span}"), span) for span in spans]
    return df.withColumn(out, F.concat(*runs)).select(*keep, out)


def _windows(tokens: Column, span: Column, start: Column, stop: Column) -> Column:
    """array<struct<at, window>>: the words of each window start..stop, joined by a space (no word has one)."""
    return F.transform(F.sequence(start, stop), lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice(tokens, i + 1, span), " ").alias("window")))


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(span, f, window, class) per distinct window, and (class, items) per distinct
    set of items: windows that the same items have share one class.  An item's id is its
    text form; rows with one id are one item; a NULL id is an item with an empty id."""
    tokens = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
                          words(F.col(f"`{text_col}`")).alias("tokens"))
    tokens = cut(tokens.withColumn("length", F.least(F.size("tokens"), F.lit(span))).where("length > 0"))
    lengths = sorted(r["length"] for r in tokens.select("length").distinct().collect())      # at most ``span`` rows
    parts = [fingerprints(tokens.where(F.col("length") == n), "tokens", [n]) for n in lengths] \
        or [tokens.withColumn("prints", F.array().cast("array<struct<span:int,f:long,start:int,stop:int>>"))]
    prints = reduce(DataFrame.unionAll, parts).select("item", "tokens", F.inline_outer("prints"))
    each = prints.select("item", "span", "f", F.inline_outer(_windows(F.col("tokens"), F.col("span"), F.col("start"), F.col("stop"))))
    held = each.groupBy("span", "f", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = cut(held.withColumn("class", F.unhex(F.sha2(F.concat_ws(",", F.transform(
        "items", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))), 256))))
    return held.select("span", "f", "window", "class"), held.groupBy("class").agg(F.first("items").alias("items"))


def hit_windows(texts: DataFrame, windows: DataFrame, spans: list[int], few: bool) -> DataFrame:
    """(key, at, span, class): the benchmark windows that occur in ``texts`` (key, text), once
    for each distinct key and place.  ``few``: ``windows`` may be broadcast."""
    known = windows.select("span", "f").distinct()
    tokens = texts.select("key", words(F.col("text")).alias("tokens"))
    if few:
        prints = fingerprints(tokens, "tokens", spans).select("key", "tokens", F.inline_outer("prints"))
        hits = prints.join(F.broadcast(known), ["span", "f"])
    else:
        prints = fingerprints(tokens, "tokens", spans).select("key", F.inline_outer("prints")).distinct()
        found = cut(prints.join(cut(known), ["span", "f"]).groupBy("key").agg(
            F.collect_list(F.struct("span", "f", "start", "stop")).alias("prints")))
        hits = texts.join(found, "key").select("key", words(F.col("text")).alias("tokens"), "prints") \
                    .select("key", "tokens", F.inline_outer("prints"))
    each = hits.select("key", "span", "f", F.inline_outer(_windows(F.col("tokens"), F.col("span"), F.col("start"), F.col("stop"))))
    each = each.join(F.broadcast(windows) if few else windows, ["span", "f", "window"])
    return each.groupBy("key", "at", "span").agg(F.first("class").alias("class"))


def _covered(places: Column) -> Column:
    """Words in the union of the ranges (at, span) of a sorted array."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(places, start, lambda acc, p: F.struct(
        F.greatest(acc["end"], p["at"] + p["span"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0), p["at"] + p["span"] - F.greatest(acc["end"], p["at"]))).alias("total")),
        lambda acc: acc["total"])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", span: int = SPAN, broadcast_windows: int = BROADCAST_WINDOWS,
                  with_text: bool = True) -> DataFrame:
    """(row, n_words, n_hit, places, items) per document; ``row`` is a struct of the input's columns, without the
    text (which then crosses no join) where ``with_text`` is false.

    ``places`` are the (at, span) of the benchmark windows found, by place (from 0, in words), ``items``
    the ids, sorted, of the items that have them; both are empty, not NULL, where nothing is
    found.  NULL or empty texts have no words; repeated rows are reported alike; an
    empty benchmark hits nothing; an empty table gives an empty result."""
    windows, classes = benchmark_windows(items, item_col, item_text_col, span)
    # One count per window length, at most ``span`` rows.
    lengths = {r["span"]: r["n"] for r in windows.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = pack(docs).withColumn("text", F.col(f"row.`{text_col}`"))
    key = F.unhex(F.sha2(text_or_empty("text"), 256))
    texts = rows.select(key.alias("key"), "text")
    row = F.col("row") if with_text else F.struct(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text_col])
    slim = rows.select(row.alias("row"), F.size(_split(text_or_empty("text"))).cast("long").alias("n_words"),
                       key.alias("key"))
    if not lengths:
        found = texts.limit(0).select("key", F.array().cast("array<struct<at:int,span:int>>").alias("places"),
                                      F.array().cast("array<string>").alias("items"))
    else:
        hits = hit_windows(texts, windows, sorted(lengths), sum(lengths.values()) <= broadcast_windows)
        per = cut(hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "span"))).alias("places"),
                                          F.array_sort(F.collect_set("class")).alias("classes"))
                  .withColumn("set", F.unhex(F.sha2(F.concat(*[F.array_join(F.transform("classes", F.hex), ",")]), 256))))
        # Items are gathered once for each set of classes, not for each document.
        sets = per.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
        sets = sets.join(classes, "class").groupBy("set").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = cut(per.select("key", "places", "set").join(cut(sets), "set").select("key", "places", "items"))
    out = slim.join(found, "key", "left")
    places = F.coalesce("places", F.array().cast("array<struct<at:int,span:int>>"))
    return out.select("row", "n_words", _covered(places).alias("n_hit"), places.alias("places"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = decontaminate(docs.select("doc_id", "text"), items, with_text=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), {SPAN}) AS span, array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT span FROM bw
), dw AS (
  SELECT r, i, span, array_to_string(w[i:i + span - 1], ' ') AS x
  FROM (SELECT r, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, s WHERE len(w) >= span)
), hit AS (
  SELECT r, i, dw.span AS span, item FROM dw JOIN bw ON dw.span = bw.span AND dw.x = bw.x
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + span)) AS p FROM (SELECT DISTINCT r, i, span FROM hit)) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
