"""Column statistics with bounded memory: count/min/max, exact and approximate
quantiles, and the mode.

Exact quantiles.  Spark's exact ``percentile`` keeps a map of every distinct
value and, for a global aggregate, merges all maps in one task; on large data
that map is unbounded.  Here the exact order statistic is found by narrowing a
value range instead:

1. one aggregate gives count, min and max per column (callers may pass these in);
2. while the range that holds a wanted rank still has more than
   ``exact_limit`` rows, one distributed aggregate builds a histogram of
   ``buckets`` equal-width buckets (count, min, max per bucket) for every open
   range at once; a running count over each range's buckets (a window
   partitioned by range, at most ``buckets`` rows per partition) finds the
   bucket that holds the rank, and that bucket's [min, max] becomes the range;
3. a range with few rows is grouped into (value, count) pairs and a running
   count picks the value at the rank.

Only the chosen buckets or values (a few rows per wanted rank) reach the
driver.  Equal values always land in the same bucket, so a value that holds a
third of all rows is resolved as soon as its bucket has min = max.  Bucketing
is a monotone function of the value, so bucket order is value order.

Quantiles interpolate linearly between the two neighbouring order statistics
(position p * (n - 1)), skipping NULL and NaN, like pandas and SQL
``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.columns import is_floating
from riskspark.session import cut_lineage

DEFAULT_BUCKETS = 1024
DEFAULT_EXACT_LIMIT = 250_000


def value_expr(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into NULL."""
    c = F.col(name)
    if is_floating(df.schema[name].dataType):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def count_min_max(df: DataFrame, cols: list[str],
                  values: dict[str, Column] | None = None) -> dict[str, tuple[int, float | None, float | None]]:
    """One aggregate: non-missing count, min and max of each numeric column."""
    if not cols:
        return {}
    xs = values or {c: value_expr(df, c) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(xs[c]).alias(f"n{i}"), F.min(xs[c]).alias(f"lo{i}"), F.max(xs[c]).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (int(row[f"n{i}"]), row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


@dataclass
class _Range:
    col: str
    lo: float
    hi: float
    offset: int          # rows of the column strictly below ``lo``
    count: int           # rows with lo <= value <= hi
    ranks: set[int] = field(default_factory=set)   # 0-based ranks wanted here


def _explode(df: DataFrame, entries: list[Column]) -> DataFrame:
    # Values outside every open range go before the rows are multiplied.
    return df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")


def _rank_filter(ranges: list[_Range]) -> Column:
    """Rows (r, n, upto) whose running-count interval [upto-n, upto) holds a wanted rank."""
    cond = F.lit(False)
    for j, rg in enumerate(ranges):
        for k in sorted(rg.ranks):
            local = k - rg.offset
            cond = cond | ((F.col("r") == j) & (F.col("upto") - F.col("n") <= local)
                           & (F.col("upto") > local))
    return cond


def _running(frame: DataFrame, order_col: str) -> DataFrame:
    w = Window.partitionBy("r").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn("upto", F.sum("n").over(w))


def _histogram_round(df: DataFrame, xs: dict[str, Column], ranges: list[_Range],
                     buckets: int, weight: Column) -> list[_Range]:
    entries = []
    for j, rg in enumerate(ranges):
        x = xs[rg.col]
        half_lo = rg.lo * 0.5
        width = (rg.hi * 0.5 - half_lo) / buckets
        b = F.least(F.lit(buckets - 1),
                    F.floor((x * F.lit(0.5) - F.lit(half_lo)) / F.lit(width))).cast("int")
        entries.append(F.when(x.between(F.lit(rg.lo), F.lit(rg.hi)),
                              F.struct(F.lit(j).alias("r"), b.alias("b"), x.alias("x"), weight.alias("w"))))
    hist = (_explode(df, entries)
            .groupBy("r", "b")
            .agg(F.sum("w").alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx")))
    picked = _running(hist, "b").where(_rank_filter(ranges)).collect()
    out: dict[tuple[int, int], _Range] = {}
    for row in picked:
        rg = ranges[row["r"]]
        below = rg.offset + int(row["upto"]) - int(row["n"])
        for k in rg.ranks:
            if below <= k < rg.offset + int(row["upto"]):
                key = (row["r"], row["b"])
                if key not in out:
                    out[key] = _Range(rg.col, float(row["mn"]), float(row["mx"]), below, int(row["n"]))
                out[key].ranks.add(k)
    return list(out.values())


def _exact_round(df: DataFrame, xs: dict[str, Column], ranges: list[_Range], weight: Column) -> dict[tuple[str, int], float]:
    entries = [F.when(xs[rg.col].between(F.lit(rg.lo), F.lit(rg.hi)),
                      F.struct(F.lit(j).alias("r"), xs[rg.col].alias("x"), weight.alias("w")))
               for j, rg in enumerate(ranges)]
    counts = _explode(df, entries).groupBy("r", "x").agg(F.sum("w").alias("n"))
    picked = _running(counts, "x").where(_rank_filter(ranges)).collect()
    found: dict[tuple[str, int], float] = {}
    for row in picked:
        rg = ranges[row["r"]]
        lo_rank = rg.offset + int(row["upto"]) - int(row["n"])
        for k in rg.ranks:
            if lo_rank <= k < rg.offset + int(row["upto"]):
                found[(rg.col, k)] = float(row["x"])
    return found


def order_statistics(df: DataFrame, ranks: dict[str, set[int]],
                     stats: dict[str, tuple[int, float | None, float | None]] | None = None,
                     values: dict[str, Column] | None = None,
                     buckets: int = DEFAULT_BUCKETS,
                     exact_limit: int = DEFAULT_EXACT_LIMIT, weight: Column | None = None) -> dict[tuple[str, int], float]:
    """Exact value at each 0-based rank (ascending, missing skipped) per column; a row counts ``weight`` times.

    Infinite values take the first and last ranks; the rounds narrow the finite
    part, and each makes its ranges shorter, so they come to an end.
    ``buckets`` and ``exact_limit`` decide how many rounds there are, never the values."""
    cols = [c for c in ranks if ranks[c]]
    xs = values or {c: value_expr(df, c) for c in cols}
    if stats is None:
        stats = count_min_max(df, cols, xs)
    weight = F.lit(1).cast("bigint") if weight is None else weight
    finite = _finite_parts(df, xs, {c: stats[c] for c in cols}, weight)
    pending = []
    found: dict[tuple[str, int], float] = {}
    for c in cols:
        n = int(stats[c][0])
        below, count, lo, hi = finite[c]
        wanted = {k for k in ranks[c] if 0 <= k < n}
        found.update({(c, k): -math.inf for k in wanted if k < below})
        found.update({(c, k): math.inf for k in wanted if k >= below + count})
        inside = {k for k in wanted if below <= k < below + count}
        if inside:
            pending.append(_Range(c, float(lo), float(hi), below, count, inside))
    while pending:
        exact, hist = [], []
        for rg in pending:
            if rg.lo == rg.hi:
                for k in rg.ranks:
                    found[(rg.col, k)] = rg.lo
            elif rg.count <= exact_limit or (rg.hi * 0.5 - rg.lo * 0.5) / buckets == 0.0:
                exact.append(rg)
            else:
                hist.append(rg)
        if exact:
            found.update(_exact_round(df, xs, exact, weight))
        pending = _histogram_round(df, xs, hist, buckets, weight) if hist else []
    return found


def _finite_parts(df: DataFrame, xs: dict[str, Column], stats: dict, weight: Column) -> dict[str, tuple[int, int, float, float]]:
    """Per column: rows at minus infinity, finite rows, their min and max; reads the
    table again only for columns that hold an infinity."""
    out = {c: (0, int(n), lo, hi) for c, (n, lo, hi) in stats.items()}
    odd = [c for c, (n, lo, hi) in stats.items() if n and (math.isinf(lo) or math.isinf(hi))]
    if odd:
        aggs = []
        for i, c in enumerate(odd):
            x = xs[c]
            real = F.when(F.abs(x) < math.inf, x)
            aggs += [F.coalesce(F.sum(F.when(x == -math.inf, weight)), F.lit(0)).alias(f"b{i}"),
                     F.coalesce(F.sum(F.when(real.isNotNull(), weight)), F.lit(0)).alias(f"n{i}"),
                     F.min(real).alias(f"lo{i}"), F.max(real).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        out.update({c: (row[f"b{i}"], row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(odd)})
    return out


def _positions(n: int, probs: list[float]) -> list[tuple[float, int, int]]:
    out = []
    for p in probs:
        pos = p * (n - 1)
        lo = int(math.floor(pos))
        out.append((pos, lo, min(lo + 1, n - 1) if pos > lo else lo))
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact",
              accuracy: int = 10_000,
              stats: dict[str, tuple[int, float | None, float | None]] | None = None,
              values: dict[str, Column] | None = None,
              buckets: int = DEFAULT_BUCKETS,
              exact_limit: int = DEFAULT_EXACT_LIMIT) -> dict[str, list[float | None]]:
    """Quantiles of several numeric columns; None for a column with no values.

    ``method='exact'`` interpolates linearly like SQL ``quantile_cont``;
    ``method='approx'`` uses ``percentile_approx`` (one pass, a bounded
    sketch, returns observed values, rank error about n / accuracy);
    ``method='bracketed'`` is exact in two passes (``bracketed_quantiles``)."""
    if not cols:
        return {}
    xs = values or {c: value_expr(df, c) for c in cols}
    if method == "approx":
        row = df.agg(*[F.percentile_approx(xs[c], list(probs), accuracy).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: ([float(v) for v in row[f"q{i}"]] if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    if method == "bracketed":
        return bracketed_quantiles(df, cols, probs, values=xs, accuracy=accuracy)
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    if stats is None:
        stats = count_min_max(df, cols, xs)
    ranks = {}
    for c in cols:
        n = stats[c][0]
        ranks[c] = {k for _, lo, hi in _positions(n, probs) for k in (lo, hi)} if n > 0 else set()
    found = order_statistics(df, ranks, stats=stats, values=xs, buckets=buckets, exact_limit=exact_limit)
    return {c: _interpolate(stats[c][0], probs, lambda k, c=c: found[(c, k)]) for c in cols}


def bracketed_quantiles(df: DataFrame, cols: list[str], probs: list[float], values: dict[str, Column] | None = None,
                        accuracy: int = 10_000, margin: float | None = None,
                        missed: list[str] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles in two passes over the table.

    1. One mergeable sketch per column gives, for each wanted rank, a bracket of two values
       ``margin`` (a share of the rows) to either side of it.
    2. A second pass counts the rows below each bracket and, by value, those inside, a share of about 2 * margin
       per rank, into a table in the shared folder; the rank's place inside is known then and is looked up there.

    A rank is proved by the counts: it lies inside iff below <= rank < below + inside.  Columns with a
    rank that misses its bracket take the rounds of ``order_statistics`` instead (``missed`` collects their names), so the
    sketch's error decides the work and never the value."""
    if not cols:
        return {}
    xs = values or {c: value_expr(df, c) for c in cols}
    margin = 2.0 / accuracy if margin is None else margin
    edges = [min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(xs[c]).alias(f"n{i}"), F.percentile_approx(xs[c], edges, accuracy).alias(f"e{i}")]
    row = df.agg(*aggs).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    brackets = [(c, j, *sorted(row[f"e{i}"][2 * j:2 * j + 2])) for i, c in enumerate(cols) if counts[c] for j in range(len(probs))]
    found: dict[tuple[str, int], float] = {}
    late: list[str] = []
    if brackets:
        # Below a bracket a row adds to one count, inside to its value's count: partial sums keep both slim.
        entries = []
        for r, (c, _, lo, hi) in enumerate(brackets):
            one = lambda x, r=r: F.struct(F.lit(r).alias("r"), x.alias("x"))
            entries.append(F.when(xs[c] < lo, one(F.lit(None).cast("double"))).when(xs[c] <= hi, one(xs[c])))
        near = cut_lineage(_explode(df, entries).groupBy("r", "x").agg(F.count(F.lit(1)).alias("n")))
        sums = {row["r"]: row for row in near.groupBy("r").agg(
            F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0)).alias("here"),
            F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}                # a row per bracket
        stats, ranks, names = {}, {}, {}
        for r, (c, j, _, _) in enumerate(brackets):
            seen, (_, lo, hi) = sums.get(r), _positions(counts[c], [probs[j]])[0]
            if seen and seen["below"] <= lo and hi < seen["below"] + seen["here"]:
                stats[f"r{r}"] = (seen["here"], seen["lo"], seen["hi"])
                ranks[f"r{r}"] = {lo - seen["below"], hi - seen["below"]}
                names.update({(f"r{r}", k - seen["below"]): (c, k) for k in (lo, hi)})
            elif c not in late:
                late.append(c)
        parts = {f"r{r}": F.when(F.col("r") == r, F.col("x")) for r in range(len(brackets))}
        got = order_statistics(near, ranks, stats=stats, values=parts, weight=F.col("n")) if ranks else {}
        found = {names[key]: v for key, v in got.items()}
    out = {c: _interpolate(counts[c], probs, lambda k, c=c: found[(c, k)]) for c in cols if c not in late}
    if late:
        out.update(quantiles(df, late, probs, values={c: xs[c] for c in late}))
        if missed is not None:
            missed.extend(late)
    return {c: out[c] for c in cols}


def _interpolate(n: int, probs: list[float], value: Callable[[int], float]) -> list[float | None]:
    """Quantiles of n values from the values at their ranks."""
    if n == 0:
        return [None] * len(probs)
    vals = []
    for pos, lo, hi in _positions(n, probs):
        a, b = value(lo), value(hi)
        d = pos - lo
        if a == b or lo == hi:
            vals.append(a)
        elif math.isinf(a) or math.isinf(b):
            vals.append((1.0 - d) * a + d * b)
        else:
            # (1 - d) * a + d * b with the sum rounded once, as SQL engines compute it.
            vals.append(math.fma(1.0 - d, a, b * d))
    return vals


def medians_and_quartiles(df: DataFrame, medians: list[str], quartiles: list[str], filled: dict[str, tuple[int, int]],
                          stats: dict[str, tuple[int, float | None, float | None]]) \
        -> tuple[dict[str, float], dict[str, list[float | None]]]:
    """Medians of columns with missing values, and quartiles of columns after these
    are filled with their medians, from one search for ranks.

    ``filled``: (present, missing) of the filled columns.  Filling n present values
    with ``miss`` copies of their median puts the copies behind the first n // 2 values, so the
    rank k of the filled column is raw rank k before the copies, the median in
    them, and raw rank k - miss behind them."""
    ranks: dict[str, set[int]] = {}
    for c in medians:
        ranks.setdefault(c, set()).update(k for _, lo, hi in _positions(stats[c][0], [0.5]) for k in (lo, hi))

    def raw(c: str, k: int) -> int | None:
        n, miss = filled.get(c, (stats[c][0], 0))
        return k if k < n // 2 or not miss else k - miss if k >= n // 2 + miss else None

    sizes = {c: sum(filled[c]) if c in filled else stats[c][0] for c in quartiles}
    for c in quartiles:
        if sizes[c]:
            wanted = {raw(c, k) for _, lo, hi in _positions(sizes[c], [0.25, 0.75]) for k in (lo, hi)}
            ranks.setdefault(c, set()).update(k for k in wanted if k is not None)
    found = order_statistics(df, ranks, stats=stats) if ranks else {}
    middle = {c: _interpolate(stats[c][0], [0.5], lambda k, c=c: found[(c, k)])[0] for c in medians}

    def value(c: str, k: int) -> float:
        r = raw(c, k)
        return middle[c] if r is None else found[(c, r)]

    return middle, {c: _interpolate(sizes[c], [0.25, 0.75], lambda k, c=c: value(c, k)) for c in quartiles}


def modes(df: DataFrame, cols: list[str]) -> dict[str, tuple[str | None, int]]:
    """Most frequent non-missing value of each column as text, ties to the
    smallest value; returns (value, count), (None, 0) for an all-missing column.

    (column, value) counts are a distributed, map-side combined aggregate;
    the pick per column keeps one (-count, value) struct per partition, so a
    value holding a third of all rows costs nothing extra."""
    if not cols:
        return {}
    entries = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols]
    counts = (df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
              .where(F.col("v").isNotNull())
              .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("m"))
    rows = best.select("k", F.col("m.v").alias("v"), (-F.col("m.neg")).alias("n")).collect()
    out = {c: (None, 0) for c in cols}
    for r in rows:
        out[r["k"]] = (r["v"], int(r["n"]))
    return out


def frequent_modes(df: DataFrame, cols: list[str], candidates: int = 100, tracked: int = 10_000,
                   missed: list[str] | None = None) -> dict[str, tuple[str | None, int]]:
    """The result of ``modes`` without shuffling every distinct value.

    1. One mergeable heavy-hitter summary per column (``approx_top_k``: at most ``tracked`` values with counts, too
       low by at most 2.625 / tracked of the rows) leaves ``candidates`` values.
    2. A second pass counts those exactly; only their (column, value) pairs are shuffled.

    The best candidate is the mode if no value that is not a candidate can have as many rows: a value
    that is not in the summary has at most 5.25 / tracked of them, and one that is in it but not among the
    candidates at most the least candidate's estimate.  Columns for which this proof fails (none of
    their values is frequent) are counted whole by ``modes`` (``missed`` collects their names)."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        text = F.col(f"`{c}`").cast("string")
        aggs += [F.count(text).alias(f"n{i}"),
                 F.expr(f"approx_top_k(CAST(`{c}` AS STRING), {candidates}, {tracked}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"t{i}")]
    row = df.agg(*aggs).first()
    tops = {c: [(t["item"], t["count"]) for t in row[f"t{i}"] or () if t["item"] is not None] for i, c in enumerate(cols)}
    entries = [F.when(F.col(f"`{c}`").cast("string").isin([v for v, _ in tops[c]]),
                      F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v"))) for c in cols if tops[c]]
    exact: dict[str, list[tuple[int, str]]] = {c: [] for c in cols}
    if entries:
        pairs = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
        for r in pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect():      # candidates only
            exact[r["k"]].append((-int(r["n"]), r["v"]))
    out: dict[str, tuple[str | None, int]] = {}
    late = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        least = min((k for _, k in tops[c]), default=0) if len(tops[c]) >= candidates else 0
        best = min(exact[c], default=(0, None))
        if not n:
            out[c] = (None, 0)
        elif -best[0] > max(5.25 * n / tracked, least):
            out[c] = (best[1], -best[0])
        else:
            late.append(c)
    out.update(modes(df, late))
    if missed is not None:
        missed.extend(late)
    return {c: out[c] for c in cols}
