"""The data behind each chart, aggregated over all rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import numbers
from tabwright.functions.names import data_columns, dtype_of, q
from tabwright.operators.correlation import correlation
from tabwright.operators.counts import value_counts
from tabwright.operators.order_stats import exact_quantiles
from tabwright.operators.profile import Profile

MAX_BINS = 60
COMPARISON_BINS = 30


def missing_rates(df: DataFrame) -> DataFrame:
    """``column, missing, rate`` (percent), most missing first."""
    names = data_columns(df)
    wide = df.agg(F.count("*").alias("rows"), *[F.count_if(q(name).isNull()).alias(f"__c{i}") for i, name in enumerate(names)])
    pieces = [p for i, name in enumerate(names) for p in (F.lit(name), F.col(f"__c{i}"))]
    long = wide.select("rows", F.stack(F.lit(len(names)), *pieces).alias("column", "missing"))
    rate = F.col("missing") / F.greatest("rows", F.lit(1)) * 100
    return long.select("column", "missing", rate.alias("rate")).orderBy(F.col("missing").desc(), "column")


def bin_count(values: int) -> int:
    return min(MAX_BINS, max(1, math.ceil(math.sqrt(values))))


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return [k * step + low for k in range(bins)] + [high]


def _guess(value: Column, edges: Sequence[float]) -> Column:
    low, high, bins = edges[0], edges[-1], len(edges) - 1
    return F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(bins)).cast("int")


def _settle(value: Column, guess: Column, edges: Sequence[float]) -> Column:
    """The guessed bin moved to the one whose edges enclose the value: half-open bins, the last one closed."""
    low, bins = edges[0], len(edges) - 1
    step = (edges[-1] - low) / bins
    last = F.lit(bins - 1)
    return (
        F.when(guess > last, F.when(value < last * F.lit(step) + F.lit(low), last - 1).otherwise(last))
        .when(value < guess * F.lit(step) + F.lit(low), guess - 1)
        .when((guess < last) & (value >= (guess + 1) * F.lit(step) + F.lit(low)), guess + 1)
        .otherwise(guess)
    )


def _number(df: DataFrame, name: str) -> Column:
    return numbers.as_number(q(name), dtype_of(df, name))


def _counted(
    df: DataFrame, values: dict[str, Column], edges: dict[str, list[float]], extra: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The grid ``column, bin, low, high`` and the counts ``column, bin, n`` (per ``extra`` columns) of bins in use."""
    names = list(edges)
    # One projection per stage: each reuses the columns of the one before instead of repeating their expressions.
    valued = df.select(*extra, *[values[name].alias(f"v{i}") for i, name in enumerate(names)])
    guessed = valued.select("*", *[_guess(F.col(f"v{i}"), edges[name]).alias(f"g{i}") for i, name in enumerate(names)])
    pieces = [p for i, name in enumerate(names) for p in (F.lit(name), _settle(F.col(f"v{i}"), F.col(f"g{i}"), edges[name]))]
    long = guessed.select(*extra, F.stack(F.lit(len(names)), *pieces).alias("column", "bin")).filter("bin IS NOT NULL")
    counted = long.groupBy(*extra, "column", "bin").agg(F.count("*").alias("n"))
    grid = [(name, k, e[k], e[k + 1]) for name, e in edges.items() for k in range(len(e) - 1)]
    frame = df.sparkSession.createDataFrame(grid, "column string, bin int, low double, high double")
    return frame, counted


Extents = Mapping[str, tuple[float | None, float | None, int]]


def extents_of(df: DataFrame, columns: Sequence[str]) -> Extents:
    """Smallest and largest finite number of each column and how many there are."""
    values = df.select(*[_number(df, name).alias(f"v{i}") for i, name in enumerate(columns)])
    measures = [
        agg(f"v{i}").alias(f"{kind}{i}")
        for i in range(len(columns))
        for kind, agg in (("lo", F.min), ("hi", F.max), ("n", F.count))
    ]
    row = values.agg(*measures).first()
    return {name: (row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"]) for i, name in enumerate(columns)}


def histogram(df: DataFrame, columns: Sequence[str], extents: Extents | None = None) -> DataFrame:
    """Equal-width histograms of several columns in one pass; at most 60 bins, however the values are spread.

    ``extents`` saves the pass that finds them when a profile already knows.
    """
    known = extents or (extents_of(df, columns) if columns else {})
    edges = {name: bin_edges(known[name][0], known[name][1], bin_count(known[name][2])) for name in columns if known[name][2]}
    if not edges:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n bigint")
    grid, counted = _counted(df, {name: _number(df, name) for name in edges}, edges)
    joined = F.broadcast(grid).join(counted, ["column", "bin"], "left")
    return joined.select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def compare_histograms(
    before: DataFrame, after: DataFrame, columns: Sequence[str], extents: Sequence[Extents] | None = None, bins: int = COMPARISON_BINS
) -> DataFrame:
    """``phase, column, bin, low, high, n`` on edges both versions share; columns without numbers are left out."""
    session = before.sparkSession
    first, second = extents or (extents_of(before, columns), extents_of(after, columns))
    edges = {}
    for name in columns:
        lows = [e[name][0] for e in (first, second) if e[name][2]]
        highs = [e[name][1] for e in (first, second) if e[name][2]]
        if lows:
            edges[name] = bin_edges(min(lows), max(highs), bins)
    if not edges:
        return session.createDataFrame([], "phase string, column string, bin int, low double, high double, n bigint")
    names = {name: f"v{i}" for i, name in enumerate(edges)}
    versions = [
        version.select(F.lit(phase).alias("phase"), *[_number(version, name).alias(short) for name, short in names.items()])
        for phase, version in (("before", before), ("after", after))
    ]
    grid, counted = _counted(versions[0].unionAll(versions[1]), {n: F.col(short) for n, short in names.items()}, edges, ["phase"])
    phases = F.explode(F.array(F.lit("before"), F.lit("after"))).alias("phase")
    joined = F.broadcast(grid.select("*", phases)).join(counted, ["phase", "column", "bin"], "left")
    return joined.select("phase", "column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def compare_histogram(before: DataFrame, after: DataFrame, column: str, bins: int = COMPARISON_BINS) -> DataFrame:
    """``phase, bin, low, high, n`` of one column; empty when neither version has numbers."""
    return compare_histograms(before, after, [column], None, bins).drop("column")


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, q1, median, q3, lower, upper``: whiskers end at observations within 1.5 ranges."""
    values = {name: _number(df, name) for name in columns}
    quartiles, stats = exact_quantiles(df, {name: (v, (0.25, 0.5, 0.75)) for name, v in values.items()})
    filled = [name for name in columns if stats.counts[name]]
    schema = "column string, q1 double, median double, q3 double, lower double, upper double"
    if not filled:
        return df.sparkSession.createDataFrame([], schema)
    measures = []
    for i, name in enumerate(filled):
        q1, q3 = quartiles[name][0.25], quartiles[name][0.75]
        reach = 1.5 * (q3 - q1)
        measures += [
            F.min(F.when(values[name] >= F.lit(q1 - reach), values[name])).alias(f"l{i}"),
            F.max(F.when(values[name] <= F.lit(q3 + reach), values[name])).alias(f"u{i}"),
        ]
    ends = df.agg(*measures).first()
    rows = [(n, *(quartiles[n][f] for f in (0.25, 0.5, 0.75)), ends[f"l{i}"], ends[f"u{i}"]) for i, n in enumerate(filled)]
    return df.sparkSession.createDataFrame(rows, schema)


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """All rows where both columns are finite numbers."""
    pairs = df.select(_number(df, x).alias("x"), _number(df, y).alias("y"))
    return pairs.filter("x IS NOT NULL AND y IS NOT NULL")


def report_tables(profile: Profile) -> dict[str, DataFrame]:
    """The tables of one version's report: as many as there are kinds of chart, however many columns.

    ``missing``, ``correlation`` (two numeric columns or more), and the distributions of all numeric,
    date and categorical columns, each with a ``column`` field.
    """
    df, roles = profile.df, profile.roles
    shown = [name for name in profile.names if roles[name] not in ("id", "ignore")]
    numeric = [name for name in shown if roles[name] == "numeric"]
    dates = [name for name in shown if roles[name] == "datetime" and numbers.is_temporal(dtype_of(df, name))]
    labels = [name for name in shown if name not in numeric and name not in dates]
    tables = {"missing": _missing_table(profile)}
    if len(numeric) >= 2:
        tables["correlation"] = correlation(df, roles)
    if numeric:
        tables["numeric"] = histogram(df, numeric, profile.extents)
    if dates:
        tables["datetime"] = _days(df, dates)
    if labels:
        tables["category"] = value_counts(df, labels).orderBy("column", "n", "value")
    return tables


def _missing_table(profile: Profile) -> DataFrame:
    rows = sorted(profile.base_columns, key=lambda entry: (-entry["missing"], entry["column"]))
    schema = "column string, missing bigint, rate double"
    return profile.df.sparkSession.createDataFrame([(e["column"], e["missing"], float(e["missing_pct"])) for e in rows], schema)


def _days(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pieces = [piece for name in columns for piece in (F.lit(name), F.to_date(q(name)))]
    long = df.select(F.stack(F.lit(len(columns)), *pieces).alias("column", "day")).filter("day IS NOT NULL")
    return long.groupBy("column", "day").agg(F.count("*").alias("n")).orderBy("column", "day")


def comparison_table(before: Profile, after: Profile) -> DataFrame | None:
    """Shared-edge histograms of every column that is numeric in both versions."""
    both = [name for name in before.names if name in after.names and before.roles[name] == after.roles[name] == "numeric"]
    if not both:
        return None
    return compare_histograms(before.df, after.df, both, (before.extents, after.extents))
