"""Imputation, scaling and category encoding, fitted on one set of rows and reapplied to any other."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.errors import TableError
from tabwright.functions import numbers
from tabwright.functions.names import ROW_ID, dtype_of, q
from tabwright.operators.counts import distinct_counts, typed_counts
from tabwright.operators.lookup import attach
from tabwright.operators.order_stats import exact_quantiles
from tabwright.session import Scratch

# The label of missing categories, the prefix of real ones, and the name of the shared column.
MISSING_LABEL = "__MISSING__"
VALUE_PREFIX = "value:"
INFREQUENT_NAME = "infrequent_sklearn"
NEGLIGIBLE_SCALE = 10 * sys.float_info.epsilon


@dataclass
class NumberFit:
    """How one numeric feature is filled and scaled: ``(x or fill - center) / scale``."""

    name: str
    fill: float
    center: float = 0.0
    scale: float = 1.0
    empty: bool = False


@dataclass
class CategoryFit:
    """Categories of one feature in code order; rarer ones seen in training share the code after them."""

    name: str
    frequent: list[str]
    rare: int = 0
    empty: bool = False

    @property
    def width(self) -> int:
        return len(self.frequent) + (1 if self.rare else 0)


def value_text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    return column.cast("string")


def category_text(df: DataFrame, name: str) -> Column:
    """Prefixed, so that no real value can equal the label of missing ones."""
    column = q(name)
    text = F.concat(F.lit(VALUE_PREFIX), value_text(column, dtype_of(df, name)))
    return F.when(column.isNull(), F.lit(MISSING_LABEL)).otherwise(text)


def invalid_number(df: DataFrame, name: str) -> Column:
    return q(name).isNotNull() & numbers.as_number(q(name), dtype_of(df, name)).isNull()


# -- numbers ---------------------------------------------------------------------------------------


def fit_numbers(train: DataFrame, names: Sequence[str], imputer: str, scaler: str) -> list[NumberFit]:
    if not names:
        return []
    train = train.select(*[numbers.as_number(q(name), dtype_of(train, name)).alias(f"x{i}") for i, name in enumerate(names)])
    value = {name: F.col(f"x{i}") for i, name in enumerate(names)}
    measures = []
    for i, name in enumerate(names):
        measures += [
            F.count(value[name]).alias(f"n{i}"),
            F.count_if(value[name].isNull()).alias(f"gaps{i}"),
            F.avg(value[name]).alias(f"mean{i}"),
            F.var_pop(value[name]).alias(f"var{i}"),
            F.min(value[name]).alias(f"min{i}"),
            F.max(value[name]).alias(f"max{i}"),
        ]
    quartiles = {}
    fractions = (0.25, 0.5, 0.75) if scaler == "robust" else (0.5,)
    if scaler == "robust" or imputer == "median":
        quartiles, stats = exact_quantiles(train, {name: (value[name], fractions) for name in names}, measures)
        row = stats.measures
    else:
        row = train.agg(*measures).first()
    fits = []
    for i, name in enumerate(names):
        empty = not row[f"n{i}"]
        if empty or imputer == "zero":
            fill = 0.0
        else:
            fill = row[f"mean{i}"] if imputer == "mean" else quartiles[name][0.5]
        fits.append(NumberFit(name, fill, empty=empty))
    if scaler == "robust":
        _refit_quartiles(train, fits, value, quartiles, row)
    for i, fit in enumerate(fits):
        count, gaps = row[f"n{i}"], row[f"gaps{i}"]
        low, high = _extent(row[f"min{i}"], row[f"max{i}"], fit.fill, gaps)
        if scaler == "standard":
            mean, variance = _filled_moments(count, row[f"mean{i}"] or 0.0, row[f"var{i}"] or 0.0, gaps, fit.fill)
            fit.center, fit.scale = mean, math.sqrt(variance) if low != high else 1.0
        elif scaler == "minmax":
            fit.center, fit.scale = low, _usable(high - low)
        elif scaler == "robust":
            fit.center, fit.scale = quartiles[fit.name][0.5], _usable(quartiles[fit.name][0.75] - quartiles[fit.name][0.25])
    return fits


def _usable(scale: float) -> float:
    return scale if scale >= NEGLIGIBLE_SCALE else 1.0


def _extent(low, high, fill, gaps) -> tuple[float, float]:
    present = [v for v in (low, high) if v is not None] + ([fill] if gaps or low is None else [])
    return min(present), max(present)


def _filled_moments(count: int, mean: float, variance: float, gaps: int, fill: float) -> tuple[float, float]:
    """Mean and population variance once every gap holds the fill value."""
    total = count + gaps
    if not total:
        return fill, 0.0
    merged = (count * mean + gaps * fill) / total
    squares = count * (variance + (mean - merged) ** 2) + gaps * (fill - merged) ** 2
    return merged, squares / total


def _refit_quartiles(train: DataFrame, fits: Sequence[NumberFit], value: Mapping[str, Column], quartiles: dict, row) -> None:
    """Quartiles of the filled columns; only columns with gaps need another look."""
    gaps = {fit.name: fit for i, fit in enumerate(fits) if row[f"gaps{i}"]}
    if gaps:
        wanted = {name: (F.coalesce(value[name], F.lit(fit.fill)), (0.25, 0.5, 0.75)) for name, fit in gaps.items()}
        quartiles.update(exact_quantiles(train, wanted)[0])


# -- categories ------------------------------------------------------------------------------------


def fit_categories(
    train: DataFrame, names: Sequence[str], limit: int, scratch: Scratch
) -> tuple[list[CategoryFit], DataFrame | None]:
    """Code order per feature, and the rare training values (``column, value, n``) if a feature has too many.

    Above the limit the ``limit - 1`` most frequent values keep their own code; among equals the
    larger value does.
    """
    if not names:
        return [], None
    labelled = train.select(*[category_text(train, name).alias(name) for name in names])
    counts = typed_counts(labelled, names)
    # Sizes and leading values come from one query, so the counts are shuffled once.
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").desc())
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    distinct = distinct_counts(counts).select("column", F.lit(None).cast("string").alias("value"), F.col("unique").alias("n"), F.lit(0).alias("rank"))
    found = distinct.unionAll(ranked.select("column", "value", "n", "rank")).collect()
    sizes = {row["column"]: row["n"] for row in found if row["rank"] == 0}
    crowded = [name for name in names if sizes.get(name, 0) > limit]
    kept: dict[str, list[str]] = {name: [] for name in names}
    for row in found:
        if row["rank"] and (row["column"] not in crowded or row["rank"] < limit):
            kept[row["column"]].append(row["value"])
    fits = [
        CategoryFit(name, sorted(kept[name]), max(sizes.get(name, 0) - len(kept[name]), 0), kept[name] == [MISSING_LABEL])
        for name in names
    ]
    if not crowded:
        return fits, None
    frequent = F.lit(False)
    for fit in fits:
        if fit.rare:
            frequent = frequent | ((F.col("column") == fit.name) & F.col("value").isin(fit.frequent))
    return fits, scratch.table(counts.filter(F.col("column").isin(crowded) & ~frequent).select("column", "value", "n"))


# -- the fitted whole ------------------------------------------------------------------------------


@dataclass
class FittedFeatures:
    """Everything learned from the training rows. ``transform`` is row-local and takes any frame."""

    numbers: list[NumberFit]
    categories: list[CategoryFit]
    encoding: str
    numeric_errors: str
    rare: DataFrame | None = field(default=None, repr=False)

    @property
    def names(self) -> list[str]:
        names = [f"numeric__{fit.name}" for fit in self.numbers]
        for fit in self.categories:
            if self.encoding == "ordinal":
                names.append(f"category__{fit.name}")
                continue
            names += [f"category__{fit.name}_{value}" for value in fit.frequent]
            if fit.rare:
                names.append(f"category__{fit.name}_{INFREQUENT_NAME}")
        return names

    def scaled(self, df: DataFrame, fit: NumberFit) -> Column:
        dtype = dtype_of(df, fit.name)
        if numbers.is_temporal(dtype):
            raise TableError(f"{fit.name!r} is a date or time; derive a numeric feature from it")
        value = numbers.as_number(q(fit.name), dtype)
        if self.numeric_errors == "raise":
            message = F.lit(f"{fit.name!r} holds a value that is not a finite number")
            value = F.when(q(fit.name).isNotNull() & value.isNull(), F.raise_error(message).cast("double")).otherwise(value)
        return (F.coalesce(value, F.lit(fit.fill)) - F.lit(fit.center)) / F.lit(fit.scale)

    def flat(self, df: DataFrame) -> DataFrame:
        """Adds ``n<i>`` (scaled numbers) and ``c<i>`` (category codes); unseen is -1, or the width for one-hot."""
        absent = sorted({fit.name for fit in (*self.numbers, *self.categories)} - set(df.columns))
        if absent:
            raise TableError(f"feature columns are absent: {absent}")
        out = df.select("*", *[self.scaled(df, fit).alias(f"n{i}") for i, fit in enumerate(self.numbers)])
        spread = q(ROW_ID) if ROW_ID in df.columns else F.struct(*[q(name) for name in df.columns])
        for i, fit in enumerate(self.categories):
            text = category_text(df, fit.name)
            code = F.lit(None).cast("int")
            if fit.frequent:
                pairs = [piece for k, value in enumerate(fit.frequent) for piece in (F.lit(value), F.lit(k))]
                code = F.try_element_at(F.create_map(*pairs), text)
            unseen = F.lit(-1 if self.encoding == "ordinal" else fit.width)
            if fit.rare:
                table = self.rare.filter(F.col("column") == fit.name).select(
                    F.col("value").alias("key"), F.lit(len(fit.frequent)).alias("payload")
                )
                out = out.select("*", code.alias("__code"))
                out = attach(out, F.when(F.col("__code").isNull(), text), table, fit.rare, "__rare", spread)
                out = out.select("*", F.coalesce("__code", "__rare", unseen).alias(f"c{i}")).drop("__code", "__rare")
            else:
                out = out.select("*", F.coalesce(code, unseen).alias(f"c{i}"))
        return out

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """The frame with a sparse feature vector added, numeric features first."""
        flat = self.flat(df)
        inputs = [f"n{i}" for i in range(len(self.numbers))]
        codes = [f"c{i}" for i in range(len(self.categories))]
        extra: list[str] = []
        if self.encoding == "ordinal":
            inputs += codes
        elif codes:
            # The width travels as column metadata, so the encoder needs no pass over the data.
            for code, fit in zip(codes, self.categories):
                nominal = {"ml_attr": {"type": "nominal", "num_vals": fit.width}}
                flat = flat.withColumn(code, F.col(code).cast("double").alias(code, metadata=nominal))
            extra = [f"v{i}" for i in range(len(codes))]
            encoder = OneHotEncoder(inputCols=codes, outputCols=extra, handleInvalid="keep", dropLast=True)
            flat = encoder.fit(flat).transform(flat)
            inputs += extra
        assembled = VectorAssembler(inputCols=inputs, outputCol=output).transform(flat)
        return assembled.drop(*inputs, *codes, *extra)

    def table(self, spark: SparkSession) -> DataFrame:
        """``feature, statistic, value, label``: fill, center and scale of numbers, codes of categories."""
        rows = [(f.name, s, float(getattr(f, s)), None) for f in self.numbers for s in ("fill", "center", "scale")]
        rows += [(f.name, "code", float(k), value) for f in self.categories for k, value in enumerate(f.frequent)]
        return spark.createDataFrame(rows, "feature string, statistic string, value double, label string")

    def save(self, path: str, spark: SparkSession) -> None:
        plain = {
            "numbers": [asdict(f) for f in self.numbers],
            "categories": [asdict(f) for f in self.categories],
            "encoding": self.encoding,
            "numeric_errors": self.numeric_errors,
        }
        spark.createDataFrame([(json.dumps(plain, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/parameters")
        if self.rare is not None:
            self.rare.write.parquet(f"{path}/rare_values")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> FittedFeatures:
        plain = json.loads(spark.read.text(f"{path}/parameters").first()["value"])
        categories = [CategoryFit(**f) for f in plain["categories"]]
        rare = spark.read.parquet(f"{path}/rare_values") if any(f.rare for f in categories) else None
        return cls([NumberFit(**f) for f in plain["numbers"]], categories, plain["encoding"], plain["numeric_errors"], rare)


