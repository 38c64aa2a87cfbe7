"""Profiles, order statistics, ranks, correlation and chart aggregates against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright import TableError
from tabwright.operators import charts
from tabwright.operators.correlation import correlation, pearson, spearman, with_ranks
from tabwright.operators.counts import duplicate_rows, modes, top_values, value_counts
from tabwright.operators.order_stats import exact_quantiles
from tabwright.operators.profile import Profile, compare_profiles, infer_roles
from tabwright.operators.roles import roles_after
from tabwright.plans.pipeline import run_pipeline
from tabwright.plans.report import report
from tabwright.session import Scratch
from tabwright.sources.table import identified


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest spread over many magnitudes, some missing."""
    rng = np.random.default_rng(3)
    n = 6000
    x = np.where(rng.random(n) < 0.34, 7.0, rng.lognormal(0, 4, n))
    y = np.where(rng.random(n) < 0.1, np.nan, x * 0.5 + rng.normal(0, 1, n))
    z = rng.integers(-5, 5, n).astype(float)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "z": z, "flat": 2.5, "void": np.nan})
    return pdf, identified(spark.createDataFrame(pdf).repartition(5, "id"), "id").drop("id")


@pytest.mark.parametrize("limits", [{}, {"accuracy": 20, "budget": 12}, {"accuracy": 15, "budget": 1}])
def test_quantiles_are_exact_whatever_the_budget(skewed, limits):
    pdf, df = skewed
    fractions = (0.01, 0.25, 0.5, 0.75, 0.999)
    found, stats = exact_quantiles(df, {c: (F.nanvl(F.col(c), F.lit(None)), fractions) for c in ("x", "y", "z", "void")}, **limits)
    for name in ("x", "y", "z"):
        for fraction in fractions:
            assert found[name][fraction] == pytest.approx(pdf[name].quantile(fraction), rel=1e-12), (name, fraction)
    assert set(found["void"].values()) == {None} and stats.counts["y"] == pdf.y.count()


@pytest.mark.parametrize("bucket_rows", [200_000, 300])
def test_average_ranks(spark, skewed, bucket_rows, monkeypatch):
    import tabwright.operators.lookup as lookup

    pdf, df = skewed
    if bucket_rows < 1000:
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 5)
    ranked = with_ranks(df.select("_row_id", "x", "y", "void"), ["x", "y", "void"], Scratch(spark), bucket_rows).toPandas().set_index("_row_id").sort_index()
    for name in ("x", "y"):
        expected = pdf.set_index("id")[name].rank()
        np.testing.assert_allclose(ranked["r" + name].astype(float), expected)
    assert ranked["rvoid"].isna().all()


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_matches_pandas(spark, skewed, method):
    pdf, df = skewed
    expected = pdf[["x", "y", "z", "flat", "void"]].corr(method=method, min_periods=3)
    names = ["x", "y", "z", "flat", "void"]
    clean = df.select("_row_id", *[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in names])
    runs = [pearson(clean, names)] if method == "pearson" else [spearman(clean, names)]
    for run in runs:
        found = {(r["x"], r["y"]): r["r"] for r in run.collect()}
        assert len(found) == 15
        for (x, y), r in found.items():
            if np.isnan(expected.loc[x, y]):
                assert r is None, (x, y)
            else:
                assert r == pytest.approx(expected.loc[x, y], abs=1e-9)


def test_different_missing_patterns_rank_on_shared_rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.integers(0, 9, (200, 4)).astype(float), columns=list("abcd"))
    pdf.loc[::3, "a"] = np.nan
    pdf.loc[::3, "b"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    df = identified(spark.createDataFrame(pdf).coalesce(2))
    expected = pdf.corr(method="spearman", min_periods=3)
    for row in spearman(df, list("abcd")).collect():
        assert row["r"] == pytest.approx(expected.loc[row["x"], row["y"]], abs=1e-9)


def test_bounded_correlation_is_repeatable(spark):
    df = identified(spark.range(100).selectExpr(*[f"(id * {i + 1}) % 37 AS x{i}" for i in range(40)]).coalesce(1))
    first, second = (sorted(map(tuple, correlation(df, max_rows=10, max_columns=3).collect())) for _ in range(2))
    assert first == second and len(first) == 6 and {row[3] for row in first} == {10}
    assert correlation(df).count() == 40 * 41 // 2
    with pytest.raises(TableError):
        correlation(df, method="kendall")


def test_profile_counts_and_roles(spark):
    df = spark.createDataFrame([(i, i, 2 * i, None) for i in range(1, 5)], "id int, x int, y int, z double")
    profile = Profile(identified(df))
    assert profile.overview["missing_cells"] == 4 and profile.overview["missing_pct"] == 25
    assert profile.roles == {"id": "id", "x": "numeric", "y": "numeric", "z": "numeric"}
    assert {(r["x"], r["y"]): r["r"] for r in correlation(identified(df)).collect()}[("x", "y")] == pytest.approx(1)
    numeric = {e["column"]: e for e in profile.numeric}
    assert numeric["x"]["median"] == 2.5 and numeric["z"]["mean"] is None and numeric["z"]["count"] == 0
    assert profile.as_dict()["columns"][0]["stats"]["top"][0] == {"value": "1", "count": 1}


def test_roles(spark):
    df = spark.range(1000).selectExpr(
        "concat('v', id) AS many", "concat('v', id % 40) AS few", "id % 2 = 0 AS flag", "timestamp('2026-01-01') AS day", "'1' AS sbd"
    )
    assert infer_roles(identified(df)) == {"many": "text", "few": "category", "flag": "category", "day": "datetime", "sbd": "id"}
    # A given role needs no scan, so even a column that cannot be computed is accepted.
    broken = identified(spark.range(1).selectExpr("raise_error('scanned') AS x"), None)
    assert infer_roles(broken, {"x": "numeric"}) == {"x": "numeric"}
    steps = [{"op": "cast", "columns": ["few", "sbd"]}, {"op": "cast", "columns": ["many"], "dtype": "datetime"}]
    assert roles_after(infer_roles(identified(df)), ["many", "few", "sbd"], steps) == {"many": "datetime", "few": "numeric", "sbd": "id"}


def test_issues(spark):
    rows = [(" a", "1", 1.0, "k", "d")] * 2 + [(str(i), str(i), float(i), "k", "d") for i in range(8)] + [("x", "bad", float("inf"), "k", None)]
    df = spark.createDataFrame(rows + [("y", "3", 900.0, "k", "d")], "s string, m string, v double, c string, t string")
    found = {(i["column"], i["kind"]): i["count"] for i in Profile(identified(df), {"t": "datetime"}).issues}
    assert found == {
        ("(table)", "duplicates"): 1, ("s", "whitespace"): 2, ("m", "mixed_numeric"): 1, ("v", "invalid_numeric"): 1,
        ("v", "outliers"): 1, ("c", "constant"): 12, ("t", "missing"): 1, ("t", "constant"): 11, ("t", "datetime_unparsed"): 11,
    }


def test_counts(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 1, None), ("b", 2, None), ("a", 2, None), (None, 2, None), (None, 2, None)], "s string, `i.j` int, v double")
    counts = {(r["column"], r["value"]): r["n"] for r in value_counts(df).collect()}
    assert counts == {("s", "a"): 2, ("s", "b"): 2, ("i.j", "1"): 2, ("i.j", "2"): 4}
    assert [r["value"] for r in top_values(value_counts(df, ["s"]), 1).collect()] == ["a"]
    assert modes(df, ["s", "i.j", "v"]) == {"s": "a", "i.j": 2}
    assert duplicate_rows(df).first()["duplicate_rows"] == 1


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    samples = {"u": rng.random(500), "w": np.r_[np.ones(3), 2.0, 1e12], "t": np.round(rng.random(300), 1), "c": np.full(9, 4.0)}
    for name, values in samples.items():
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], f"{name} double")
        found = sorted(charts.histogram(df, [name]).collect(), key=lambda r: r["bin"])
        bins = min(60, max(1, int(np.ceil(np.sqrt(len(values))))))
        counts, edges = np.histogram(values, bins=bins)
        assert [r["n"] for r in found] == counts.tolist()
        np.testing.assert_allclose([r["low"] for r in found], edges[:-1])


def test_shared_edges(spark):
    before = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 2.0, 1e12, None)], "x double")
    both = charts.compare_histogram(before, before.filter("x < 5"), "x").collect()
    assert len(both) == 60
    assert {p: sum(r["n"] for r in both if r["phase"] == p) for p in ("before", "after")} == {"before": 5, "after": 4}
    assert charts.compare_histogram(before.filter("x IS NULL"), before.filter("x IS NULL"), "x").count() == 0


def test_box_and_rates(spark):
    df = spark.createDataFrame([(float(v), None) for v in (1, 2, 3, 4, 100)], "x double, v double")
    assert tuple(charts.box_stats(df, ["x", "v"]).collect()[0]) == ("x", 2.0, 3.0, 4.0, 1.0, 4.0)
    assert [tuple(r) for r in charts.missing_rates(df).collect()] == [("v", 5, 100.0), ("x", 0, 0.0)]
    assert charts.scatter_pairs(df.withColumn("y", F.when(F.col("x") > 2, F.lit(1.0))), "x", "y").count() == 3


def test_report_covers_every_column(spark):
    df = identified(spark.createDataFrame([(float(i), float(i * i), "abc"[i % 3]) for i in range(12)], "a double, b double, s string").coalesce(1))
    result = run_pipeline(df, {"steps": [{"op": "range", "columns": ["a"], "max": 9}]})
    shown = report(df, result)
    assert sorted(shown.tables["before"]) == ["category", "correlation", "missing", "numeric"]
    assert {r[0] for r in shown.tables["before"]["numeric"].select("column").collect()} == {"a", "b"}
    assert shown.tables["before"]["category"].count() == 3
    assert {r[0] for r in shown.tables["comparison"]["numeric"].select("column").distinct().collect()} == {"a", "b"}
    assert {e["metric"]: e["difference"] for e in shown.comparison}["missing_cells"] == 2
    assert compare_profiles(shown.before, shown.before)[0]["difference"] == 0
