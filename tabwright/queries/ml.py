"""Supervised-learning preparation. Time splits make membership, and so every fitted value, checkable in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.functions.names import ROW_ID, q
from tabwright.operators.splits import stratified_split
from tabwright.plans.ml_prep import MLConfig, export_ml, prepare_ml
from tabwright.queries.charts import binned_sql, rounded
from tabwright.queries.views import read, view, with_views
from tabwright.session import Scratch
from tabwright.sources.table import identified

QUERIES, SQL = {}, {}

CONFIG = MLConfig(
    target="target",
    numeric_columns=["amount", "visits"],
    categorical_columns=["kind", "grp"],
    split_method="time",
    time_column="ts",
    drop_missing_target=True,
    numeric_errors="coerce",
    max_categories=8,
)
LIMIT = CONFIG.max_categories


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def prepared(spark, folder, **changes):
    return prepare_ml(view(spark, folder, "learn"), replace(CONFIG, **changes))


def long_form(result, frame=None):
    """``row_id, feature, value`` for the non-zero entries of the feature vectors."""
    names = F.array(*[F.lit(name) for name in result.fitted.names])
    frame = result.prepared if frame is None else frame
    entries = frame.select(q(ROW_ID).alias("row_id"), F.posexplode(vector_to_array("features")).alias("i", "value"))
    return entries.filter("value != 0").select("row_id", F.element_at(names, F.col("i") + 1).alias("feature"), F.round("value", 6).alias("value"))


# -- the SQL counterpart ---------------------------------------------------------------------------

SPLIT = """,
 u AS (SELECT * REPLACE (TRY_CAST(visits AS DOUBLE) AS visits), visits AS visits_text, row_number() OVER (ORDER BY ts) - 1 AS place, count(*) OVER () AS n
       FROM learn WHERE target IS NOT NULL),
 s AS (SELECT *, CASE WHEN place < n - 2 * ceil(n * 0.2::DOUBLE) THEN 'train' WHEN place < n - ceil(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM u),
 tr AS (SELECT * FROM s WHERE split = 'train')"""


def fills(imputer: str) -> str:
    if imputer == "zero":
        return "SELECT 0.0::DOUBLE AS fa, 0.0::DOUBLE AS fv"
    stat = "quantile_cont({c}, 0.5)" if imputer == "median" else "avg({c})"
    return f"SELECT {stat.format(c='amount')} AS fa, {stat.format(c='visits')} AS fv FROM tr"


SCALES = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "none": ("0.0::DOUBLE", "1.0::DOUBLE"),
}


def numbers_sql(scaler: str, imputer: str = "median") -> str:
    center, scale = SCALES[scaler]
    stats = ", ".join(
        f"any_value({fill}) AS f_{c}, {center.format(c=f'coalesce({c}, {fill})')} AS c_{c}, {scale.format(c=f'coalesce({c}, {fill})')} AS s_{c}"
        for c, fill in (("amount", "fa"), ("visits", "fv"))
    )
    return f"{SPLIT}, fill AS ({fills(imputer)}), p AS (SELECT {stats} FROM tr, fill)"


SCALED = ", ".join(f"round((coalesce({c}, f_{c}) - c_{c}) / s_{c}, 6) AS {c}" for c in ("amount", "visits"))

CATEGORIES = f""",
 cells AS (SELECT row_id, split, 'kind' AS col, coalesce('value:' || kind, '__MISSING__') AS val FROM s
           UNION ALL SELECT row_id, split, 'grp', coalesce('value:' || grp, '__MISSING__') FROM s),
 counted AS (SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, val DESC) AS rk, count(*) OVER (PARTITION BY col) AS k
             FROM cells WHERE split = 'train' GROUP BY col, val),
 frequent AS (SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY val) - 1 AS code FROM counted WHERE k <= {LIMIT} OR rk < {LIMIT}),
 rare AS (SELECT col, val FROM counted WHERE k > {LIMIT} AND rk >= {LIMIT}),
 coded AS (SELECT c.row_id, c.split, c.col, coalesce(f.code, CASE WHEN r.val IS NOT NULL THEN (SELECT count(*) FROM frequent x WHERE x.col = c.col) END, -1) AS code,
             coalesce(f.val, CASE WHEN r.val IS NOT NULL THEN 'infrequent_sklearn' END) AS shown
           FROM cells c LEFT JOIN frequent f ON f.col = c.col AND f.val = c.val LEFT JOIN rare r ON r.col = c.col AND r.val = c.val)"""


# -- rows and splits -------------------------------------------------------------------------------

register(
    "ml_excluded_rows",
    lambda spark, folder: prepared(spark, folder).excluded.select(q(ROW_ID).alias("row_id")),
    with_views("SELECT row_id FROM learn WHERE target IS NULL", "learn"),
)


def _split_random(spark, folder):
    result = prepared(spark, folder, split_method="random", time_column="")
    return result.rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("target").isNull()).alias("without_target"))


register(
    "split_random",
    _split_random,
    with_views(
        """, c AS (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE)::BIGINT AS t FROM learn WHERE target IS NOT NULL),
        d AS (SELECT *, ceil((n - t) * (0.2::DOUBLE / (1 - 0.2::DOUBLE)))::BIGINT AS v FROM c)
        SELECT 'train' AS split, n - t - v AS n, 0 AS without_target FROM d UNION ALL SELECT 'validation', v, 0 FROM d UNION ALL SELECT 'test', t, 0 FROM d""",
        "learn",
    ),
)


def _split_stratified(spark, folder):
    frame = read(spark, folder, "labels").select(
        q("doc_id").alias("key"), F.concat(q("quality").cast("string"), F.lit("-"), q("toxic").cast("string")).alias("label")
    )
    frame = identified(frame, "key")
    counts = {r["label"]: r["n"] for r in frame.groupBy("label").agg(F.count("*").alias("n")).collect()}
    split = stratified_split(frame, q("label"), counts, 0.2, 0.2, 42)
    return frame.select("label", split.column.alias("split")).groupBy("label", "split").agg(F.count("*").alias("n"))


def _quota(source: str, size: str, draws: str, out: str) -> str:
    """Largest remainder over the groups of ``source``; equal remainders to the smaller label."""
    return f"""SELECT *, {size} * {draws} // total + CASE WHEN row_number() OVER (ORDER BY {size} * {draws} % total DESC, label) <=
      {draws} - sum({size} * {draws} // total) OVER () THEN 1 ELSE 0 END AS {out} FROM (SELECT *, sum({size}) OVER () AS total FROM {source})"""


register(
    "split_stratified",
    _split_stratified,
    f"""WITH c AS (SELECT quality || '-' || toxic AS label, count(*) AS n FROM labels GROUP BY 1),
    z AS (SELECT sum(n) AS total_rows, ceil(sum(n) * 0.2::DOUBLE)::BIGINT AS t FROM c),
    z2 AS (SELECT *, ceil((total_rows - t) * (0.2::DOUBLE / (1 - 0.2::DOUBLE)))::BIGINT AS v FROM z),
    a AS (SELECT * EXCLUDE (total) FROM ({_quota('(SELECT c.*, total_rows - t AS d1, total_rows - t - v AS d2 FROM c, z2)', 'n', 'd1', 'kept')})),
    b AS ({_quota('a', 'kept', 'd2', 'train')})
    SELECT * FROM (SELECT label, 'train' AS split, train::BIGINT AS n FROM b UNION ALL SELECT label, 'validation', (kept - train)::BIGINT FROM b
    UNION ALL SELECT label, 'test', (n - kept)::BIGINT FROM b) WHERE n > 0""",
)
register(
    "split_time",
    lambda spark, folder: prepared(spark, folder).rows.select(q(ROW_ID).alias("row_id"), "split"),
    with_views(f"{SPLIT} SELECT row_id, split FROM s", "learn"),
)


def _split_overlap(spark, folder):
    frame = view(spark, folder, "learn").withColumn("target", F.round(F.col("target"), 0))
    result = prepare_ml(frame, replace(CONFIG, numeric_columns=["visits"], categorical_columns=["kind"]))
    return spark.createDataFrame([(result.overlap,)], "overlap bigint")


register(
    "split_overlap",
    _split_overlap,
    with_views(
        f"""{SPLIT} SELECT count(*) AS overlap FROM (SELECT 1 FROM s GROUP BY visits_text, kind, round(target, 0) HAVING count(DISTINCT split) > 1)""",
        "learn",
    ),
)


def _invalid_counts(spark, folder):
    counts = prepared(spark, folder).invalid_counts
    return spark.createDataFrame(list(counts.items()), "column string, invalid bigint")


register(
    "ml_invalid_counts",
    _invalid_counts,
    with_views(
        """SELECT 'amount' AS "column", 0 AS invalid UNION ALL SELECT 'visits', count(*) FILTER (visits = 'n/a') FROM learn WHERE target IS NOT NULL""",
        "learn",
    ),
)

# -- numbers ---------------------------------------------------------------------------------------


def _scaled(scaler, imputer="median"):
    def run(spark, folder):
        result = prepared(spark, folder, scaler=scaler, numeric_imputer=imputer)
        flat = result.fitted.flat(result.rows)
        return flat.select(q(ROW_ID).alias("row_id"), "split", F.round("n0", 6).alias("amount"), F.round("n1", 6).alias("visits"))

    return run


for _scaler in ("standard", "minmax", "robust", "none"):
    register(f"scale_{_scaler}", _scaled(_scaler), with_views(f"{numbers_sql(_scaler)} SELECT row_id, split, {SCALED} FROM s, p", "learn"))
register("ml_impute", _scaled("none", "mean"), with_views(f"{numbers_sql('none', 'mean')} SELECT row_id, split, {SCALED} FROM s, p", "learn"))


def _params(spark, folder):
    fitted = prepared(spark, folder, scaler="robust").fitted
    return rounded(fitted.table(spark), "value")


register(
    "ml_params",
    _params,
    with_views(
        numbers_sql("robust")
        + CATEGORIES
        + " "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{name}' AS statistic, round({key}_{c}, 6) AS value, NULL AS label FROM p"
            for c in ("amount", "visits")
            for name, key in (("fill", "f"), ("center", "c"), ("scale", "s"))
        )
        + " UNION ALL SELECT col, 'code', code::DOUBLE, val FROM frequent",
        "learn",
    ),
)

# -- categories and whole vectors ------------------------------------------------------------------


def _onehot(spark, folder):
    return long_form(prepared(spark, folder, numeric_columns=[]))


register(
    "encode_onehot",
    _onehot,
    with_views(
        f"{SPLIT}{CATEGORIES} SELECT row_id, 'category__' || col || '_' || shown AS feature, 1.0::DOUBLE AS value FROM coded WHERE shown IS NOT NULL",
        "learn",
    ),
)


def _ordinal(spark, folder):
    result = prepared(spark, folder, encoding="ordinal", numeric_columns=[])
    flat = result.fitted.flat(result.rows)
    return flat.select(q(ROW_ID).alias("row_id"), F.col("c0").alias("kind"), F.col("c1").alias("grp"))


_CODES = "max(code) FILTER (col = 'kind')::INT AS kind, max(code) FILTER (col = 'grp')::INT AS grp"
register("encode_ordinal", _ordinal, with_views(f"{SPLIT}{CATEGORIES} SELECT row_id, {_CODES} FROM coded GROUP BY row_id", "learn"))

_MATRIX = """SELECT * FROM (
 SELECT row_id, 'numeric__amount' AS feature, round((coalesce(amount, f_amount) - c_amount) / s_amount, 6) AS value FROM {rows}, p
 UNION ALL SELECT row_id, 'numeric__visits', round((coalesce(visits, f_visits) - c_visits) / s_visits, 6) FROM {rows}, p
 UNION ALL SELECT row_id, 'category__' || col || '_' || shown, 1.0 FROM {coded} WHERE shown IS NOT NULL) WHERE value IS NOT NULL"""


def _matrix(spark, folder):
    return long_form(prepared(spark, folder))


register("ml_matrix", _matrix, with_views(f"{numbers_sql('standard')}{CATEGORIES} {_MATRIX.format(rows='s', coded='coded')}", "learn"))


def _encode_target(spark, folder):
    result = prepared(spark, folder, task="classification", target="label", drop_missing_target=False)
    return result.prepared.select(q(ROW_ID).alias("row_id"), F.col("label").cast("int").alias("label"))


register(
    "encode_target",
    _encode_target,
    with_views("SELECT row_id, CASE label WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 2 END AS label FROM learn", "learn"),
)


def _manifest(spark, folder):
    manifest = prepared(spark, folder).manifest
    facts = {
        "source_rows": manifest["source_rows"],
        "excluded_target_rows": manifest["excluded_target_rows"],
        "feature_count": manifest["feature_count"],
        "duplicate_signatures_across_splits": manifest["duplicate_signatures_across_splits"],
        **{f"rows:{part}": rows for part, rows in manifest["split_rows"].items()},
        **{f"invalid:{name}": count for name, count in manifest["invalid_numeric_to_missing"].items()},
    }
    return spark.createDataFrame(list(facts.items()), "fact string, value bigint")


register(
    "ml_manifest",
    _manifest,
    with_views(
        f"""{SPLIT}{CATEGORIES} SELECT 'source_rows' AS fact, count(*) AS value FROM learn
        UNION ALL SELECT 'excluded_target_rows', count(*) FILTER (target IS NULL) FROM learn
        UNION ALL SELECT 'feature_count', 2 + (SELECT count(*) FROM frequent) + (SELECT count(DISTINCT col) FROM rare)
        UNION ALL SELECT 'duplicate_signatures_across_splits', count(*) FROM (SELECT 1 FROM s GROUP BY amount, visits_text, kind, grp, target HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'rows:' || split, count(*) FROM s GROUP BY split
        UNION ALL SELECT 'invalid:amount', 0 UNION ALL SELECT 'invalid:visits', count(*) FILTER (visits_text = 'n/a') FROM u""",
        "learn",
    ),
)


def _transform_new(spark, folder):
    """Fitted on one table, applied to another: shifted amounts and categories never seen in training."""
    result = prepared(spark, folder)
    new = view(spark, folder, "learn").select(
        ROW_ID, (F.col("amount") * 3).alias("amount"), "visits", F.when(F.col(ROW_ID) % 2 == 0, F.lit("new")).otherwise(F.col("kind")).alias("kind"), "grp"
    )
    return long_form(result, result.fitted.transform(new))


_NEW_CODED = """(SELECT c.row_id, c.col, coalesce(f.val, CASE WHEN r.val IS NOT NULL THEN 'infrequent_sklearn' END) AS shown FROM (
   SELECT row_id, 'kind' AS col, CASE WHEN row_id % 2 = 0 THEN 'value:new' ELSE coalesce('value:' || kind, '__MISSING__') END AS val FROM learn
   UNION ALL SELECT row_id, 'grp', coalesce('value:' || grp, '__MISSING__') FROM learn) c
   LEFT JOIN frequent f ON f.col = c.col AND f.val = c.val LEFT JOIN rare r ON r.col = c.col AND r.val = c.val)"""
register(
    "ml_transform_new",
    _transform_new,
    with_views(
        f"{numbers_sql('standard')}{CATEGORIES} "
        + _MATRIX.format(rows="(SELECT row_id, amount * 3 AS amount, TRY_CAST(visits AS DOUBLE) AS visits FROM learn)", coded=_NEW_CODED),
        "learn",
    ),
)

register(
    "ml_scale_histogram",
    lambda spark, folder: rounded(prepared(spark, folder, scaler="minmax").scale_histogram("amount"), "low", "high"),
    with_views(
        f"""{numbers_sql('minmax')}, hb AS (SELECT amount AS v FROM tr), ha AS (SELECT (coalesce(amount, f_amount) - c_amount) / s_amount AS v FROM tr, p)
        SELECT 'before' AS phase, * EXCLUDE ("column") FROM ({binned_sql('amount', 'hb')})
        UNION ALL SELECT 'after', * EXCLUDE ("column") FROM ({binned_sql('amount', 'ha')})""",
        "learn",
    ),
)


def _preview(spark, folder):
    frame = prepared(spark, folder, scaler="none", categorical_columns=[]).preview()
    return frame.select(q(ROW_ID).alias("row_id"), F.round(q("numeric__amount"), 6).alias("amount"), F.round(q("numeric__visits"), 6).alias("visits"))


register(
    "ml_preview",
    _preview,
    with_views(f"{numbers_sql('none')} SELECT row_id, {SCALED} FROM tr, p ORDER BY row_id LIMIT 20", "learn"),
)

# -- exports ---------------------------------------------------------------------------------------


def _export(spark, folder):
    result = prepared(spark, folder)
    path = Scratch(spark).path("learning")
    export_ml(result, path, spark)
    back = spark.read.parquet(f"{path}/prepared")
    return back.select(q(ROW_ID).alias("row_id"), "split", F.round("label", 6).alias("label"))


register("ml_export", _export, with_views(f"{SPLIT} SELECT row_id, split, round(target, 6) AS label FROM s", "learn"))


def _dense_export(spark, folder):
    result = prepared(spark, folder, categorical_columns=[], scaler="none")
    path = Scratch(spark).path("learning")
    manifest = export_ml(result, path, spark, write_dense=True)
    frame = spark.read.parquet(*[f"{path}/dense_{part}" for part in manifest["dense_parts"]])
    return frame.select(q(ROW_ID).alias("row_id"), F.round(q("numeric__amount"), 6).alias("amount"), F.round(q("numeric__visits"), 6).alias("visits"))


register(
    "ml_dense_export",
    _dense_export,
    with_views(f"{numbers_sql('none')} SELECT row_id, {SCALED} FROM s, p", "learn"),
)
