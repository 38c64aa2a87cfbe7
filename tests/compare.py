"""Run queries and their SQL side by side: python tests/compare.py [--sf DIR] [name ...]"""

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    if type(value).__name__ == "Decimal":
        return normal(float(value)) if value % 1 else int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, connection, run, sql, folder):
    """None when results agree, otherwise a short account of how they differ."""
    frame = run(spark, folder)
    ours = rows_of(frame.columns, frame.collect())
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    theirs = rows_of(names, answer.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if not ours:
        return "no rows"
    if ours != theirs:
        off = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
        return f"{len(ours)} vs {len(theirs)} rows; {off}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    arguments = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if arguments[:1] == ["--sf"]:
        folder, arguments = arguments[1], arguments[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from importlib import import_module

    queries, sql = {}, {}
    for module in ("sources", "sinks", "cleaning", "profiling", "association", "charts", "ml"):
        try:
            loaded = import_module(f"tabwright.queries.{module}")
        except ModuleNotFoundError as error:
            print("skipping", error)
            continue
        queries |= loaded.QUERIES
        sql |= loaded.SQL
    connection = database(folder)
    for name in [n for n in queries if not arguments or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in arguments)]:
        start = time.time()
        try:
            if name in sql:
                problem = difference(spark, connection, queries[name], sql[name], folder)
            else:
                problem = None if queries[name](spark, folder).count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s{'' if name in sql else ' (rows only)'} {problem or ''}", flush=True)
