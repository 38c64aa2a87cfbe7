"""Left joins against a table of unique keys, safe for hot keys on the row side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SPREAD = 1024
COPIES = 16


def attach(df: DataFrame, key: Column, table: DataFrame, size: int, out: str, spread_by: Column, hot: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the ``payload`` of ``table`` (``key, payload``) for each row's key, null if absent.

    ``size`` is the counted number of table rows. Up to ``BROADCAST_ROWS`` the table is broadcast.
    Beyond that the join shuffles, and no key may own a task: with ``hot`` (the table's rows for the
    few frequent keys, at most ``BROADCAST_ROWS`` by construction) those keys are resolved by
    broadcast and only the rest is shuffled; without it the table is copied ``COPIES`` times and each
    row goes to one of the copies. Rows with nothing to look up are spread over ``SPREAD`` slots.
    """
    if size <= BROADCAST_ROWS:
        small = table.select(F.col("key").alias("__k"), F.col("payload").alias(out))
        return df.join(F.broadcast(small), key == F.col("__k"), "left").drop("__k")
    if hot is not None:
        frequent = hot.select(F.col("key").alias("__hk"), F.col("payload").alias("__hp"))
        rows = df.join(F.broadcast(frequent), key == F.col("__hk"), "left")
        wanted = F.when(F.col("__hk").isNull(), key)
        rows = rows.select("*", wanted.alias("__ck"))
        idle = F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int")
        rows = rows.select("*", F.when(F.col("__ck").isNull(), idle).otherwise(0).alias("__cs"))
        rest = table.select(F.col("key").alias("__k"), F.col("payload").alias("__p"), F.lit(0).alias("__s"))
        joined = rows.join(rest, (F.col("__ck") == F.col("__k")) & (F.col("__cs") == F.col("__s")), "left")
        resolved = F.coalesce("__hp", "__p").alias(out)
    else:
        slots = F.when(key.isNull(), SPREAD).otherwise(COPIES)
        rows = df.select("*", key.alias("__ck"), F.pmod(F.xxhash64(spread_by), slots).cast("int").alias("__cs"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("__s")
        rest = table.select(F.col("key").alias("__k"), F.col("payload").alias("__p"), copies)
        joined = rows.join(rest, (F.col("__ck") == F.col("__k")) & (F.col("__cs") == F.col("__s")), "left")
        resolved = F.col("__p").alias(out)
    return joined.select(*[F.col("`" + name.replace("`", "``") + "`") for name in df.columns], resolved)
