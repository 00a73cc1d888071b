"""Two-stage salted aggregation for keys that hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is heavy when it holds at least this share of all rows; there can be no more than 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.01
SALTS = 32


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows per key, pre-aggregated on the map side. A null key is a key of its own."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))


def heavy_keys(rows: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """The keys holding at least ``share`` of all rows, over all rows; at most ``1 / share`` values reach the driver."""
    counts = key_counts(rows, key)
    total = rows.count()
    found = counts.where((F.col("key_rows") >= F.lit(share) * F.lit(total)) & F.col(key).isNotNull()).select(key)
    return [r[0] for r in found.collect()]


def salted(rows: DataFrame, key: str, heavy: Sequence, salts: int = SALTS) -> DataFrame:
    """Add ``_salt``: 0 for light keys, for rows of heavy keys one of ``salts`` numbers taken from the whole row.

    The number is a hash of the row and its position, not a random draw, so a task that runs again gives the same rows.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != key], F.monotonically_increasing_id()), F.lit(salts))
    return rows.withColumn("_salt", F.when(F.col(key).isin(list(heavy)), spread).otherwise(F.lit(0)).cast("int") if heavy else F.lit(0))


def salted_totals(rows: DataFrame, key: str, value: str, heavy: Sequence, salts: int = SALTS) -> DataFrame:
    """Per key the number of rows and the sum of ``value``; stage one by (key, salt), stage two by key.

    Null values add nothing; a key whose values are all null has a null sum. An empty input gives no rows.
    """
    partial = salted(rows.select(key, value), key, heavy, salts).groupBy(key, "_salt").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s")
    )
    return partial.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.sum("_s").alias("total"))


def salted_top(rows: DataFrame, key: str, member: str, value: str, k: int, heavy: Sequence, salts: int = SALTS) -> DataFrame:
    """The ``k`` members of each key with the largest sum of ``value``; ties go to more rows, then the smaller member.

    Members are first summed up per (key, member), which spreads a heavy key over its members; a member that itself is
    heavy is halved by the map-side partial sums. Then each (key, salt of member) keeps its best ``k`` and the survivors of
    all salts, at most ``k * salts`` a key, are ranked. Null members don't count; a null sum counts as 0.
    """
    sums = (
        rows.where(F.col(member).isNotNull())
        .groupBy(key, member)
        .agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("strength"), F.count(F.lit(1)).alias("n_rows"))
    )
    spread = F.pmod(F.xxhash64(member), F.lit(salts)).cast("int")
    salt: Column = F.when(F.col(key).isin(list(heavy)), spread).otherwise(F.lit(0)) if heavy else F.lit(0)
    order = [F.desc("strength"), F.desc("n_rows"), F.asc(member)]
    first = sums.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)))
    final = first.where(F.col("_r") <= k).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return final.where(F.col("rank") <= k).select(key, member, "strength", "n_rows", "rank")
