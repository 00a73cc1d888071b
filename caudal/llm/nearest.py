"""Nearest record in time for the same entity, by expanding rings.

Ring k looks at buckets of width ``tolerance / 2**(rings - 1 - k)``. A left point and the right points of its own and the two
adjacent buckets are joined on (entity, bucket); whatever lies within one width is then certain to be seen, so the nearest
right point within the width is final. Points without one go to the next ring, whose buckets are twice as wide, up to the
tolerance itself.

Left rows with the same entity and moment are one point, right rows likewise (the smaller id stands for them), so copies
never multiply. The rings begin so fine that no bucket holds more than ``MOST`` right points of an entity (or a microsecond), so
a dense entity, however many rows it has, is settled bucket by bucket. Every join key holds the bucket, which spreads a hot
entity over time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

RINGS = 6
#: Right points of an entity that the buckets of the first ring may hold.
MOST = 2_000


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp's own clock, whatever the session's time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, moment.cast("timestamp_ntz"))


def _rings(targets: DataFrame, entity: list[str], tolerance: int, rings: int) -> int:
    """So many rings that the first one's buckets aren't too full."""
    while (width := -(-tolerance // 2 ** (rings - 1))) > 1:
        per = targets.groupBy(*entity, F.floor(F.col("t") / F.lit(width))).agg(F.count(F.lit(1)).alias("n"))
        most = per.agg(F.max("n")).first()[0] or 0
        if most <= MOST:
            break
        rings += max(1, (int(most) // MOST).bit_length())
    return rings


def nearest_within(left: DataFrame, right: DataFrame, entity: list[str], tolerance: int, rings: int = RINGS) -> DataFrame:
    """``left`` (left_id, t, entity columns) and ``right`` (right_id, t, entity columns), ``t`` and ``tolerance`` in microseconds.

    Returns (left_id, right_id, distance) for each left row with a right row of the same entity at most ``tolerance`` away,
    both ends included: the nearest one, the smaller ``right_id`` on ties. A null in the entity or in ``t`` matches nothing.
    Repeated left rows each get their row. Either side may be empty.
    """
    whole = [*entity, "t"]
    usable = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in whole))
    left = usable(left.select("left_id", *whole))
    points = cut(left.select(*whole).distinct())
    keys = points.select(*entity).distinct()
    targets = cut(usable(right.select("right_id", *whole)).join(keys, entity, "left_semi").groupBy(*whole).agg(F.min("right_id").alias("right_id")))
    rings = _rings(targets, entity, tolerance, rings)
    settled: list[DataFrame] = []
    for k in range(rings):
        width = max(1, -(-tolerance // 2 ** (rings - 1 - k)))
        bucket = F.floor(F.col("t") / F.lit(width)).cast("long")
        near = points.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed("t", "_t")
        found = (
            near.join(targets.withColumn("_b", bucket), [*entity, "_b"])
            .withColumn("distance", F.abs(F.col("t") - F.col("_t")))
            .where(F.col("distance") <= min(width, tolerance))
            .groupBy(*entity, F.col("_t").alias("t"))
            .agg(F.min(F.struct("distance", "right_id")).alias("_best"))
        )
        found = cut(found.select(*whole, "_best.right_id", "_best.distance"))
        settled.append(found)
        if k + 1 < rings:
            points = cut(points.join(found.select(*whole), whole, "left_anti"))
            if points.isEmpty():
                break
    every = settled[0]
    for s in settled[1:]:
        every = every.unionByName(s)
    return left.join(every, whole).select("left_id", "right_id", "distance")
