"""The batch operators on streams: movements as an interval join, and profiles as deltas per micro-batch.

The source network has no streams; these carry the same rules over for deliveries that arrive as they happen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import normalize as nz
from ..operators import profile


def movements_stream(exits: DataFrame, entries: DataFrame, min_hours: int = 24, max_hours: int = 48, late: str = "2 days") -> DataFrame:
    """Candidate movements: ``exits`` (subject, left, sex, age, chapter, facility), ``entries`` (subject, entered, and the same).

    Both sides need event times as timestamps. State is bounded by the window and the lateness; rows with a null subject drop out.
    All candidates of an exit come out, as the nearest can't be told before the window is over; ``nearest`` picks it per batch.
    """
    a = exits.withWatermark("left", late).select(*[F.col(c).alias(f"a_{c}") for c in ("subject", "left", "sex", "age", "chapter", "facility")])
    b = entries.withWatermark("entered", late).select(*[F.col(c).alias(f"b_{c}") for c in ("subject", "entered", "sex", "age", "chapter", "facility")])
    on = (
        (F.col("a_subject") == F.col("b_subject")) & (F.col("a_sex") == F.col("b_sex")) & (F.col("a_age") == F.col("b_age")) & (F.col("a_chapter") == F.col("b_chapter"))
        & (F.col("b_entered") >= F.col("a_left") + F.expr(f"INTERVAL {min_hours} HOURS")) & (F.col("b_entered") <= F.col("a_left") + F.expr(f"INTERVAL {max_hours} HOURS"))
    )
    pairs = a.join(b, on)
    return pairs.select(
        F.col("a_subject").alias("subject"), F.col("a_facility").alias("source_facility_id"), F.col("b_facility").alias("target_location_id"),
        F.col("a_left").alias("left"), F.col("b_entered").alias("entered"), nz.hours_between(F.col("b_entered"), F.col("a_left")).alias("delta_hours"),
    )


def nearest(candidates: DataFrame) -> DataFrame:
    """The nearest candidate per exit, the smaller target on ties."""
    best = F.min_by(F.struct("target_location_id", "entered", "delta_hours"), F.struct("delta_hours", "target_location_id", "entered")).alias("b")
    return candidates.groupBy("subject", "source_facility_id", "left").agg(best).select("subject", "source_facility_id", "left", "b.*")


def profile_stream(rows: DataFrame, store: str, columns: list[str], load: str = "load_id") -> DataStreamWriter:
    """Appends the value-count delta of each micro-batch to ``store``, one folder per batch id, so a batch that runs again
    replaces its own delta instead of counting twice. ``read_store`` adds the deltas up."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        profile.value_deltas(batch, columns, load).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return rows.writeStream.foreachBatch(apply)


def read_store(spark, store: str) -> DataFrame:
    deltas = spark.read.parquet(store).drop("batch")
    return deltas.groupBy(*profile.KEYS, "value").agg(F.sum("n").alias("n")).where("n != 0")
