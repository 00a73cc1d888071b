"""References to records that do not exist, kept as an incremental pending-orphan state.

References arrive over time, parents are born and removed over time. ``OrphanTracker.advance`` takes a delivery: the references
and the births and removals of one or more epochs. (1) Each new reference probes the parent index at its own moment of arrival.
(2) Parents that live at the end of an epoch resolve what waits for their key, removals reopen it. (3) A snapshot of what waits
closes every epoch.

The state is made of signed counts: references per (table, column, period, key) and living parents per key. A delivery appends
its counts as a layer and looks up the older ones only for the keys it touches, so it costs as much as what it brings; layers
are added up from time to time. Whether a key waits follows from its number of living parents, so a key that holds a third of
all references is one state row after map-side aggregation. Orphans found on arrival are kept as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

REFS = "table_name string, row_key long, ref_column string, period string, ref_key string, seen_at timestamp"
EVENTS = "ref_key string, at timestamp, sign long"
STATE = "table_name string, ref_column string, period string, ref_key string, n_refs long, waiting boolean"
SNAPSHOT = "epoch timestamp, table_name string, period string, n_waiting long, n_opened long, n_resolved long, n_reopened long"
GROUP = ["table_name", "ref_column", "period", "ref_key"]
#: So many layers are added up to one.
MOST_LAYERS = 8


def parent_events(parents: DataFrame, key: str, born: str, gone: str) -> DataFrame:
    """Births (+1) and removals (-1) of EVENTS: a key lives while more of its rows were born than removed.

    A row without a key or birth names no life. A life that ends before it begins is empty. Repeated rows don't matter.
    """
    born_at, gone_at = F.col(born).cast("timestamp"), F.col(gone).cast("timestamp")
    one = lambda n: F.lit(n).cast("long").alias("sign")
    lives = parents.select(F.col(key).alias("ref_key"), born_at.alias("born"), gone_at.alias("gone")).where(
        F.col("ref_key").isNotNull() & F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("gone") > F.col("born")))
    )
    ends = F.array(F.struct(F.col("born").alias("at"), one(1)), F.struct(F.col("gone").alias("at"), one(-1)))
    return lives.distinct().select("ref_key", F.inline(ends)).where(F.col("at").isNotNull())


def months(first: str, last: str) -> list[tuple[str, str]]:
    """The months ``yyyyMM`` from ``first`` to ``last``, each with the day after it. Texts, so that only the session's time zone counts."""
    out, y, m = [], int(first[:4]), int(first[4:])
    while (now := f"{y:04d}{m:02d}") <= last:
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
        out.append((now, f"{y:04d}-{m:02d}-01"))
    return out


class OrphanTracker:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.refs: list[DataFrame] = []  # GROUP, n_refs
        self.parents: list[DataFrame] = []  # ref_key, n_living
        self.waiting = spark.createDataFrame([], "table_name string, period string, n_waiting long")

    def state(self) -> DataFrame:
        """STATE as it stands."""
        refs = _sum(self.spark, self.refs, GROUP, "n_refs", "table_name string, ref_column string, period string, ref_key string, n_refs long")
        living = _sum(self.spark, self.parents, ["ref_key"], "n_living", "ref_key string, n_living long").where("n_living > 0")
        alive = living.select("ref_key", F.lit(True).alias("_alive"))
        return refs.join(alive, "ref_key", "left").select(*GROUP, "n_refs", F.col("_alive").isNull().alias("waiting"))

    def advance(self, refs: DataFrame, events: DataFrame, ends: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """Takes the references (REFS) and parent events (EVENTS) that came since the last delivery, up to before ``ends[-1]``.

        ``ends``: the days that close the epochs of the delivery, in order; what is older than an epoch belongs to the first.
        Returns the references that were orphans when they arrived, and SNAPSHOT. One that was never dated (null ``seen_at``)
        can't be probed, enters with the first epoch and counts as an orphan.
        """
        days = [F.lit(e).cast("timestamp") for e in ends]
        number = lambda at: sum((F.when(at >= d, 1).otherwise(0) for d in days[:-1]), F.lit(0))
        refs = refs.where(F.col("ref_key").isNotNull())
        new = cut(events.where(F.col("at") < days[-1]).groupBy("ref_key", "at").agg(F.sum("sign").alias("sign")))
        touched = refs.select("ref_key").unionByName(new.select("ref_key")).distinct()
        before = cut(_sum(self.spark, [p.join(touched, "ref_key", "left_semi") for p in self.parents], ["ref_key"], "n_living", "ref_key string, n_living long"))

        # (1) the parent index of the touched keys, and the probes
        start = F.lit("0001-01-01").cast("timestamp")
        steps = before.select("ref_key", start.alias("at"), F.col("n_living").alias("sign")).unionByName(new)
        line = Window.partitionBy("ref_key").orderBy("at")
        index = steps.withColumn("living", F.sum("sign").over(line)).withColumn("until", F.lead("at").over(line)).where("living > 0")
        on = (F.col("r.ref_key") == F.col("p.ref_key")) & (F.col("p.at") <= F.col("r.seen_at")) & (F.col("p.until").isNull() | (F.col("p.until") > F.col("r.seen_at")))
        found = cut(refs.alias("r").join(index.select("ref_key", "at", "until").alias("p"), on, "left_anti"))

        # (2) whether keys live at the ends of the epochs, where that changes
        net = new.groupBy("ref_key", number(F.col("at")).alias("epoch")).agg(F.sum("sign").alias("net"))
        sums = net.unionByName(before.select("ref_key", F.lit(-1).alias("epoch"), F.col("n_living").alias("net")))
        order = Window.partitionBy("ref_key").orderBy("epoch")
        lived = sums.withColumn("alive", F.sum("net").over(order) > 0).withColumn("was", F.coalesce(F.lag("alive").over(order), F.lit(False)))
        turns = cut(lived.where((F.col("alive") != F.col("was")) & (F.col("epoch") >= 0)).select("ref_key", "epoch", "alive"))
        at_first = before.where("n_living > 0").select("ref_key", F.lit(True).alias("alive_first"))

        came = _arrivals(refs, number, "n_new").unionByName(_arrivals(found, number, "n_orphan"), allowMissingColumns=True)
        arrived = cut(came.groupBy(*GROUP, "epoch").agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_new"), F.coalesce(F.sum("n_orphan"), F.lit(0)).alias("n_orphan")))
        turning = turns.select("ref_key").distinct()
        old = _sum(self.spark, [r.join(turning, "ref_key", "left_semi") for r in self.refs], GROUP, "n_refs", "table_name string, ref_column string, period string, ref_key string, n_refs long")
        zero = F.lit(0).cast("long")
        held = old.select(*GROUP, F.lit(-1).alias("epoch"), F.col("n_refs").alias("n_new"), zero.alias("n_orphan"))
        groups = arrived.select(*GROUP).unionByName(held.select(*GROUP)).distinct()
        marks = groups.join(turns, "ref_key").select(*GROUP, "epoch", zero.alias("n_new"), zero.alias("n_orphan"), F.col("alive").alias("turn"))
        rows = arrived.unionByName(held).unionByName(marks, allowMissingColumns=True)
        rows = rows.groupBy(*GROUP, "epoch").agg(F.sum("n_new").alias("n_new"), F.sum("n_orphan").alias("n_orphan"), F.max("turn").alias("turn"))
        past = Window.partitionBy(*GROUP).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(at_first, "ref_key", "left").withColumn("n_before", F.coalesce(F.sum("n_new").over(past), zero))
        rows = rows.withColumn("was", F.coalesce(F.last("turn", True).over(past), F.col("alive_first"), F.lit(False)))
        rows = rows.withColumn("alive", F.coalesce("turn", "was")).where("epoch >= 0")
        n = lambda cond, value: F.sum(F.when(cond, value).otherwise(zero))
        resolved = n(F.col("alive"), F.col("n_orphan") + F.when(~F.col("was"), F.col("n_before")).otherwise(zero))
        reopened = n(~F.col("alive"), F.col("n_new") - F.col("n_orphan") + F.when(F.col("was"), F.col("n_before")).otherwise(zero))
        moved = cut(rows.groupBy("epoch", "table_name", "period").agg(F.sum("n_orphan").alias("n_opened"), resolved.alias("n_resolved"), reopened.alias("n_reopened")))

        # (3) a row for every table and period known at the end of an epoch
        calendar = self.spark.range(len(ends)).select(F.col("id").cast("int").alias("epoch"), F.element_at(F.array(*days), (F.col("id") + 1).cast("int")).alias("end"))
        known = arrived.groupBy("table_name", "period").agg(F.min("epoch").alias("first"))
        told = self.waiting.select("table_name", "period", F.lit(-1).alias("first"), F.col("n_waiting").alias("held"))
        known = known.unionByName(told, allowMissingColumns=True).groupBy("table_name", "period").agg(F.min("first").alias("first"), F.coalesce(F.sum("held"), zero).alias("held"))
        grid = known.join(calendar, F.col("epoch") >= F.col("first")).alias("g")
        same = (F.col("g.epoch") == F.col("m.epoch")) & F.col("g.table_name").eqNullSafe(F.col("m.table_name")) & F.col("g.period").eqNullSafe(F.col("m.period"))
        counts = [F.coalesce(c, zero).alias(c) for c in ("n_opened", "n_resolved", "n_reopened")]
        shown = grid.join(moved.alias("m"), same, "left").select("g.end", "g.table_name", "g.period", "g.held", *counts)
        so_far = Window.partitionBy("table_name", "period").orderBy("end")
        waits = F.col("held") + F.sum(F.col("n_opened") + F.col("n_reopened") - F.col("n_resolved")).over(so_far)
        snapshot = cut(shown.select(F.col("end").alias("epoch"), "table_name", "period", waits.alias("n_waiting"), "n_opened", "n_resolved", "n_reopened"))

        self.refs.append(cut(arrived.groupBy(*GROUP).agg(F.sum("n_new").alias("n_refs"))))
        self.parents.append(cut(new.groupBy("ref_key").agg(F.sum("sign").alias("n_living"))))
        if len(self.refs) > MOST_LAYERS:
            self.refs = [cut(_sum(self.spark, self.refs, GROUP, "n_refs", ""))]
            self.parents = [cut(_sum(self.spark, self.parents, ["ref_key"], "n_living", "").where("n_living != 0"))]
        self.waiting = snapshot.where(F.col("epoch") == days[-1]).select("table_name", "period", "n_waiting")
        return found, snapshot


def _arrivals(rows: DataFrame, number, name: str) -> DataFrame:
    return rows.groupBy(*GROUP, number(F.col("seen_at")).alias("epoch")).agg(F.count(F.lit(1)).alias(name))


def _sum(spark: SparkSession, layers: Sequence[DataFrame], keys: list[str], value: str, schema: str) -> DataFrame:
    if not layers:
        return spark.createDataFrame([], schema)
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    return every.groupBy(*keys).agg(F.sum(value).alias(value))


def track_orphans(refs: DataFrame, parents: DataFrame, key: str, born: str, gone: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All of ``refs`` (see REFS) as one delivery of monthly epochs: found orphans, snapshots and the final state.

    References with a null key are no references. Without any dated reference the only epoch is January 1970. Empty inputs give
    empty outputs.
    """
    spark = refs.sparkSession
    rows = cut(refs.where(F.col("ref_key").isNotNull()))
    first, last = rows.agg(*[F.date_format(f("seen_at"), "yyyyMM") for f in (F.min, F.max)]).first()
    ends = [end for _, end in months(first or "197001", last or "197001")]
    tracker = OrphanTracker(spark)
    found, snapshots = tracker.advance(rows, parent_events(parents, key, born, gone), ends)
    return found, snapshots, tracker.state()
