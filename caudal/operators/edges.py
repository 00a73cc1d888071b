"""Residence edges, yearly roll-up and the filters of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz
from .roles import ROLES, first_available


# How residence edges are marked.
RESIDENCE = {"match_method": "residence", "rule_version": "residence_v1_2026_04_26", "assumption_revision": "2026-04-26"}


def residence_edges(records: DataFrame, period: str | None = None) -> DataFrame:
    """From the municipality of residence to the facility, weighted by records (of each ``period``); rows without either are left out."""
    place, facility = first_available(records.columns, ROLES["residence"]), first_available(records.columns, ROLES["node_facility"])
    if not place or not facility:
        raise ValueError("no residence or facility field")
    keys = [c for c in (period,) if c]
    ends = records.select(nz.code6_strict(F.col(place)).alias("m"), nz.text(F.col(facility)).alias("f"), *keys).where("m != '' AND f != ''")
    none = F.lit(None).cast("double")
    return ends.groupBy("m", "f", *keys).agg(F.count(F.lit(1)).alias("transfer_count")).select(
        F.concat(F.lit("municipality:"), "m").alias("source_node_id"), F.concat(F.lit("facility:"), "f").alias("target_node_id"), F.lit("residence").alias("edge_type"),
        "transfer_count", none.alias("confidence_score"), none.alias("distance_km"), *[F.lit(v).alias(c) for c, v in RESIDENCE.items()], *keys,
    )


def first_known(df: DataFrame, value: str, order: str):
    """The value of the smallest order among the rows that have one."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value))))


def roll_up(periods: DataFrame, period: str = "period") -> DataFrame:
    """Periods to one year: counts add up, confidence is the plain mean of the rows, texts come from the first period that has one."""
    typed = periods.withColumn("edge_type", F.coalesce("edge_type", F.lit("transfer")))
    return typed.groupBy("source_node_id", "target_node_id", "edge_type").agg(
        F.sum(nz.number_or(F.col("transfer_count"), 1.0)).alias("transfer_count"), F.avg("confidence_score").alias("confidence_score"),
        *[first_known(typed, c, period).alias(c) for c in ("match_method", "rule_version", "assumption_revision") if c in periods.columns],
    )


def at_least(edges: DataFrame, count: float) -> DataFrame:
    """Row by row and before any grouping; a count that isn't a number is 1."""
    return edges.where(nz.number_or(F.col("transfer_count"), 1.0) >= count)


def with_diagnosis(records: DataFrame, prefixes: list[str], column: str = "DIAG_PRINC") -> DataFrame:
    return records.where(nz.starts_with_any(F.col(column), prefixes)) if prefixes and column in records.columns else records


def in_states(records: DataFrame, code_to_state: DataFrame, states: list[str], row_id: str) -> DataFrame:
    """Records one of whose municipality fields lies in one of ``states``. ``code_to_state``: code6, state. No such field: no filter."""
    fields = [c for c in ROLES["state_filter"] if c in records.columns]
    if not fields or not states:
        return records
    inside = code_to_state.where(F.upper("state").isin(states)).select("code6").distinct()
    cells = records.select(row_id, F.explode(F.array_distinct(F.array(*[nz.code6_loose(F.col(c)) for c in fields]))).alias("code6")).where("code6 != ''")
    return records.join(cells.join(inside, "code6", "left_semi").select(row_id).distinct(), row_id, "left_semi")


def edges_in_states(edges: DataFrame, node_state: DataFrame, states: list[str]) -> DataFrame:
    """Edges both of whose ends lie in ``states``; adds source_uf and target_uf. ``node_state``: node_id, state."""
    s, t = (node_state.select(F.col("node_id").alias(f"_{e}"), F.col("state").alias(f"{e}_uf")) for e in ("source", "target"))
    out = edges.join(s, F.col("source_node_id") == F.col("_source"), "left").join(t, F.col("target_node_id") == F.col("_target"), "left").drop("_source", "_target")
    return out.where(F.col("source_uf").isin(states) & F.col("target_uf").isin(states)) if states else out


def top_by_count(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("transfer_count"), "source_node_id", "target_node_id").limit(n)
