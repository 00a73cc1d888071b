"""Whole runs: a filtered batch of one period, and a year of monthly batches rolled up into one graph.

Both are lazy plans up to the sinks. Failed gates and contracts are returned, and ``EXIT`` gives the exit code they stand for.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import edges as ed
from ..operators import enrich, graph, manifest, match, nodes, roles
from ..session import cut
from ..sources import sinks

EXIT = {True: 0, False: 2}


@dataclass(frozen=True)
class BatchOptions:
    prefix: str = "batch"
    year: int = 2021
    month: int = 1
    states: list[str] = field(default_factory=list)
    diagnoses: list[str] = field(default_factory=list)
    min_count: float = 1.0
    scope: str = "all"
    max_missing: float = 0.0
    min_names: float = 0.9

    @property
    def tag(self) -> str:
        return manifest.batch_tag(self.prefix, self.year, self.month, self.states, self.diagnoses, self.min_count)


@dataclass
class Batch:
    nodes: DataFrame
    edges: DataFrame
    coverage: dict
    contract: dict
    summary: dict
    exit_code: int


def link(records: DataFrame) -> DataFrame:
    """Adds the probabilistic key as ``patient_id``; empty for all rows if a role is unbound."""
    bound = {k: roles.first_available(records.columns, roles.ROLES[k]) for k in ("birthdate", "sex", "age", "residence")}
    key = nz.subject_key(*[F.col(c) for c in bound.values()]) if all(bound.values()) else F.lit("")
    return records.withColumn("patient_id", key)


def movements(records: DataFrame, codes: list[str], **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gate-approved records to events, rejections and edges, with the roles bound to the first available columns."""
    bound = {k: roles.first_available(records.columns, roles.ROLES[r]) for k, r in (
        ("flag", "transfer_flag"), ("reason", "transfer_reason"), ("sex", "sex"), ("age", "age"), ("diagnosis", "diagnosis"), ("facility", "origin_facility"))}
    entry, leave = roles.first_pair(records.columns) or ("DT_INTER", "DT_SAIDA")
    cfg = match.MatchConfig(entry=entry, exit=leave, **{k: v for k, v in bound.items() if v}, **options)
    linked = records if "patient_id" in records.columns else link(records)
    judged = cut(match.judge(match.numbered(match.prepare(linked, codes, cfg), cfg), cfg))
    ev = match.events(judged, cfg)
    return ev, match.rejections(judged), match.transfer_edges(ev)


def state_of_nodes(all_nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    return enrich.resolve(all_nodes.select("node_id", "municipality_code"), "municipality_code", catalog).groupBy("node_id").agg(F.min("m_state").alias("state"))


def run_batch(records: DataFrame, edges: DataFrame, options: BatchOptions, catalog: DataFrame | None = None, centres: DataFrame | None = None, reference: DataFrame | None = None) -> Batch:
    """Filter the records, build and enrich their nodes, add the reference's, map and filter the edges, and check the contract.

    ``reference``: facilities with cnes, name, municipality_code and whatever tells the scope. State filters need a catalog.
    """
    if options.states and catalog is None:
        raise ValueError("a filter by state needs the catalog")
    some = ed.with_diagnosis(records, options.diagnoses)
    if options.states:
        codes = enrich.catalog_rows(catalog).select("code6", F.col("m_state").alias("state"))
        keyed = some.withColumn("_row", F.monotonically_increasing_id())
        keyed = cut(keyed)  # the row number must not change between the two uses
        some = ed.in_states(keyed, codes, options.states, "_row").drop("_row")
    out = nodes.build_nodes(some)
    if catalog is not None:
        none = out.sparkSession.createDataFrame([], "ibge_id string, lat double, lon double")
        out = enrich.enrich_municipalities(out, catalog, centres if centres is not None else none).drop("_resolved")
    if reference is not None:
        scoped = enrich.in_scope(reference, options.scope)
        extra = nodes.as_nodes(scoped, node_id=nz.facility_node(F.col("cnes")), node_type=F.lit("facility"), **{c: F.col(c) for c in ("name", "municipality_code", "latitude", "longitude") if c in scoped.columns})
        out = nodes.append_reference(out, extra.where("node_id != 'facility:'"))
    out = cut(out)
    mapped = ed.at_least(nodes.map_edges(edges, out), options.min_count)
    if options.states:
        mapped = ed.edges_in_states(mapped, state_of_nodes(out, catalog), options.states)
    mapped = cut(mapped.withColumns({"transfer_count": nz.number_or(F.col("transfer_count"), 1.0), "confidence_score": nz.number_or(F.col("confidence_score"), 0.0)}))
    covered = nodes.coverage(mapped).first().asDict()
    checked = nodes.contract(out, mapped, options.max_missing, options.min_names)
    kinds = {r.node_type: r.n for r in out.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    summary = {"tag": options.tag, "records": some.count(), "nodes": kinds, "edges": covered["edges_total"], "contract_passed": checked["passed"]}
    return Batch(out, mapped, covered, checked, summary, EXIT[checked["passed"]])


def write_batch(batch: Batch, folder: str, parquet: bool = False) -> None:
    tag = batch.summary["tag"]
    for name, df in (("nodes", batch.nodes), ("transfer_edges", batch.edges)):
        ordered = df.orderBy("node_type", "node_id") if name == "nodes" else df.orderBy("source_node_id", "target_node_id")
        sinks.write_csv_file(ordered, f"{folder}/{name}_{tag}.csv")
        if parquet:
            df.write.mode("overwrite").parquet(f"{folder}/{name}_{tag}.parquet")
    sinks.write_report(f"{folder}/summary_{tag}.json", batch.summary | {"coverage": batch.coverage})
    sinks.write_report(f"{folder}/contract_validation_{tag}.json", batch.contract)


def project_lake(source: DataFrame, root: str, with_linkage: bool = True) -> None:
    """Records with year, month and uf columns to the projected lake, with outcome features."""
    keys = [c for c in ("year", "month", "uf") if c in source.columns]
    found, _ = roles.projection(source.columns, with_linkage)
    names = [*roles.CANONICAL, *(c for c in found if c not in roles.CANONICAL)]
    columns = [(F.col(found[n]) if n in found else F.lit(None)).cast("string").alias(n) for n in names]
    sinks.save_lake(roles.outcome_features(source.select(*columns, *keys)), root, keys)


def read_year(spark: SparkSession, lake: str, year: int, months: list[int] | None = None, states: list[str] | None = None) -> DataFrame:
    """The records of a projected lake with their ``period``; no record at all raises."""
    keep = F.col("year") == year
    keep = keep & F.col("month").isin(months) if months else keep
    keep = keep & F.col("uf").isin(states) if states else keep
    rows = spark.read.parquet(lake).where(keep)
    if rows.isEmpty():
        raise FileNotFoundError(f"{lake} has no records for these filters")
    return rows.withColumn("period", F.format_string("%04d%02d", F.col("year").cast("int"), F.col("month").cast("int")))


def run_year(spark: SparkSession, lake: str, year: int, codes: list[str], months: list[int] | None = None, states: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, edges and rejections of a year from the projected lake.

    All months are one plan: matching stays within a month through its scope, edges are those of each month until they are rolled
    up, and state filters hold for records and edges alike.
    """
    rows = read_year(spark, lake, year, months, states)
    _, rejected, flows = movements(rows, codes, scope="period")
    all_nodes = cut(nodes.build_nodes(rows))
    mapped = nodes.map_edges(flows, all_nodes).withColumn("edge_type", F.lit("transfer"))
    rolled = ed.roll_up(mapped.unionByName(ed.residence_edges(rows, "period"), allowMissingColumns=True))
    v, e = graph.build(all_nodes, rolled, order="match_method")
    return v, e, rejected


@dataclass(frozen=True)
class YearOptions:
    prefix: str = "sih_br"
    year: int = 2021
    months: list[int] = field(default_factory=lambda: list(range(1, 13)))
    states: list[str] = field(default_factory=list)
    scope: str = "all"
    max_missing: float = 0.0
    min_names: float = 0.9
    transfer: bool = True
    residence: bool = True
    force: bool = False
    parquet: bool = False

    def month(self, month: int) -> BatchOptions:
        return BatchOptions(self.prefix, self.year, month, self.states, [], 1.0, self.scope, self.max_missing, self.min_names)


def run_months(spark: SparkSession, lake: str, root: str, codes: list[str], options: YearOptions, catalog: DataFrame | None = None, centres: DataFrame | None = None, reference: DataFrame | None = None) -> int:
    """Every month's nodes, edges, lookups, contract and summary under ``root``, one folder a month. The first contract that fails
    ends the run with its exit code. A month whose summary says that it passed isn't run again unless forced."""
    for month in options.months:
        batch = options.month(month)
        folder = f"{root}/{batch.tag}"
        if not options.force and (_report(f"{folder}/summary_{batch.tag}.json") or {}).get("contract_passed"):
            continue
        rows = read_year(spark, lake, options.year, [month], options.states)
        _, rejected, flows = movements(rows, codes)
        done = run_batch(rows, flows if options.transfer else flows.limit(0), batch, catalog, centres, reference)
        if options.residence:
            lives = ed.residence_edges(rows).orderBy("source_node_id", "target_node_id")
            sinks.write_csv_file(lives, f"{folder}/residence_edges_{batch.tag}.csv")
            lives.write.mode("overwrite").parquet(f"{folder}/stored/residence")
        done.edges.write.mode("overwrite").parquet(f"{folder}/stored/transfer")
        done.nodes.write.mode("overwrite").parquet(f"{folder}/stored/nodes")
        sinks.write_csv_file(nodes.facility_lookup(rows).orderBy("location_id"), f"{folder}/facility_lookup_{batch.tag}.csv")
        sinks.write_csv_file(nodes.municipality_lookup(rows).orderBy("location_id"), f"{folder}/municipality_lookup_{batch.tag}.csv")
        sinks.write_report(f"{folder}/transfer_rejections_{batch.tag}.json", {r.reason: r.n for r in rejected.collect()})
        write_batch(done, folder, options.parquet)  # the summary comes last: it says that the month is there
        if done.exit_code:
            return done.exit_code
    return 0


def year_graph(spark: SparkSession, root: str, options: YearOptions) -> tuple[DataFrame, DataFrame, dict] | None:
    """Nodes, rolled-up edges and contract of the months stored under ``root``; None if there are none."""
    every_node, every_edge = [], []
    for month in options.months:
        tag = options.month(month).tag
        if (_report(f"{root}/{tag}/summary_{tag}.json") or {}).get("contract_passed") is None:
            continue
        period = F.lit(f"{options.year}{month:02d}")
        stored = lambda name: spark.read.parquet(f"{root}/{tag}/stored/{name}").withColumn("period", period)  # noqa: B023, E731
        every_node.append(stored("nodes"))
        every_edge.append(stored("transfer").withColumn("edge_type", F.lit("transfer")))
        if options.residence and os.path.isdir(f"{root}/{tag}/stored/residence"):
            every_edge.append(stored("residence"))
    if not every_node:
        return None
    merged = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    all_nodes = cut(nodes.keep_first(merged(every_node), "node_id", ["period", F.col("name").asc_nulls_last()]).drop("period"))
    rolled = cut(ed.roll_up(merged(every_edge)))
    return all_nodes, rolled, nodes.contract(all_nodes, rolled, options.max_missing, options.min_names)


def write_year(spark: SparkSession, root: str, options: YearOptions, page: bool = True) -> int:
    """The year's nodes, edges, contract and page files from the stored months; 2 without any month or if the contract fails."""
    found = year_graph(spark, root, options)
    if found is None:
        return 2
    all_nodes, rolled, checked = found
    tag = f"{options.prefix}_{options.year}"
    sinks.write_csv_file(all_nodes.orderBy("node_type", "node_id"), f"{root}/{tag}_nodes.csv")
    sinks.write_csv_file(rolled.orderBy("source_node_id", "target_node_id", "edge_type"), f"{root}/{tag}_edges.csv")
    sinks.write_report(f"{root}/{tag}_contract_validation.json", checked)
    if checked["passed"] and page:
        sinks.export_page(all_nodes, rolled, f"{root}/ui", tag)
    return EXIT[checked["passed"]]


def _report(path: str) -> dict | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)
