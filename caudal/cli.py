"""Command line: ``python -m caudal COMMAND ...``. Exit code 0, or 2 when a gate, contract or input fails."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as nz
from .operators import enrich, graph, manifest, match, nodes, roles
from .plans import pipelines
from .session import build_session
from .sources import dbf, readers, sinks


def _table(spark: SparkSession, path: str, sep: str = ";", file_column: str | None = None) -> DataFrame:
    """Parquet, dBASE or delimited text, by suffix or content of the folder."""
    inside = os.listdir(path) if os.path.isdir(path) else []
    if path.lower().endswith((".dbf", ".dbc")) or any(f.lower().endswith((".dbf", ".dbc")) for f in inside):
        spark.dataSource.register(dbf.DbfSource)
        reader = spark.read.format("dbf")
        return (reader.option("file_column", file_column) if file_column else reader).load(path)
    if path.endswith(".parquet") or (os.path.isdir(path) and not any(f.endswith(".csv") for f in os.listdir(path))):
        return spark.read.parquet(path)
    return readers.read_csv(spark, path, sep)


def _codes(spark: SparkSession, path: str | None) -> list[str]:
    return readers.transfer_codes(readers.read_csv(spark, path, ",")) if path else []


def gate(spark: SparkSession, a: argparse.Namespace) -> int:
    result = roles.schema_gate(readers.read_header(spark, a.input, a.sep), len(_codes(spark, a.codes)) if a.codes else None)
    print(result)
    if a.output:
        sinks.write_report(a.output, result.as_dict())
    return pipelines.EXIT[result.passed]


def project(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _table(spark, a.input, a.sep)
    sinks.save(roles.outcome_features(roles.project(rows.limit(a.limit) if a.limit else rows, a.linkage)), a.output, a.sep)
    return 0


def matching(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _table(spark, a.input, a.sep)
    checked = roles.schema_gate(rows.columns)
    if not checked.passed:
        print(checked, file=sys.stderr)
        return 2
    linked = pipelines.link(rows) if a.strategy == "probabilistic" else rows.withColumn("patient_id", F.col(checked.roles["patient_key"])) if checked.roles["patient_key"] else None
    if linked is None or linked.where(nz.text(F.col("patient_id")) != "").isEmpty():
        print("no record has a linkage key", file=sys.stderr)
        return 2
    events, rejected, edges = pipelines.movements(linked, _codes(spark, a.codes), min_hours=a.min_hours, max_hours=a.max_hours)
    sinks.save(events.orderBy("event_id"), f"{a.output}/transfer_events.csv", a.sep)
    sinks.save(edges.orderBy("source_facility_id", "target_location_id"), f"{a.output}/transfer_edges.csv", a.sep)
    sinks.write_report(f"{a.output}/transfer_rejections.json", {r.reason: r.n for r in rejected.collect()})
    return 0


def build_nodes(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _table(spark, a.input, a.sep)
    sinks.save(nodes.build_nodes(rows).orderBy("node_type", "node_id"), f"{a.output}/nodes.csv", a.sep)
    sinks.save(nodes.facility_lookup(rows).orderBy("location_id"), f"{a.output}/facility_lookup.csv", a.sep)
    sinks.save(nodes.municipality_lookup(rows).orderBy("location_id"), f"{a.output}/municipality_lookup.csv", a.sep)
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    report = nodes.contract(_table(spark, a.nodes, a.sep), _table(spark, a.edges, a.sep), a.max_missing, a.min_names)
    print(json.dumps(report, indent=2))
    return pipelines.EXIT[report["passed"]]


def batch(spark: SparkSession, a: argparse.Namespace) -> int:
    options = pipelines.BatchOptions(a.prefix, a.year, a.month, manifest.states(a.ufs), [p for p in a.icd.split(",") if p], a.min_count, a.scope, a.max_missing, a.min_names)
    catalog = readers.read_catalog(spark, a.catalog) if a.catalog else None
    centres = readers.read_centres(spark, a.centres) if a.centres else None
    reference = _table(spark, a.reference, a.sep) if a.reference else None
    done = pipelines.run_batch(_table(spark, a.input, a.sep), _table(spark, a.edges, a.sep), options, catalog, centres, reference)
    pipelines.write_batch(done, a.output, a.parquet)
    return done.exit_code


def year(spark: SparkSession, a: argparse.Namespace) -> int:
    """Monthly artifacts and the year's graph; --graph-only takes stored months, --skip-graph ends before the graph."""
    months = sorted(manifest.numbers(a.months, 1, 12, "months", lenient=True))
    options = pipelines.YearOptions(a.prefix, a.year, months, manifest.states(a.ufs), a.scope, a.max_missing, a.min_names, not a.skip_transfer, not a.skip_residence, a.force, a.parquet)
    try:
        if not a.graph_only:
            catalog, centres = (readers.read_catalog(spark, a.catalog) if a.catalog else None), (readers.read_centres(spark, a.centres) if a.centres else None)
            places = _table(spark, a.reference, a.sep) if a.reference else None
            if code := pipelines.run_months(spark, a.input, a.output, _codes(spark, a.codes), options, catalog, centres, places):
                return code
        return 0 if a.skip_graph else pipelines.write_year(spark, a.output, options, not a.skip_page)
    except FileNotFoundError as err:
        print(err, file=sys.stderr)
        return 2


def year_plan(spark: SparkSession, a: argparse.Namespace) -> int:
    """The year's graph as one plan, without monthly artifacts."""
    months = sorted(manifest.numbers(a.months, 1, 12, "months", lenient=True))
    try:
        v, e, rejected = pipelines.run_year(spark, a.input, a.year, _codes(spark, a.codes), months, manifest.states(a.ufs))
    except FileNotFoundError as err:
        print(err, file=sys.stderr)
        return 2
    sinks.export_page(v, e, a.output, f"year_{a.year}")
    sinks.write_graph(v, e, f"{a.output}/graph_{a.year}.{a.format}")
    sinks.write_report(f"{a.output}/summary_{a.year}.json", graph.summary(v, e).first().asDict() | {"rejections": {r.reason: r.n for r in rejected.collect()}})
    return 0


def metrics(spark: SparkSession, a: argparse.Namespace) -> int:
    v, e = graph.build(_table(spark, a.nodes, a.sep), _table(spark, a.edges, a.sep), a.min_count)
    report = graph.summary(v, e).first().asDict()
    report |= {f"top_{m}": [r.asDict() for r in graph.top_degree(v, e, m, a.top).collect()] for m in ("in", "out", "total")}
    report["weak_components"] = {r.size: r.n_components for r in graph.component_sizes(graph.weak_components(v, e)).collect()}
    report["strong_components"] = {r.size: r.n_components for r in graph.component_sizes(graph.strong_components(v, e)).collect()}
    report["degree_histogram"] = [r.asDict() for r in graph.degree_histogram(v, e, a.bins).orderBy("bin").collect()]
    print(json.dumps(report, indent=2))
    return 0


def page(spark: SparkSession, a: argparse.Namespace) -> int:
    """The graph page, of a stored graph file or of nodes and edges."""
    v, e = readers.read_graph(spark, a.graph) if a.graph else graph.build(_table(spark, a.nodes, a.sep), _table(spark, a.edges, a.sep), a.min_count)
    print(json.dumps(sinks.write_graph_page(v, e, a.output, a.max_nodes, a.max_edges, a.type)))
    return 0


def plots(spark: SparkSession, a: argparse.Namespace) -> int:
    """Degree histogram and sizes of components as SVG files."""
    v, e = graph.build(_table(spark, a.nodes, a.sep), _table(spark, a.edges, a.sep), a.min_count)
    sinks.write_bars(graph.degree_histogram(v, e, a.bins), "bin_start", "n_nodes", f"{a.output}/degree_histogram.svg", "Degrees")
    for name, parts in (("weak", graph.weak_components(v, e)), ("strong", graph.strong_components(v, e))):
        sinks.write_bars(graph.component_sizes(parts), "size", "n_components", f"{a.output}/{name}_components.svg", f"Sizes of {name} components")
    return 0


def draw(spark: SparkSession, a: argparse.Namespace) -> int:
    v, e = graph.build(_table(spark, a.nodes, a.sep), _table(spark, a.edges, a.sep), a.min_count)
    e = graph.of_type(v, e, a.type)[1]
    print(json.dumps(sinks.write_map(_table(spark, a.nodes, a.sep), e, a.output, a.max_nodes, a.max_edges)))
    return 0


def reference(spark: SparkSession, a: argparse.Namespace) -> int:
    """The facility catalog of a competence from raw establishment files, the municipality catalog and caches."""
    raw = _table(spark, a.input, a.sep, file_column="_file")
    state = F.upper(F.regexp_extract("_file", manifest.ESTABLISHMENTS.pattern, 1)) if "_file" in raw.columns else F.lit("")
    flags = {c: F.col(c.upper()) if c.upper() in raw.columns else F.lit(None).cast("string") for c in ("vinc_sus", "atendhos", "leithosp", "niv_dep", "nat_jur")}
    rows = raw.select(nz.facility_code(F.col("CNES")).alias("cnes"), nz.code6_loose(F.col("CODUFMUN")).alias("municipality_code"), state.alias("uf"), *[v.alias(k) for k, v in flags.items()])
    rows = nodes.keep_first(rows.where("cnes != '' AND municipality_code != ''"), "cnes", ["municipality_code"])
    places = enrich.municipality_reference(readers.read_catalog(spark, a.catalog), readers.read_centres(spark, a.centres))
    full = enrich.facility_reference(rows, places, readers.read_facilities(spark, a.cache), manifest.competence(a.competence))
    kept = enrich.in_scope(rows, a.scope).select("cnes")
    sinks.save(full.join(kept, "cnes", "left_semi").orderBy("cnes"), a.output, a.sep)
    print(json.dumps(enrich.reference_counters(full).first().asDict()))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="caudal", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)

    def command(f, name: str, *required: str, **optional) -> None:
        p = sub.add_parser(name, help=f.__doc__)
        p.set_defaults(run=f)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for o, default in ({"sep": ";"} | optional).items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else str}
            p.add_argument(f"--{o.replace('_', '-')}", **kind)

    command(gate, "gate", "input", codes=None, output=None)
    command(project, "project", "input", "output", linkage=False, limit=0)
    command(matching, "match", "input", "output", codes=None, strategy="probabilistic", min_hours=24, max_hours=48)
    command(build_nodes, "nodes", "input", "output")
    command(validate, "validate", "nodes", "edges", max_missing=0.0, min_names=0.9)
    command(batch, "batch", "input", "edges", "output", prefix="batch", year=2021, month=1, ufs="ALL", icd="", min_count=1.0, scope="all", max_missing=0.0, min_names=0.9, catalog=None, centres=None, reference=None, parquet=False)
    command(year, "year", "input", "output", prefix="sih_br", year=2021, months="1-12", ufs="ALL", codes=None, scope="all", max_missing=0.0, min_names=0.9, catalog=None, centres=None, reference=None,
            graph_only=False, skip_graph=False, skip_transfer=False, skip_residence=False, skip_page=False, force=False, parquet=False)
    command(year_plan, "year-plan", "input", "output", year=2021, months="1-12", ufs="ALL", codes=None, format="gexf")
    command(metrics, "metrics", "nodes", "edges", min_count=1.0, top=20, bins=40)
    command(page, "page", "output", graph=None, nodes=None, edges=None, type="all", min_count=1.0, max_nodes=900, max_edges=1200)
    command(plots, "plots", "nodes", "edges", "output", min_count=1.0, bins=40)
    command(draw, "map", "nodes", "edges", "output", type="all", min_count=1.0, max_nodes=5000, max_edges=2000)
    command(reference, "reference", "input", "output", "catalog", "centres", "cache", competence="2101", scope="public_hospitals")
    args = ap.parse_args(argv)
    try:
        return args.run(spark or build_session(), args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
