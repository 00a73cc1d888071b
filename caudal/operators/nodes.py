"""Nodes, lookups and the mapping of edges onto nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..session import beside
from .roles import ROLES, first_available

NODE_SCHEMA = {
    "node_id": "string", "node_type": "string", "name": "string", "municipality_code": "string", "latitude": "double",
    "longitude": "double", "capacity_beds": "long", "habilitation_level": "string",
}


def as_nodes(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in NODE_SCHEMA.items()])


def keep_first(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """One row per key, the first in an explicit order. Null keys form one group."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def _facility_field(records: DataFrame) -> str:
    if not (c := first_available(records.columns, ROLES["node_facility"])):
        raise ValueError("no facility field")
    return c


def facility_lookup(records: DataFrame) -> DataFrame:
    """Facilities with the most frequent non-blank municipality, the smallest on ties; null where all are blank."""
    facility, place = _facility_field(records), first_available(records.columns, ROLES["facility_municipality"])
    rows = records.select(nz.text(F.col(facility)).alias("location_id"), F.nullif(nz.text(F.col(place)), F.lit("")).alias("p") if place else F.lit(None).cast("string").alias("p"))
    counts = rows.where("location_id != ''").groupBy("location_id", "p").agg(F.count(F.lit(1)).alias("n"))
    # counts first: a facility that holds a third of all rows is a few rows here
    best = F.min(F.when(F.col("p").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("p"))))
    return counts.groupBy("location_id").agg(best["p"].alias("municipality_code")).select("location_id", F.concat(F.lit("facility:"), "location_id").alias("node_id"), "municipality_code")


def municipality_lookup(records: DataFrame) -> DataFrame:
    """All municipality codes of all records, also of those without a facility."""
    fields = list(dict.fromkeys(c for c in (*ROLES["node_municipality"], *ROLES["facility_municipality"][:1]) if c in records.columns))
    cells = F.array(*[nz.text(F.col(c)) for c in fields]) if fields else F.array().cast("array<string>")
    codes = records.select(F.explode(cells).alias("location_id")).where("location_id != ''").distinct()
    return codes.select("location_id", F.concat(F.lit("municipality:"), "location_id").alias("node_id"))


def build_nodes(records: DataFrame) -> DataFrame:
    f, m = facility_lookup(records), municipality_lookup(records)
    return as_nodes(f, node_id=F.col("node_id"), node_type=F.lit("facility"), municipality_code=F.col("municipality_code")).unionByName(
        as_nodes(m, node_id=F.col("node_id"), node_type=F.lit("municipality"), municipality_code=F.col("location_id"))
    )


def append_municipalities(nodes: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Adds municipality nodes for the codes that have none; both sides in node spelling."""
    have = nodes.where(F.lower("node_type") == "municipality").select(nz.municipality_for_nodes(F.col("municipality_code")).alias("c")).distinct()
    want = codes.select(nz.municipality_for_nodes(F.col(code)).alias("c")).where("c != ''").distinct()
    new = want.join(have, "c", "left_anti")
    return nodes.unionByName(as_nodes(new, node_id=F.concat(F.lit("municipality:"), "c"), node_type=F.lit("municipality"), municipality_code=F.col("c")), allowMissingColumns=True)


def append_reference(nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds reference nodes whose ids aren't there yet; existing nodes win, blank ids go, of repeated ids the first by name stays."""
    both = nodes.withColumn("_o", F.lit(0)).unionByName(reference.where(nz.text(F.col("node_id")) != "").withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, "node_id", ["_o", F.col("name").asc_nulls_last(), F.col("municipality_code").asc_nulls_last()]).drop("_o")


def known_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select(nz.text(F.col("node_id")).alias("_known")).where("_known != ''").distinct()


def flag_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds source_node_exists and target_node_exists, one existence join per end."""
    known = known_ids(nodes)
    out = edges
    for end in ("source", "target"):
        k = known.select(F.col("_known").alias(f"_{end}"))
        out = out.join(k, nz.text(F.col(f"{end}_node_id")) == F.col(f"_{end}"), "left").withColumn(f"{end}_node_exists", F.col(f"_{end}").isNotNull()).drop(f"_{end}")
    return out


def map_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    out = edges.drop("source_node_id", "target_node_id", "source_node_exists", "target_node_exists").withColumns({
        "source_node_id": nz.facility_node(F.col("source_facility_id")),
        "target_node_id": nz.location_node(F.col("target_location_id"), F.col("target_location_type")),
    })
    return flag_known(out, nodes) if nodes is not None else out


def endpoints(edges: DataFrame) -> DataFrame:
    """Edges with node ids: those they have, or built ones."""
    if {"source_node_id", "target_node_id"} <= set(edges.columns):
        return edges.withColumns({c: nz.text(F.col(c)) for c in ("source_node_id", "target_node_id")})
    if missing := {"source_facility_id", "target_location_id", "target_location_type"} - set(edges.columns):
        raise ValueError(f"edges lack {', '.join(sorted(missing))}")
    return map_edges(edges)


def coverage(mapped: DataFrame) -> DataFrame:
    if not {"source_node_exists", "target_node_exists"} <= set(mapped.columns):
        raise ValueError("edges have not been mapped")
    n = F.count(F.lit(1))
    s, t = F.count_if(~F.col("source_node_exists")), F.count_if(~F.col("target_node_exists"))
    return mapped.agg(n.alias("edges_total"), s.alias("source_missing"), t.alias("target_missing"), nz.ratio(s, n).alias("source_missing_ratio"), nz.ratio(t, n).alias("target_missing_ratio"))


# --- contract ------------------------------------------------------------------------------------------------------------
NODE_NEEDS, EDGE_NEEDS = {"node_id", "node_type", "municipality_code"}, {"source_node_id", "target_node_id", "transfer_count"}


def contract_metrics(nodes: DataFrame, edges: DataFrame, strict_nulls: bool = False) -> DataFrame:
    """One row of counts. Null transfer counts are invalid only if ``strict_nulls``."""
    if missing := sorted((NODE_NEEDS - set(nodes.columns)) | (EDGE_NEEDS - set(edges.columns))):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    node_id, name = nz.text(F.col("node_id")), nz.text(F.col("name")) if "name" in nodes.columns else F.lit("")
    per = nodes.groupBy(node_id.alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.lower(nz.text(F.col("node_type"))).isin("facility", "municipality")).alias("bad"), F.count_if(name != "").alias("named")
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    of_nodes = per.agg(
        total.alias("nodes_total"), F.coalesce(F.sum(F.when(F.col("id") == "", F.col("n"))), F.lit(0)).alias("empty_node_id_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_node_id_rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_node_type_rows"),
        nz.ratio(F.coalesce(F.sum("named"), F.lit(0)), total).alias("node_name_coverage"),
    )
    count = nz.number(F.col("transfer_count"))
    invalid = F.coalesce(count < 1, F.lit(strict_nulls))
    n, s, t = F.count(F.lit(1)), F.count_if(~F.col("source_node_exists")), F.count_if(~F.col("target_node_exists"))
    of_edges = flag_known(edges.drop("source_node_exists", "target_node_exists"), nodes).agg(
        n.alias("edges_total"), F.count_if(invalid).alias("invalid_transfer_count_rows"), s.alias("source_node_missing_rows"), t.alias("target_node_missing_rows"),
        nz.ratio(s + t, 2 * n).alias("missing_node_reference_ratio"),
    )
    return beside(of_nodes, of_edges)


def contract(nodes: DataFrame, edges: DataFrame, max_missing: float = 0.0, min_names: float = 0.9, strict_nulls: bool = False) -> dict:
    """Metrics, errors, warnings and whether it passed."""
    try:
        m = contract_metrics(nodes, edges, strict_nulls).first().asDict()
    except ValueError as e:
        return {"passed": False, "errors": [str(e)], "warnings": [], "metrics": {}}
    errors = [f"{m[k]} {k}" for k in ("empty_node_id_rows", "duplicate_node_id_rows", "invalid_node_type_rows", "invalid_transfer_count_rows") if m[k]]
    if m["missing_node_reference_ratio"] > max_missing:
        errors.append(f"missing_node_reference_ratio {m['missing_node_reference_ratio']} is above {max_missing}")
    warnings = [f"node_name_coverage {m['node_name_coverage']} is below {min_names}"] if m["node_name_coverage"] < min_names else []
    return {"passed": not errors, "errors": errors, "warnings": warnings, "metrics": m}
