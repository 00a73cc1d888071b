"""Directed weighted graphs as a pair of tables: vertices (node_id, ...) and edges (source_node_id, target_node_id, ...)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..session import beside, cut
from .edges import at_least, first_known
from .nodes import endpoints, keep_first

S, T = "source_node_id", "target_node_id"


def build(nodes: DataFrame, edges: DataFrame, min_count: float = 1.0, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges, at most one edge per ordered pair.

    Rows are thresholded before they are grouped by (source, target, type); a missing confidence counts as 0. Of the types of a
    pair the last in order wins. Endpoints that no node names become vertices without attributes; blank ids are dropped.
    """
    e = endpoints(edges)
    e = e if "edge_type" in e.columns else e.withColumn("edge_type", F.lit("transfer"))
    e = e if "transfer_count" in e.columns else e.withColumn("transfer_count", F.lit(1.0))
    e = e if "confidence_score" in e.columns else e.withColumn("confidence_score", F.lit(0.0))
    rows = at_least(e, min_count).where(f"{S} != '' AND {T} != ''").withColumn("edge_type", F.coalesce("edge_type", F.lit("transfer")))
    texts = [c for c in ("match_method", "rule_version", "assumption_revision") if c in e.columns]
    sort = order or (texts[0] if texts else "edge_type")
    grouped = rows.groupBy(S, T, "edge_type").agg(
        F.sum(nz.number_or(F.col("transfer_count"), 1.0)).alias("transfer_count"), F.avg(nz.number_or(F.col("confidence_score"), 0.0)).alias("confidence_score"),
        *[first_known(rows, c, sort).alias(c) for c in texts],
    )
    single = grouped.withColumn("_r", F.row_number().over(Window.partitionBy(S, T).orderBy(F.desc("edge_type")))).where("_r = 1").drop("_r")
    named = nodes.where(nz.text(F.col("node_id")) != "").withColumn("node_id", nz.text(F.col("node_id")))
    known = keep_first(named, "node_id", [F.col(c).asc_nulls_last() for c in ("node_type", "name", "municipality_code") if c in nodes.columns] or ["node_id"])
    ends = single.select(F.explode(F.array(S, T)).alias("node_id")).distinct().join(known, "node_id", "left_anti")
    return known.unionByName(ends, allowMissingColumns=True), single


def _ends(edges: DataFrame, weight: Column) -> DataFrame:
    """Both ends of each edge, once as source and once as target; a loop is two rows."""
    sides = F.array(F.struct(F.col(S).alias("node_id"), F.lit(1).alias("out")), F.struct(F.col(T).alias("node_id"), F.lit(0).alias("out")))
    return edges.select(F.explode(sides).alias("_e"), weight.alias("w")).select("_e.node_id", "_e.out", "w")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every vertex, plain and weighted; a loop counts once in, once out, twice in total."""
    out = F.col("out") == 1
    d = _ends(edges, F.col("transfer_count").cast("double")).groupBy("node_id").agg(
        F.count_if(~out).alias("in_degree"), F.count_if(out).alias("out_degree"), F.count(F.lit(1)).alias("degree"),
        F.sum(F.when(~out, F.col("w")).otherwise(0.0)).alias("weighted_in"), F.sum(F.when(out, F.col("w")).otherwise(0.0)).alias("weighted_out"),
        F.sum("w").alias("weighted_degree"),
    )
    j = vertices.select("node_id").join(d, "node_id", "left")
    return j.select("node_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in d.columns[1:]])


def top_degree(vertices: DataFrame, edges: DataFrame, mode: str, n: int) -> DataFrame:
    """The ``n`` vertices with the largest weighted degree (``in``, ``out`` or ``total``), with name and type; ties by id."""
    column = {"in": "weighted_in", "out": "weighted_out", "total": "weighted_degree"}[mode]
    best = degrees(vertices, edges).orderBy(F.desc(column), "node_id").limit(n).select("node_id", F.col(column).alias("weighted_degree"))
    attrs = vertices.select("node_id", F.coalesce("node_type", F.lit("unknown")).alias("node_type"), F.coalesce("name", F.lit("")).alias("name"))
    return best.join(attrs, "node_id", "left")


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density and mean degree."""
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum(F.col("transfer_count").cast("double")), F.lit(0.0)).alias("total_weight"))
    n = vertices.agg(F.count(F.lit(1)).alias("n_nodes"))
    both = beside(n, m)
    pairs = F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)
    return both.select(
        "n_nodes", "n_edges", "total_weight", F.when(F.col("n_nodes") > 1, F.round(F.col("n_edges") / pairs, 8)).otherwise(0.0).alias("density"),
        F.when(F.col("n_nodes") > 0, F.round(2 * F.col("n_edges") / F.col("n_nodes"), 6)).otherwise(0.0).alias("average_degree"),
    )


def degree_histogram(vertices: DataFrame, edges: DataFrame, bins: int = 40) -> DataFrame:
    """Equal bins from the smallest to the largest degree, the last closed; empty bins are left out. At least 5 bins."""
    bins = max(bins, 5)
    d = degrees(vertices, edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = (d.agg(f("degree").cast("double")).scalar() for f in (F.min, F.max))
    # one value only: a bin range of one around it
    j = d.select("*", lo.alias("lo"), hi.alias("hi")).withColumn("_lo", F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5))
    j = j.withColumn("_w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins)))
    b = F.least(F.floor((F.col("degree") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    return j.groupBy(b.alias("bin")).agg(F.sum("n").alias("n_nodes"), F.min(F.round(F.col("_lo") + b * F.col("_w"), 6)).alias("bin_start"))


def without_isolates(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.explode(F.array(S, T)).alias("node_id")).distinct(), "node_id", "left_semi")


def subgraph(vertices: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """As it is if within both limits; else the strongest vertices with the edges among them; if those are still too many, the
    strongest edges, and only then vertices left without an edge go."""
    vertices, edges = cut(vertices), cut(edges)  # each is looked at several times
    sizes = vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1))).agg(F.sum("v"), F.sum("e")).first()
    if (sizes[0] or 0) <= max_nodes and (sizes[1] or 0) <= max_edges:
        return vertices, edges
    keep = cut(degrees(vertices, edges).orderBy(F.desc("weighted_degree"), "node_id").limit(max_nodes).select("node_id"))
    v = vertices.join(keep, "node_id", "left_semi")
    e = cut(edges.join(keep.select(F.col("node_id").alias(S)), S, "left_semi").join(keep.select(F.col("node_id").alias(T)), T, "left_semi"))
    if e.count() <= max_edges:
        return v, e
    e = cut(e.orderBy(F.desc(F.coalesce("transfer_count", F.lit(1.0))), S, T).limit(max_edges))
    return without_isolates(v, e), e


def of_type(vertices: DataFrame, edges: DataFrame, edge_type: str) -> tuple[DataFrame, DataFrame]:
    if edge_type == "all":
        return vertices, edges
    e = edges.where(F.col("edge_type") == edge_type)
    return without_isolates(vertices, e), e


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(node_id, hop) of all vertices within ``hops`` undirected steps of the ``start`` vertices (node_id), at their least hop."""
    links = edges.select(F.explode(F.array(F.struct(F.col(S).alias("a"), F.col(T).alias("b")), F.struct(F.col(T).alias("a"), F.col(S).alias("b")))).alias("_l")).select("_l.*").distinct()
    reached = start.select("node_id").distinct().withColumn("hop", F.lit(0))
    front = reached
    for k in range(1, hops + 1):
        step = links.join(front.select(F.col("node_id").alias("a")), "a").select(F.col("b").alias("node_id")).distinct()
        front = step.join(reached.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(k))
        reached = reached.unionByName(front)
    return reached


def select_nodes(vertices: DataFrame, column: str, values: list) -> DataFrame:
    return vertices.where(F.col(column).isin(values)).select("node_id").distinct()


def select_edge_ends(edges: DataFrame, column: str, values: list) -> DataFrame:
    return edges.where(F.col(column).isin(values)).select(F.explode(F.array(S, T)).alias("node_id")).distinct()


# --- components ----------------------------------------------------------------------------------------------------------
def _rounds(most: int | None):
    """Round after round until the caller is done; more than ``most`` raise, for a part of a result is none."""
    for k in count():
        if most is not None and k >= most:
            raise RuntimeError(f"the components weren't complete after {most} rounds")
        yield k


def weak_components(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node_id, component): the smallest id that is connected, whatever the directions.

    Large-star and small-star steps by turns: every round links vertices to the smallest one they know, so the number of rounds
    grows with the logarithm of the diameter. A vertex with very many neighbours costs one partial minimum, not a group.
    Goes on until the links are stable; with ``rounds`` given, raises if they aren't by then.
    """
    links = cut(edges.select(F.col(S).alias("a"), F.col(T).alias("b")).where("a != b").distinct())
    both = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in _rounds(rounds):
        wide = both(links)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = wide.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        fresh = down.join(small, "a").select(F.col("b").alias("x"), "a", "m")
        fresh = fresh.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(fresh.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        fresh = cut(fresh)
        same = fresh.count() == links.count() and fresh.join(links, ["a", "b"], "left_anti").isEmpty()
        links = fresh
        if same:
            break
    root = links.groupBy(F.col("a").alias("node_id")).agg(F.min("b").alias("component"))
    return vertices.select("node_id").distinct().join(root, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


#: Chains are contracted while they hold at least this part of the vertices left.
CHAIN_PART = 0.1
#: Layers of trimming in one plan.
LAYERS = 3


def _followed(hop: DataFrame) -> DataFrame:
    """(node_id, to): where following ``to`` from vertex to vertex ends, by pointer doubling. Every way has to end."""
    while True:
        ahead = hop.select(F.col("node_id").alias("to"), F.col("to").alias("_far"))
        hop = cut(hop.join(ahead, "to", "left").select("node_id", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("_moved")))
        if hop.where("_moved").isEmpty():
            return hop.select("node_id", "to")
        hop = hop.select("node_id", "to")


def _contracted(rest: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Takes out chain vertices, those with one way in and one way out: the rest, its links, and (node_id, before, after) of those
    taken out. A chain vertex larger than both its neighbours stays, so that a ring doesn't vanish. None if there are too few."""
    one_out = links.groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"), F.min("b").alias("after"))
    one_in = links.groupBy(F.col("b").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("a").alias("before"))
    chain = one_out.join(one_in, "node_id").where("n_out = 1 AND n_in = 1 AND (node_id < after OR node_id < before)").select("node_id", "before", "after")
    chain = cut(chain)
    if chain.count() <= CHAIN_PART * rest.count():
        return None
    ahead = _followed(chain.select("node_id", F.col("after").alias("to"))).withColumnRenamed("to", "after")
    back = _followed(chain.select("node_id", F.col("before").alias("to"))).withColumnRenamed("to", "before")
    gone = cut(back.join(ahead, "node_id"))
    short = links.join(gone.select(F.col("node_id").alias("a")), "a", "left_anti")
    jump = gone.select(F.col("node_id").alias("b"), F.col("after").alias("_to"))
    short = short.join(jump, "b", "left").select("a", F.coalesce("_to", "b").alias("b")).where("a != b").distinct()
    return cut(rest.join(gone.select("node_id"), "node_id", "left_anti")), cut(short), gone


def strong_components(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node_id, component): the largest id among vertices that reach each other.

    Vertices without an edge in or out are their own component and are trimmed, several layers a plan; chains are contracted by
    pointer doubling. Both are repeated, which takes paths and trees apart in a number of rounds that grows with the logarithm of
    their length. In what is left every vertex takes the largest id that reaches it; those that lead back to that id within its
    colour are its component. Contracted vertices belong to their neighbours' component if both have the same.
    Goes on until every vertex has one; with ``rounds`` given, raises if some haven't by then.
    """
    spark = vertices.sparkSession
    rest = cut(vertices.select("node_id").distinct())
    links = cut(edges.select(F.col(S).alias("a"), F.col(T).alias("b")).where("a != b").distinct())
    done = [spark.createDataFrame([], "node_id string, component string")]
    chains: list[DataFrame] = []

    def among(e: DataFrame, v: DataFrame) -> DataFrame:
        return e.join(v.select(F.col("node_id").alias("a")), "a", "left_semi").join(v.select(F.col("node_id").alias("b")), "b", "left_semi")

    for _ in _rounds(rounds):
        while True:
            kept, inner = rest, links
            for _layer in range(LAYERS):
                alive = inner.select(F.col("a").alias("node_id")).distinct().join(inner.select(F.col("b").alias("node_id")).distinct(), "node_id")
                kept, inner = kept.join(alive, "node_id", "left_semi"), among(inner, alive)
            kept = cut(kept)
            trimmed = cut(rest.join(kept, "node_id", "left_anti"))
            some = not trimmed.isEmpty()
            if some:
                done.append(trimmed.withColumn("component", F.col("node_id")))
                rest, links = kept, cut(among(links, kept))
            shorter = _contracted(rest, links)
            if shorter:
                rest, links, gone = shorter
                chains.append(gone)
            if not some and not shorter:
                break
        if rest.isEmpty():
            break
        colour = rest.withColumn("c", F.col("node_id"))
        while True:
            pushed = links.join(colour.withColumnRenamed("node_id", "a"), "a").groupBy(F.col("b").alias("node_id")).agg(F.max("c").alias("_p"))
            fresh = colour.join(pushed, "node_id", "left").select("node_id", F.greatest("c", F.coalesce("_p", "c")).alias("c"), (F.coalesce("_p", "c") > F.col("c")).alias("_moved"))
            fresh = cut(fresh)
            colour = fresh.select("node_id", "c")
            if fresh.where("_moved").isEmpty():
                break
        inner = links.join(colour.select(F.col("node_id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node_id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
        inner = cut(inner.select("a", "b"))
        back = cut(colour.where("node_id = c"))
        front = back
        while True:
            step = inner.join(front.select(F.col("node_id").alias("b"), "c"), "b").select(F.col("a").alias("node_id"), "c").distinct()
            front = cut(step.join(back.select("node_id"), "node_id", "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.unionByName(front))
        done.append(back.withColumnRenamed("c", "component"))
        rest = cut(rest.join(back.select("node_id"), "node_id", "left_anti"))
        links = cut(among(links, rest))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    for gone in reversed(chains):
        known = cut(out)
        of = lambda end: known.select(F.col("node_id").alias(end), F.col("component").alias(f"_{end}"))  # noqa: B023, E731
        joined = gone.join(of("before"), "before").join(of("after"), "after")
        out = known.unionByName(joined.select("node_id", F.when(F.col("_before") == F.col("_after"), F.col("_before")).otherwise(F.col("node_id")).alias("component")))
    if chains:
        out = cut(out)
        largest = out.groupBy("component").agg(F.max("node_id").alias("_largest"))
        out = out.join(largest, "component").select("node_id", F.col("_largest").alias("component"))
    return out


def component_sizes(components: DataFrame) -> DataFrame:
    per = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return per.groupBy("size").agg(F.count(F.lit(1)).alias("n_components"))


# --- maps and pages ------------------------------------------------------------------------------------------------------
def located(nodes: DataFrame) -> DataFrame:
    lat, lon = nz.number(F.col("latitude")), nz.number(F.col("longitude"))
    return nodes.withColumns({"latitude": lat, "longitude": lon}).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def map_edges(nodes: DataFrame, edges: DataFrame, max_edges: int, min_count: float = 1.0) -> DataFrame:
    """The strongest edges with the coordinates of both ends (null where unknown), line width and whether they can be drawn."""
    place = located(nodes).groupBy("node_id").agg(F.min(F.struct("latitude", "longitude")).alias("_p"))
    top = at_least(edges, min_count).orderBy(F.desc("transfer_count"), S, T).limit(max_edges)
    for end, c in (("source", S), ("target", T)):
        top = top.join(place.select(F.col("node_id").alias("_k"), F.col("_p").alias(f"_{end}")), F.col(c) == F.col("_k"), "left").drop("_k")
    return top.select(
        S, T, "transfer_count", F.col("_source.latitude").alias("source_latitude"), F.col("_source.longitude").alias("source_longitude"),
        F.col("_target.latitude").alias("target_latitude"), F.col("_target.longitude").alias("target_longitude"),
        F.round(nz.map_line_width(F.col("transfer_count")), 6).alias("line_width"), (F.col("_source").isNotNull() & F.col("_target").isNotNull()).alias("drawn"),
    )


def map_summary(nodes: DataFrame, drawn: DataFrame) -> DataFrame:
    kind = F.lower("node_type")
    a = located(nodes).agg(
        F.count_if(kind == "facility").alias("facility_markers"), F.count_if(kind == "municipality").alias("municipality_markers"),
        F.round(F.avg("latitude"), 6).alias("centre_latitude"), F.round(F.avg("longitude"), 6).alias("centre_longitude"),
    )
    b = drawn.agg(F.count(F.lit(1)).alias("edges_considered"), F.count_if("drawn").alias("edges_drawn"), F.count_if(~F.col("drawn")).alias("edges_without_coordinates"))
    return beside(a, b)
