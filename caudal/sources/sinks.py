"""Sinks: lakes, single files for people and tools, graph files and pages.

Lake sinks write from the executors. Single-file sinks stream through the driver row by row, never holding the table.
"""

from __future__ import annotations

import csv
import html
import json
import math
import os
from collections.abc import Iterable
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz


def write_csv_file(df: DataFrame, path: str, sep: str = ";") -> int:
    """One UTF-8 file with byte order mark and header; null is empty. Returns the number of rows."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, delimiter=sep, lineterminator="\n")
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
            n += 1
    return n


def save(df: DataFrame, path: str, sep: str = ";") -> None:
    """By suffix: ``.parquet`` (a folder, from the executors) or ``.csv`` (one file)."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        write_csv_file(df, path, sep)
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")


def save_lake(df: DataFrame, root: str, by: list[str] = ["year", "month", "uf"]) -> None:  # noqa: B006
    """Replaces only the partitions that ``df`` has; a heavy partition is split over several files by its rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


def write_report(path: str, report: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="ascii") as f:
        json.dump(report, f, indent=2, ensure_ascii=True, default=str)


def page_nodes(nodes: DataFrame) -> DataFrame:
    texts = [nz.text(F.col(c)).alias(c) for c in ("node_id", "node_type", "name", "municipality_code")]
    return nodes.select(*texts, nz.number(F.col("latitude")).alias("latitude"), nz.number(F.col("longitude")).alias("longitude"))


def page_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        *[nz.text(F.col(c)).alias(c) for c in ("source_node_id", "target_node_id", "edge_type")], nz.number(F.col("transfer_count")).alias("transfer_count"),
        nz.number(F.col("confidence_score")).alias("confidence_score"), nz.text(F.col("match_method")).alias("match_method"),
    )



def write_json_lines_file(df: DataFrame, path: str) -> None:
    """One file of JSON lines, streamed through the driver; keys of null values are written."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator():
            f.write(r[0] + "\n")


def export_page(nodes: DataFrame, edges: DataFrame, folder: str, tag: str) -> dict:
    """What the map page loads: nodes, edges, and a small description that names them. A limit of 0 means none."""
    meta = {"nodes_jsonl": f"{tag}_nodes.jsonl", "edges_jsonl": f"{tag}_edges.jsonl", "defaults": {"max_nodes_default": 0, "max_edges_default": 0}}
    write_json_lines_file(page_nodes(nodes), f"{folder}/{meta['nodes_jsonl']}")
    write_json_lines_file(page_edges(edges), f"{folder}/{meta['edges_jsonl']}")
    write_report(f"{folder}/{tag}_meta.json", meta)
    return meta


def _attributes(row, names: list[str], ids: dict[str, int]) -> str:
    return "".join(f'<attvalue for="{ids[c]}" value={quoteattr(str(row[c]))}/>' for c in names if row[c] is not None)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """GEXF or GraphML by suffix; null attributes are left out."""
    if not path.endswith((".gexf", ".graphml")):
        raise ValueError(f"neither .gexf nor .graphml: {path}")
    v_names = [c for c in vertices.columns if c != "node_id"]
    e_names = [c for c in edges.columns if c not in ("source_node_id", "target_node_id")]
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n')
        (_gexf if path.endswith(".gexf") else _graphml)(f, vertices, edges, v_names, e_names)


def _gexf(f, vertices: DataFrame, edges: DataFrame, v_names: list[str], e_names: list[str]) -> None:
    f.write('<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed" mode="static">\n')
    for kind, names in (("node", v_names), ("edge", e_names)):
        f.write(f'<attributes class="{kind}" mode="static">' + "".join(f'<attribute id="{i}" title={quoteattr(c)} type="string"/>' for i, c in enumerate(names)) + "</attributes>\n")
    f.write("<nodes>\n")
    for r in vertices.toLocalIterator():
        label = r["name"] if "name" in v_names and r["name"] else r["node_id"]
        f.write(f"<node id={quoteattr(r['node_id'])} label={quoteattr(label)}><attvalues>{_attributes(r, v_names, {c: i for i, c in enumerate(v_names)})}</attvalues></node>\n")
    f.write("</nodes>\n<edges>\n")
    for i, r in enumerate(edges.toLocalIterator()):
        weight = f' weight="{r["transfer_count"]}"' if "transfer_count" in e_names and r["transfer_count"] is not None else ""
        f.write(f'<edge id="{i}" source={quoteattr(r["source_node_id"])} target={quoteattr(r["target_node_id"])}{weight}><attvalues>{_attributes(r, e_names, {c: k for k, c in enumerate(e_names)})}</attvalues></edge>\n')
    f.write("</edges></graph></gexf>\n")


def _graphml(f, vertices: DataFrame, edges: DataFrame, v_names: list[str], e_names: list[str]) -> None:
    f.write('<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
    for kind, names in (("node", v_names), ("edge", e_names)):
        f.write("".join(f'<key id="{kind}-{i}" for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>\n' for i, c in enumerate(names)))
    f.write('<graph edgedefault="directed">\n')
    data = lambda r, kind, names: "".join(f'<data key="{kind}-{i}">{html.escape(str(r[c]))}</data>' for i, c in enumerate(names) if r[c] is not None)
    for r in vertices.toLocalIterator():
        f.write(f"<node id={quoteattr(r['node_id'])}>{data(r, 'node', v_names)}</node>\n")
    for r in edges.toLocalIterator():
        f.write(f"<edge source={quoteattr(r['source_node_id'])} target={quoteattr(r['target_node_id'])}>{data(r, 'edge', e_names)}</edge>\n")
    f.write("</graph></graphml>\n")


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<svg id="g" width="100%" height="95vh" viewBox="0 0 1000 700"></svg>
<script>
const nodes = {nodes}, edges = {edges}, svg = document.getElementById("g");
const xs = nodes.map(n => n.x), ys = nodes.map(n => n.y), span = (v) => [Math.min(...v), Math.max(...v)];
const [x0, x1] = span(xs), [y0, y1] = span(ys);
const px = x => 20 + 960 * (x - x0) / ((x1 - x0) || 1), py = y => 680 - 660 * (y - y0) / ((y1 - y0) || 1);
const add = (tag, attrs, label) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", tag);
  for (const k in attrs) e.setAttribute(k, attrs[k]); const t = document.createElementNS(e.namespaceURI, "title");
  t.textContent = label; e.appendChild(t); svg.appendChild(e); }};
const at = Object.fromEntries(nodes.map(n => [n.id, n]));
for (const e of edges) if (at[e.s] && at[e.t])
  add("line", {{x1: px(at[e.s].x), y1: py(at[e.s].y), x2: px(at[e.t].x), y2: py(at[e.t].y), stroke: "#69a", "stroke-width": e.w}}, e.label);
for (const n of nodes) add("circle", {{cx: px(n.x), cy: py(n.y), r: n.r, fill: n.kind === "facility" ? "#c53" : "#38c"}}, n.label);
</script>
"""


def write_page(nodes: Iterable[dict], edges: Iterable[dict], path: str, title: str = "Flow network") -> None:
    """A page without dependencies that draws nodes {id, x, y, r, kind, label} and edges {s, t, w, label}."""
    safe = lambda items: json.dumps(list(items)).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(title=html.escape(title), nodes=safe(nodes), edges=safe(edges)))


_GRAPH_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<svg id="g" width="100%" height="95vh" viewBox="0 0 1000 700" style="background:#f8f9fb"></svg>
<script>
const nodes = {nodes}, edges = {edges}, svg = document.getElementById("g"), at = {{}};
nodes.forEach((n, i) => {{ const a = 2.399963 * i, r = 300 * Math.sqrt((i + 1) / nodes.length); n.x = 500 + r * Math.cos(a); n.y = 350 + r * Math.sin(a); n.vx = n.vy = 0; at[n.id] = n; }});
const links = edges.filter(e => at[e.s] && at[e.t]);
// springs along edges, repulsion between nodes of neighbouring cells, a pull to the middle
function step(cool) {{
  const cells = {{}};
  for (const n of nodes) (cells[(n.x >> 6) + "," + (n.y >> 6)] ||= []).push(n);
  for (const n of nodes) {{
    n.vx += (500 - n.x) * 0.004; n.vy += (350 - n.y) * 0.004;
    for (let i = -1; i < 2; i++) for (let j = -1; j < 2; j++) for (const m of cells[((n.x >> 6) + i) + "," + ((n.y >> 6) + j)] || [])
      if (m !== n) {{ const dx = n.x - m.x, dy = n.y - m.y, d = dx * dx + dy * dy + 1; n.vx += 40 * dx / d; n.vy += 40 * dy / d; }}
  }}
  for (const e of links) {{ const a = at[e.s], b = at[e.t], dx = b.x - a.x, dy = b.y - a.y; a.vx += dx * 0.01; a.vy += dy * 0.01; b.vx -= dx * 0.01; b.vy -= dy * 0.01; }}
  for (const n of nodes) {{ n.x += Math.max(-9, Math.min(9, n.vx)) * cool; n.y += Math.max(-9, Math.min(9, n.vy)) * cool; n.vx *= 0.8; n.vy *= 0.8; }}
}}
for (let k = 0; k < 200; k++) step(1 - k / 220);
const add = (tag, attrs, label) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", tag);
  for (const k in attrs) e.setAttribute(k, attrs[k]); const t = document.createElementNS(e.namespaceURI, "title"); t.textContent = label; e.appendChild(t); svg.appendChild(e); return e; }};
for (const e of links) add("line", {{x1: at[e.s].x, y1: at[e.s].y, x2: at[e.t].x, y2: at[e.t].y, stroke: "#6c757d", "stroke-opacity": 0.5, "stroke-width": e.w / 3}}, e.label);
for (const n of nodes) add("circle", {{cx: n.x, cy: n.y, r: n.r / 4, fill: {{facility: "#c53", municipality: "#38c"}}[n.kind] || "#888"}}, n.label);
svg.addEventListener("wheel", e => {{ e.preventDefault(); const v = svg.viewBox.baseVal, f = e.deltaY > 0 ? 1.15 : 0.87, x = v.x + v.width * e.offsetX / svg.clientWidth, y = v.y + v.height * e.offsetY / svg.clientHeight;
  v.x = x - (x - v.x) * f; v.y = y - (y - v.y) * f; v.width *= f; v.height *= f; }});
</script>
"""


def write_graph_page(vertices: DataFrame, edges: DataFrame, path: str, max_nodes: int = 900, max_edges: int = 1_200, edge_type: str = "all", title: str = "Flow network") -> dict:
    """A page without dependencies that lays out and draws the strongest part of a graph within both limits; returns its counters."""
    from ..operators import graph

    v, e = graph.subgraph(*graph.of_type(vertices, edges, edge_type), max_nodes, max_edges)
    size = nz.node_size(F.col("weighted_degree"))
    drawn = v.join(graph.degrees(v, e).select("node_id", size.alias("size")), "node_id", "left").orderBy("node_id")
    ns = [{"id": r.node_id, "r": r.size or 8.0, "kind": (r.node_type or "unknown").lower(), "label": "\n".join([r.name or r.node_id, r.node_id, r.node_type or "unknown", r.municipality_code or ""])} for r in drawn.collect()]  # at most max_nodes
    rows = e.select("source_node_id", "target_node_id", "edge_type", "transfer_count", "confidence_score", nz.edge_width(F.col("transfer_count")).alias("w")).orderBy("source_node_id", "target_node_id")
    es = [{"s": r.source_node_id, "t": r.target_node_id, "w": r.w, "label": f"{r.source_node_id} to {r.target_node_id}\n{r.edge_type}: {r.transfer_count}, confidence {r.confidence_score}"} for r in rows.collect()]  # at most max_edges
    safe = lambda items: json.dumps(items).replace("</", "<\\/")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(_GRAPH_PAGE.format(title=html.escape(title), nodes=safe(ns), edges=safe(es)))
    return {"nodes_drawn": len(ns), "edges_drawn": len(es), "max_nodes": max_nodes, "max_edges": max_edges, "edge_type": edge_type}


def write_bars(rows: DataFrame, x: str, y: str, path: str, title: str) -> int:
    """A bar chart as SVG, one bar a row in the order of ``x``, heights by ``y`` on a logarithmic scale; at most 1,000 bars."""
    bars = [(r[0], r[1]) for r in rows.select(x, F.col(y).cast("double")).orderBy(x).limit(1_001).collect()]
    if len(bars) > 1_000:
        raise ValueError("more than 1,000 bars")
    top = max((math.log10(1 + (v or 0)) for _, v in bars), default=0) or 1
    wide = 900 / max(len(bars), 1)
    shapes = []
    for k, (label, v) in enumerate(bars):
        high = 380 * math.log10(1 + (v or 0)) / top
        shapes.append(f'<rect x="{60 + k * wide:.1f}" y="{440 - high:.1f}" width="{max(wide - 1, 0.5):.1f}" height="{high:.1f}" fill="#38c"><title>{html.escape(f"{x} {label}: {v:g}")}</title></rect>')
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 500" font-family="sans-serif" font-size="14"><text x="500" y="30" text-anchor="middle">{html.escape(title)}</text>')
        f.write("".join(shapes) + f'<line x1="60" y1="440" x2="960" y2="440" stroke="#333"/><text x="500" y="475" text-anchor="middle">{html.escape(x)}</text><text x="20" y="250" transform="rotate(-90 20 250)" text-anchor="middle">{html.escape(y)}</text></svg>')
    return len(bars)


def write_map(nodes: DataFrame, edges: DataFrame, path: str, max_nodes: int = 5_000, max_edges: int = 2_000) -> dict:
    """The map page of the strongest edges and at most ``max_nodes`` located nodes; returns its counters."""
    from ..operators import graph

    drawn = graph.map_edges(nodes, edges, max_edges).cache()
    places = graph.located(nodes).orderBy("node_type", "node_id").limit(max_nodes)
    ns = [{"id": r.node_id, "x": r.longitude, "y": r.latitude, "r": 4 if r.node_type == "facility" else 2, "kind": r.node_type, "label": r.name or r.node_id} for r in places.collect()]
    es = [{"s": r.source_node_id, "t": r.target_node_id, "w": r.line_width, "label": f"{r.source_node_id} to {r.target_node_id}: {r.transfer_count}"} for r in drawn.where("drawn").collect()]
    write_page(ns, es, path)
    out = graph.map_summary(nodes, drawn).first().asDict()
    drawn.unpersist()
    return out
