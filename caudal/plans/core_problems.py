"""Queries p2 to p5 over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import drift, orphans, profile, skew
from ..session import cut, shared_folder, table


# --- p2: references to records that do not exist -------------------------------------------------------------------------
def node_references(spark: SparkSession, d: str) -> DataFrame:
    """All non-null node references of both tables, in one spelling."""
    edges, lookup = table(spark, d, "transfer_edges"), table(spark, d, "facility_lookup")

    def refs(rows: DataFrame, name: str, key: str, column: str) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).select(
            F.lit(name).alias("table_name"), F.col(key).cast("long").alias("row_key"), F.lit(column).alias("ref_column"),
            F.col("cmpt").alias("period"), fields.node_reference(F.col(column)).alias("ref_key"), F.col("loaded_at").cast("timestamp").alias("seen_at"),
        )

    return (
        refs(edges, "transfer_edges", "edge_row", "source_node_id")
        .unionByName(refs(edges, "transfer_edges", "edge_row", "target_node_id"))
        .unionByName(refs(lookup, "facility_lookup", "lookup_row", "node_id"))
    )


def _tracked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = table(spark, d, "nodes").withColumn("ref_key", fields.node_reference(F.col("node_id")))
    return orphans.track_orphans(node_references(spark, d), nodes, "ref_key", "created_at", "removed_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d)[0].select("table_name", "row_key", "ref_column")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans and references per table and month."""
    every = node_references(spark, d).groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_refs"))
    found = _tracked(spark, d)[0].groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
    join = every.alias("e").join(found.alias("f"), (F.col("e.table_name") == F.col("f.table_name")) & F.col("e.period").eqNullSafe(F.col("f.period")), "left")
    return join.select("e.table_name", F.col("e.period").alias("cmpt"), "n_refs", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"))


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What waits at the end of each month, and what opened, was resolved or reopened in it."""
    return _tracked(spark, d)[1].withColumn("epoch", F.col("epoch").cast("timestamp_ntz"))


# --- p3: column profiles -------------------------------------------------------------------------------------------------
P3_COLUMNS = (
    "feed", "cmpt", "cnes", "cgc_hosp", "n_aih", "cep", "munic_res", "nasc", "sexo", "idade", "dt_inter", "dt_saida",
    "diag_princ", "cobranca", "dias_perm", "marca_uti", "proc_rea", "val_tot", "raca_cor",
)
P3_ALL_COLUMNS = (*P3_COLUMNS, "arrived_at", "stay_id")


def _stored(spark: SparkSession, rows: DataFrame, columns: list[str]) -> profile.ValueStore:
    store = profile.ValueStore(spark, shared_folder(spark))
    store.apply(profile.value_deltas(rows, columns), "first")
    return store


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stays = table(spark, d, "stays")
    store = _stored(spark, stays, list(profile.RULES)).counts()
    changes = profile.load_changes(store).select("load_id", "column_name", "finding", F.lit(0).cast("long").alias("stay_id"))
    bad = profile.violations(store, stays, "stay_id").select("load_id", "column_name", F.lit("bad_value").alias("finding"), "stay_id")
    return bad.unionByName(changes)


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every load and column of stays, from value counts alone."""
    return profile.load_profile(_stored(spark, table(spark, d, "stays"), list(P3_COLUMNS)).counts())


def p3_profile_all(spark: SparkSession, d: str) -> DataFrame:
    """Every load and every column of stays, all by rules of their own, with ranges of what the values mean."""
    return profile.full_profile(_stored(spark, table(spark, d, "stays"), list(P3_ALL_COLUMNS)).counts())


def p3_changes_all(spark: SparkSession, d: str) -> DataFrame:
    """The loads in which any column of stays changed against the load before."""
    return profile.load_changes(_stored(spark, table(spark, d, "stays"), list(P3_ALL_COLUMNS)).counts(), profile.ALL_RULES)


def p3_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The profile of the table as it stands after all loads, then with the lines resent under a new stay_id taken back out."""
    stays = table(spark, d, "stays").withColumn("load_id", F.lit(0).cast("long"))
    store = _stored(spark, stays, list(profile.RULES))
    number = fields.trimmed(F.col("n_aih"))
    first = stays.where(number.isNotNull()).groupBy(number.alias("_aih")).agg(F.min("stay_id").alias("_first"))
    resent = stays.join(first, number == F.col("_aih")).where(F.col("stay_id") != F.col("_first"))
    store.apply(profile.value_deltas(resent, list(profile.RULES), sign=-1), "withdrawn")
    return profile.load_profile(store.counts())


# --- p4: drifting schemas ------------------------------------------------------------------------------------------------
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "raw_records")).select("file_id", "change_kind", "field_name", "prior_name")


def p4_retyped(spark: SparkSession, d: str) -> DataFrame:
    """The changes of how a field is written, with both writings."""
    changes = drift.schema_changes(table(spark, d, "raw_records")).where("change_kind = 'retyped'")
    return changes.select("stream_id", "file_id", "field_name", "prior_writing", "new_writing")


def p4_field_moves(spark: SparkSession, d: str) -> DataFrame:
    """Names that come and go, whether renamed or not: ``come`` and ``gone`` as sorted lists per file."""
    changes = drift.schema_changes(table(spark, d, "raw_records")).where("change_kind != 'retyped'")
    come = F.when(F.col("change_kind") != "removed", F.col("field_name"))
    gone = F.when(F.col("change_kind") == "removed", F.col("field_name")).when(F.col("change_kind") == "renamed", F.col("prior_name"))
    lists = changes.groupBy("stream_id", "file_id").agg(F.array_sort(F.collect_list(come)).alias("come"), F.array_sort(F.collect_list(gone)).alias("gone"))
    return lists.select("stream_id", "file_id", F.array_join("come", ",").alias("come"), F.array_join("gone", ",").alias("gone"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_records")
    counts = cut(drift.cell_counts(raw, True))
    changes = cut(drift.schema_changes(raw, counts))
    return drift.unified(raw, changes, ["raw_id", "stream_id", "file_id", "family", "cmpt", "line_no"], counts)[0]


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_versions(drift.cell_counts(table(spark, d, "raw_records")))


# --- p5: a few keys holding most records ---------------------------------------------------------------------------------
P5_SHARE = 0.04
P5_TOP = 3


def _p5_rows(spark: SparkSession, d: str) -> DataFrame:
    target = fields.facility7(F.col("target_location_id"))
    kind = F.lower(F.trim("target_location_type"))
    return table(spark, d, "transfer_edges").select(
        fields.facility7(F.col("source_facility_id")).alias("source_facility_id"),
        F.when(kind == "facility", target).otherwise(F.nullif(F.trim("target_location_id"), F.lit(""))).alias("target_id"),
        "transfer_count",
    )


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _p5_rows(spark, d)
    heavy = skew.heavy_keys(rows, "source_facility_id")
    return skew.salted_totals(rows, "source_facility_id", "transfer_count", heavy).withColumnRenamed("total", "sum_transfer_count")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    totals = p5_totals(spark, d)
    total = table(spark, d, "transfer_edges").count()
    return totals.where(F.col("source_facility_id").isNotNull() & (F.col("n_rows") * 100 >= F.lit(total) * int(P5_SHARE * 100))).select("source_facility_id")


def p5_top_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = _p5_rows(spark, d).where(F.col("source_facility_id").isNotNull())
    heavy = skew.heavy_keys(rows, "source_facility_id")
    top = skew.salted_top(rows, "source_facility_id", "target_id", "transfer_count", P5_TOP, heavy)
    return top.withColumnRenamed("strength", "sum_transfer_count")


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p2_snapshots, p3_found, p3_profile, p3_profile_all, p3_changes_all, p3_deltas, p4_found, p4_retyped, p4_field_moves, p4_unified, p4_versions, p5_found, p5_totals, p5_top_targets)}


# --- SQL -----------------------------------------------------------------------------------------------------------------
def _ref_sql(c: str) -> str:
    v = f"lower(trim({c}))"
    return (
        f"CASE WHEN regexp_full_match({v}, 'facility:[0-9]{{1,6}}') THEN 'facility:' || lpad(substr({v}, 10), 7, '0') "
        f"WHEN regexp_full_match({v}, 'municipality:[0-9]{{7}}') THEN substr({v}, 1, 19) ELSE {v} END"
    )


_REFS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {k} AS row_key, '{c}' AS ref_column, cmpt, {_ref_sql(c)} AS ref_key, loaded_at FROM {t} WHERE {c} IS NOT NULL"
    for t, k, c in (("transfer_edges", "edge_row", "source_node_id"), ("transfer_edges", "edge_row", "target_node_id"), ("facility_lookup", "lookup_row", "node_id"))
)
_ALIVE = f"EXISTS (SELECT 1 FROM (SELECT {_ref_sql('node_id')} AS node_key, created_at, removed_at FROM nodes) n WHERE n.node_key = r.ref_key AND n.created_at <= r.loaded_at AND (n.removed_at IS NULL OR n.removed_at > r.loaded_at))"

_DAY = (
    "CASE WHEN regexp_full_match(trim({c}), '[0-9]{{8}}') THEN try_strptime(trim({c}), '%Y%m%d') "
    "WHEN regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(trim({c}), '%Y-%m-%d') END"
)
_STATES = ", ".join(f"'{s}'" for s in fields.STATE_CODES)
_WELL = {
    "munic_res": f"regexp_full_match(trim(munic_res), '[0-9]{{6,7}}') AND substr(trim(munic_res), 1, 2) IN ({_STATES})",
    "nasc": "coalesce(" + _DAY.format(c="nasc") + " BETWEEN TIMESTAMP '1900-01-01' AND TIMESTAMP '2021-12-31', false)",
    "dt_inter": "coalesce(CASE WHEN regexp_full_match(trim(dt_inter), '[0-9]{14}') THEN try_strptime(trim(dt_inter), '%Y%m%d%H%M%S') "
    "WHEN regexp_full_match(trim(dt_inter), '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN try_strptime(trim(dt_inter), '%Y-%m-%d %H:%M:%S') END "
    "BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2021-12-31 23:59:59', false)",
    "cgc_hosp": "(regexp_full_match(trim(cgc_hosp), '[0-9]{14}') OR regexp_full_match(trim(cgc_hosp), '[0-9]{2}\\.[0-9]{3}\\.[0-9]{3}/[0-9]{4}-[0-9]{2}')) "
    "AND length(replace(regexp_replace(trim(cgc_hosp), '[^0-9]', '', 'g'), substr(trim(cgc_hosp), 1, 1), '')) > 0",
}
_ALT = {"munic_res": "length(trim(munic_res)) = 7", "nasc": "contains(nasc, '-')", "dt_inter": "NOT contains(dt_inter, '-')", "cgc_hosp": "contains(cgc_hosp, '/')"}
_CELLS = " UNION ALL ".join(
    f"SELECT load_id, '{c}' AS column_name, stay_id, nullif(trim({c}), '') AS v, CASE WHEN nullif(trim({c}), '') IS NOT NULL THEN {w} END AS well, {_ALT[c]} AS alt FROM stays"
    for c, w in _WELL.items()
)
_P3_FOUND = f"""
WITH cells AS ({_CELLS}),
c AS (SELECT load_id, column_name, v, any_value(well) AS well, any_value(alt) AS alt, count(*) AS n FROM cells GROUP BY 1, 2, 3),
p AS (SELECT load_id, column_name, sum(n) AS n, coalesce(sum(n) FILTER (v IS NULL), 0) AS blank, coalesce(max(n) FILTER (v IS NOT NULL), 0) AS top,
      coalesce(sum(n) FILTER (well), 0) AS well, coalesce(sum(n) FILTER (well AND alt), 0) AS alt FROM c GROUP BY 1, 2),
q AS (SELECT a.load_id, a.column_name, a.blank / a.n - b.blank / b.n AS d_null,
      CASE WHEN a.n > a.blank AND b.n > b.blank THEN a.top / (a.n - a.blank) - b.top / (b.n - b.blank) END AS d_top,
      CASE WHEN a.well > 0 AND b.well > 0 THEN a.alt / a.well - b.alt / b.well END AS d_form FROM p a JOIN p b ON a.column_name = b.column_name AND a.load_id = b.load_id + 1),
g AS (SELECT load_id, substr(v, 1, 2) AS s, sum(n) AS n FROM c WHERE column_name = 'munic_res' AND well GROUP BY 1, 2),
gs AS (SELECT load_id, s, n / sum(n) OVER (PARTITION BY load_id) AS share FROM g),
gd AS (SELECT load_id, s, sum(share) AS d FROM (SELECT load_id, s, share FROM gs UNION ALL SELECT load_id + 1, s, -share FROM gs) GROUP BY 1, 2),
gr AS (SELECT load_id, sum(abs(d)) / 2 AS d FROM gd GROUP BY 1 HAVING load_id IN (SELECT load_id FROM gs) AND load_id - 1 IN (SELECT load_id FROM gs))
SELECT load_id, column_name, 'bad_value' AS finding, stay_id FROM cells WHERE well = false
UNION ALL SELECT load_id, column_name, 'null_change', 0 FROM q WHERE abs(d_null) >= 0.10 - 1e-9
UNION ALL SELECT load_id, column_name, 'top_change', 0 FROM q WHERE abs(d_top) >= 0.15 - 1e-9
UNION ALL SELECT load_id, column_name, 'form_change', 0 FROM q WHERE abs(d_form) >= 0.30 - 1e-9
UNION ALL SELECT load_id, 'munic_res', 'region_change', 0 FROM gr WHERE d >= 0.40 - 1e-9
"""


def _profile_sql(cells: str) -> str:
    known = f"column_name IN ({', '.join(repr(c) for c in _WELL)})"
    return f"""
WITH cells AS ({cells}),
c AS (SELECT load_id, column_name, v, any_value(well) AS well, any_value(alt) AS alt, count(*) AS n FROM cells GROUP BY 1, 2, 3)
SELECT load_id, column_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_blank, count(v) AS n_distinct,
  min(v) AS min_value, max(v) AS max_value, CASE WHEN {known} THEN CAST(coalesce(sum(n) FILTER (well = false), 0) AS BIGINT) END AS n_bad,
  CASE WHEN {known} THEN CAST(coalesce(sum(n) FILTER (well), 0) AS BIGINT) END AS n_well, CASE WHEN {known} THEN CAST(coalesce(sum(n) FILTER (well AND alt), 0) AS BIGINT) END AS n_alt,
  CAST(coalesce(max(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS n_top,
  round(greatest(coalesce(log2(sum(n) FILTER (v IS NOT NULL)) - sum(n * log2(n)) FILTER (v IS NOT NULL) / (sum(n) FILTER (v IS NOT NULL)), 0), 0), 6) AS entropy
FROM c GROUP BY 1, 2
"""


def _plain_cells(columns: tuple[str, ...]) -> str:
    out = [_CELLS]
    out += [f"SELECT load_id, '{c}', stay_id, nullif(trim({c}), ''), NULL::BOOLEAN, NULL::BOOLEAN FROM stays" for c in columns if c not in _WELL]
    return " UNION ALL ".join(out)


_FAC = "nullif(CASE WHEN regexp_full_match({v}, '[0-9]{{1,6}}') THEN lpad({v}, 7, '0') ELSE {v} END, '')"
_SRC = _FAC.format(v="regexp_replace(trim(source_facility_id), '\\.0$', '')")
_TGT = _FAC.format(v="regexp_replace(trim(target_location_id), '\\.0$', '')")

_P4_FIELDS = r"""
WITH lines AS (SELECT stream_id, file_id, payload, unnest(json_keys(payload)) AS field FROM raw_records
  WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND len(json_keys(payload)) = len(list_distinct(json_keys(payload)))),
cells AS (SELECT stream_id, file_id, field, json_type(payload, '$."' || field || '"') AS t, json_extract_string(payload, '$."' || field || '"') AS v FROM lines),
w AS (SELECT stream_id, file_id, field, CASE WHEN t = 'NULL' THEN NULL WHEN t IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN 'number'
  WHEN regexp_full_match(v, '[0-9]+') THEN 'digits' WHEN regexp_full_match(v, '[-+]?[0-9]+\.[0-9]+') THEN 'decimal point'
  WHEN regexp_full_match(v, '[-+]?[0-9]+,[0-9]+') THEN 'decimal comma' WHEN regexp_full_match(v, '[0-9]+(-[0-9]+)+') THEN 'dashes'
  WHEN regexp_full_match(v, '[0-9]+(/[0-9]+)+') THEN 'slashes' WHEN regexp_full_match(v, '[0-9./,-]+') THEN 'punctuation' ELSE 'text' END AS w FROM cells),
n AS (SELECT stream_id, file_id, field, w, count(w) AS n FROM w GROUP BY ALL),
u AS (SELECT stream_id, file_id, field, w FROM n QUALIFY row_number() OVER (PARTITION BY stream_id, file_id, field ORDER BY n DESC, w DESC) = 1)
"""
_P4_RETYPED = _P4_FIELDS + """
SELECT a.stream_id, a.file_id, a.field AS field_name, b.w AS prior_writing, a.w AS new_writing FROM u a JOIN u b ON a.stream_id = b.stream_id AND a.file_id = b.file_id + 1 AND a.field = b.field WHERE a.w <> b.w
"""
_P4_MOVES = _P4_FIELDS + """,
f AS (SELECT DISTINCT stream_id, file_id FROM u), two AS (SELECT a.stream_id, a.file_id FROM f a JOIN f b ON a.stream_id = b.stream_id AND a.file_id = b.file_id + 1),
c AS (SELECT two.*, u.field, true AS come FROM two JOIN u USING (stream_id, file_id) WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.stream_id = two.stream_id AND b.file_id = two.file_id - 1 AND b.field = u.field)
  UNION ALL SELECT two.*, b.field, false FROM two JOIN u b ON b.stream_id = two.stream_id AND b.file_id = two.file_id - 1 WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.stream_id = two.stream_id AND u.file_id = two.file_id AND u.field = b.field))
SELECT stream_id, file_id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (come), '') AS come, coalesce(string_agg(field, ',' ORDER BY field) FILTER (NOT come), '') AS gone FROM c GROUP BY 1, 2
"""
_P4_VERSIONS = _P4_FIELDS + """,
p AS (SELECT stream_id, file_id, sha1(array_to_string(list_sort(list(field || '=' || coalesce(w, 'null'))), chr(10))) AS fingerprint, count(*) AS n_fields FROM u GROUP BY ALL),
c AS (SELECT *, CASE WHEN lag(fingerprint) OVER (PARTITION BY stream_id ORDER BY file_id) IS NOT DISTINCT FROM fingerprint THEN 0 ELSE 1 END AS c FROM p)
SELECT stream_id, file_id, fingerprint, n_fields, CAST(sum(c) OVER (PARTITION BY stream_id ORDER BY file_id) AS BIGINT) AS schema_version FROM c
"""

_P2_SNAPSHOTS = f"""
WITH r AS (SELECT table_name, cmpt AS period, ref_key, loaded_at, date_trunc('month', loaded_at) AS month, NOT {_ALIVE} AS orphan FROM ({_REFS}) r),
e AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM r),
k AS (SELECT ref_key, month, EXISTS (SELECT 1 FROM (SELECT {_ref_sql('node_id')} AS node_key, created_at, removed_at FROM nodes) n WHERE n.node_key = x.ref_key
  AND n.created_at < x.month + INTERVAL 1 MONTH AND (n.removed_at IS NULL OR n.removed_at >= x.month + INTERVAL 1 MONTH) AND (n.removed_at IS NULL OR n.removed_at > n.created_at)) AS alive
  FROM (SELECT DISTINCT ref_key, e.month FROM r, e) x),
s AS (SELECT e.month AS epoch, r.table_name, r.period, r.month = e.month AS now, orphan, k.alive, coalesce(p.alive, false) AS was
  FROM e JOIN r ON r.month <= e.month JOIN k ON k.ref_key = r.ref_key AND k.month = e.month LEFT JOIN k p ON p.ref_key = r.ref_key AND p.month = e.month - INTERVAL 1 MONTH)
SELECT CAST(epoch + INTERVAL 1 MONTH AS TIMESTAMP) AS epoch, table_name, period, count(*) FILTER (NOT alive) AS n_waiting, count(*) FILTER (now AND orphan) AS n_opened,
  count(*) FILTER (alive AND CASE WHEN now THEN orphan ELSE NOT was END) AS n_resolved, count(*) FILTER (NOT alive AND CASE WHEN now THEN NOT orphan ELSE was END) AS n_reopened
FROM s GROUP BY 1, 2, 3
"""

SQL = {
    "p2_snapshots": _P2_SNAPSHOTS,
    "p4_retyped": _P4_RETYPED,
    "p4_field_moves": _P4_MOVES,
    "p4_versions": _P4_VERSIONS,
    "p2_found": f"SELECT table_name, row_key, ref_column FROM ({_REFS}) r WHERE NOT {_ALIVE}",
    "p2_counts": f"SELECT table_name, cmpt, count(*) AS n_refs, count(*) FILTER (NOT {_ALIVE}) AS n_orphans FROM ({_REFS}) r GROUP BY 1, 2",
    "p3_found": _P3_FOUND,
    "p3_profile": _profile_sql(_plain_cells(P3_COLUMNS)),
    "p3_deltas": "WITH kept AS (SELECT * FROM stays QUALIFY nullif(trim(n_aih), '') IS NULL OR row_number() OVER (PARTITION BY trim(n_aih) ORDER BY stay_id) = 1), "
    + _profile_sql(_CELLS.replace("SELECT load_id", "SELECT CAST(0 AS BIGINT) AS load_id").replace("FROM stays", "FROM kept")).strip().removeprefix("WITH "),
    "p5_found": f"SELECT s AS source_facility_id FROM (SELECT {_SRC} AS s FROM transfer_edges) GROUP BY s HAVING s IS NOT NULL AND count(*) * 100 >= 4 * (SELECT count(*) FROM transfer_edges)",
    "p5_totals": f"SELECT {_SRC} AS source_facility_id, count(*) AS n_rows, CAST(sum(transfer_count) AS BIGINT) AS sum_transfer_count FROM transfer_edges GROUP BY 1",
    "p5_top_targets": f"""
SELECT source_facility_id, target_id, sum_transfer_count, n_rows, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source_facility_id ORDER BY sum_transfer_count DESC, n_rows DESC, target_id) AS rank FROM (
    SELECT {_SRC} AS source_facility_id, CASE WHEN lower(trim(target_location_type)) = 'facility' THEN {_TGT} ELSE nullif(trim(target_location_id), '') END AS target_id,
      CAST(coalesce(sum(transfer_count), 0) AS BIGINT) AS sum_transfer_count, count(*) AS n_rows FROM transfer_edges GROUP BY 1, 2)
  WHERE source_facility_id IS NOT NULL AND target_id IS NOT NULL) WHERE rank <= {P5_TOP}
""",
}
