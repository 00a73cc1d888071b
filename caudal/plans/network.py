"""Queries of the flow-network operators over the test tables, and their SQL.

``records`` are the stays under the column names of the source files; the matcher runs on admissions derived from ``events``,
whose outcomes cover every rejection reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import normalize as nz
from ..operators import edges as ed
from ..operators import drift, enrich, graph, manifest, match, nodes, roles
from ..session import table
from ..sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def records(spark: SparkSession, d: str) -> DataFrame:
    stays = table(spark, d, "stays")
    keep = ("cnes", "cgc_hosp", "n_aih", "munic_res", "nasc", "sexo", "idade", "dt_inter", "dt_saida", "diag_princ", "cobranca", "dias_perm", "marca_uti", "proc_rea", "val_tot", "raca_cor")
    return stays.select("stay_id", *[F.col(c).alias(c.upper()) for c in keep])


def q_text(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


def q_digits(c: str) -> str:
    return f"regexp_replace({q_text(c)}, '[^0-9]', '', 'g')"


def q_number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def q_municipality(c: str) -> str:
    t = q_text(c)
    d = f"regexp_replace(CASE WHEN regexp_full_match({t}, '[0-9]+\\.0+') THEN split_part({t}, '.', 1) ELSE {t} END, '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) > 7 THEN right({d}, 7) ELSE {d} END)"


def q_code6(c: str) -> str:
    m = q_municipality(c)
    return f"(CASE WHEN length({m}) = 7 THEN left({m}, 6) WHEN length({m}) = 6 THEN {m} ELSE '' END)"


def q_age(c: str) -> str:
    n = f"({q_number(c)})"
    return f"CASE WHEN {n} BETWEEN 0 AND 130 AND {n} % 1 = 0 THEN CAST({n} AS BIGINT) END"


Q_ICD = "nullif(regexp_replace(upper(diag_princ), '[^A-Z0-9]', '', 'g'), '')"
Q_CHAPTER = (
    "CASE WHEN left({c}, 1) IN ('A', 'B') THEN 'I' WHEN left({c}, 1) = 'C' THEN 'II' "
    "WHEN left({c}, 1) = 'D' THEN CASE WHEN TRY_CAST(substr({c}, 2, 2) AS INT) <= 48 AND length({c}) > 2 THEN 'II' WHEN regexp_matches({c}, '^D[0-9]{{2}}') THEN 'III' END "
    "WHEN left({c}, 1) = 'H' THEN CASE WHEN TRY_CAST(substr({c}, 2, 2) AS INT) <= 59 AND length({c}) > 2 THEN 'VII' WHEN regexp_matches({c}, '^H[0-9]{{2}}') THEN 'VIII' END "
    "WHEN left({c}, 1) IN ('S', 'T') THEN 'XIX' WHEN left({c}, 1) IN ('V', 'W', 'X', 'Y') THEN 'XX' WHEN left({c}, 1) = 'Z' THEN 'XXI' WHEN left({c}, 1) = 'U' THEN 'XXII' "
    "ELSE list_extract(['IV', 'V', 'VI', NULL, 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII'], nullif(strpos('EFG_IJKLMNOPQR', left({c}, 1)), 0)) END"
)


# --- matcher -------------------------------------------------------------------------------------------------------------
def admissions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id AS rid",
        "CASE WHEN event_id % 389 = 0 THEN NULL ELSE cast(user_id AS string) END AS patient_id",
        "concat('H', lpad(cast(event_id % 37 AS string), 3, '0')) AS PA_CODUNI",
        "cast(date_trunc('DAY', ts) AS timestamp_ntz) AS DT_INTER",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE cast(date_trunc('DAY', ts) AS timestamp_ntz) + make_dt_interval(cast(event_id % 3 AS int)) END AS DT_SAIDA",
        "CASE WHEN (user_id % 2 = 0) != (event_id % 53 = 0) THEN '1' ELSE '3' END AS PA_SEXO",
        "CASE WHEN event_id % 211 = 0 THEN NULL ELSE cast(20 + user_id % 60 AS string) END AS PA_IDADE",
        "CASE WHEN event_id % 307 = 0 THEN '??' WHEN event_type = 'view' THEN 'I219' WHEN event_type = 'purchase' THEN 'J180' WHEN event_type = 'signup' THEN 'K359' ELSE 'I500' END AS PA_CIDPRI",
        "CASE WHEN event_type = 'error' THEN '1' ELSE '0' END AS PA_TRANSF",
    )


_ADM = """
adm AS (SELECT event_id AS rid, CASE WHEN event_id % 389 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS subject, 'H' || lpad(CAST(event_id % 37 AS VARCHAR), 3, '0') AS facility,
  date_trunc('day', ts)::TIMESTAMP AS entered, CASE WHEN event_id % 97 = 0 THEN NULL ELSE date_trunc('day', ts)::TIMESTAMP + to_days(CAST(event_id % 3 AS INT)) END AS gone,
  CASE WHEN (user_id % 2 = 0) <> (event_id % 53 = 0) THEN '1' ELSE '3' END AS sex, CASE WHEN event_id % 211 = 0 THEN NULL ELSE 20 + user_id % 60 END AS age,
  CASE WHEN event_id % 307 = 0 THEN NULL WHEN event_type = 'view' THEN 'I219' WHEN event_type = 'purchase' THEN 'J180' WHEN event_type = 'signup' THEN 'K359' ELSE 'I500' END AS icd,
  event_type = 'error' AS anchor FROM events),
seen AS (SELECT DISTINCT subject FROM adm WHERE subject <> '' AND entered IS NOT NULL),
a AS (SELECT * FROM adm WHERE anchor AND (subject = '' OR subject IN (SELECT subject FROM seen))),
pairs AS (SELECT a.rid, c.rid AS c_rid, c.facility AS target, c.entered AS c_entered, a.icd <> c.icd AS other, epoch(c.entered - a.gone) / 3600 AS delta,
  a.sex = c.sex AND a.age = c.age AS demo, a.sex = c.sex AND a.age = c.age AND left(a.icd, 1) = left(c.icd, 1) AS clin
  FROM a JOIN adm c ON a.subject = c.subject AND a.subject <> '' AND c.rid <> a.rid AND c.entered BETWEEN a.gone + to_hours({lo}) AND a.gone + to_hours({hi})),
per AS (SELECT rid, count(*) AS n_time, count(*) FILTER (demo) AS n_demo, count(*) FILTER (clin) AS n_clin FROM pairs GROUP BY rid),
judged AS (SELECT a.*, CASE WHEN subject = '' THEN 'missing_patient_key' WHEN gone IS NULL THEN 'missing_discharge_datetime' WHEN age IS NULL THEN 'missing_demographic_data'
  WHEN icd IS NULL THEN 'missing_or_invalid_icd' WHEN n_time IS NULL THEN 'no_candidate_in_time_window' WHEN n_demo = 0 THEN 'demographic_mismatch' WHEN n_clin = 0 THEN 'clinical_discontinuity' ELSE 'matched' END AS outcome
  FROM a LEFT JOIN per USING (rid)),
best AS (SELECT * FROM pairs WHERE clin QUALIFY row_number() OVER (PARTITION BY rid ORDER BY delta, other, target, c_entered, c_rid) = 1),
ev AS (SELECT left(sha1(concat_ws('|', j.facility, b.target, strftime(j.gone, '%Y-%m-%d %H:%M:%S'), strftime(b.c_entered, '%Y-%m-%d %H:%M:%S'), j.subject, 'v1_pillars')), 20) AS event_id,
  j.facility AS source_facility_id, b.target AS target_location_id, 'facility' AS target_location_type, j.gone AS source_discharge_datetime, b.c_entered AS target_admission_datetime,
  CAST(b.delta AS DOUBLE) AS delta_hours, '4pillars_strict' AS match_method, CAST(1.0 AS DOUBLE) AS confidence_score, 'v1_pillars' AS rule_version, '2021-01-01' AS assumption_revision
  FROM judged j JOIN best b USING (rid) WHERE j.outcome = 'matched')
"""


def adm_sql(lo: int = 24, hi: int = 48) -> str:
    return "WITH " + _ADM.replace("{lo}", str(lo)).replace("{hi}", str(hi))


MATCH = match.MatchConfig(order="rid")


def _judged(spark: SparkSession, d: str, cfg: match.MatchConfig = MATCH) -> DataFrame:
    return match.judge(match.prepare(admissions(spark, d), [], cfg), cfg)


@query(adm_sql() + "SELECT * FROM ev")
def match_events(spark, d):
    return match.events(_judged(spark, d), MATCH)


@query(adm_sql() + """SELECT left(sha1(concat_ws('|', source_facility_id, target_location_id, rule_version, assumption_revision)), 20) AS edge_id, source_facility_id, target_location_id,
  target_location_type, count(event_id) AS transfer_count, CAST(NULL AS DOUBLE) AS distance_km, match_method, avg(confidence_score) AS confidence_score, rule_version, assumption_revision
  FROM ev GROUP BY ALL""")  # fmt: skip
def match_transfer_edges(spark, d):
    return match.transfer_edges(match_events(spark, d))


@query(adm_sql() + "SELECT outcome AS reason, count(*) AS n FROM judged WHERE outcome <> 'matched' GROUP BY 1")
def match_rejections(spark, d):
    return match.rejections(_judged(spark, d))


@query(" UNION ALL ".join(f"SELECT '{lo}-{hi}' AS hours, outcome, n FROM ({adm_sql(lo, hi)} SELECT outcome, count(*) AS n FROM judged GROUP BY 1)" for lo, hi in ((0, 24), (24, 72))))
def match_window_variants(spark, d):
    parts = []
    for lo, hi in ((0, 24), (24, 72)):
        cfg = match.MatchConfig(order="rid", min_hours=lo, max_hours=hi)
        parts.append(_judged(spark, d, cfg).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("hours", F.lit(f"{lo}-{hi}")))
    return parts[0].unionByName(parts[1])


_KEY = (
    "CASE WHEN b IS NOT NULL AND s <> '' AND g IS NOT NULL AND r <> '' THEN concat_ws('|', b, s, g, r) ELSE '' END AS subject_key FROM (SELECT stay_id, coalesce("
    "CASE WHEN regexp_full_match(trim(nasc), '[0-9]{8}') THEN strftime(try_strptime(trim(nasc), '%Y%m%d'), '%Y-%m-%d') END, "
    "CASE WHEN regexp_matches(trim(nasc), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN strftime(TRY_CAST(trim(nasc) AS TIMESTAMP), '%Y-%m-%d') END) AS b, "
    f"upper({q_text('sexo')}) AS s, {q_age('idade')} AS g, {q_text('munic_res')} AS r FROM stays)"
)


@query(f"SELECT stay_id, {_KEY}")
def link_patient_key(spark, d):
    r = records(spark, d)
    key = nz.subject_key(*[F.col(roles.first_available(r.columns, roles.ROLES[k])) for k in ("birthdate", "sex", "age", "residence")])
    return r.select("stay_id", key.alias("subject_key"))


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS rows_total, count(*) AS unique_keys, count(*) FILTER (n > 1) AS colliding_groups, CAST(sum(n) - count(*) AS BIGINT) AS rows_in_collision,
  round((sum(n) - count(*)) / sum(n), 6) AS collision_ratio FROM (SELECT subject_key, count(*) AS n FROM (SELECT {_KEY}) WHERE subject_key <> '' GROUP BY 1)""")
def qa_key_collisions(spark, d):
    return match.key_collisions(link_patient_key(spark, d), "subject_key")


# --- projection and scalar rules -----------------------------------------------------------------------------------------
@query("SELECT munic_res AS CODMUNRES, cnes AS CNES, diag_princ AS DIAG_PRINC, nasc AS NASC, idade AS IDADE, sexo AS SEXO, dt_inter AS DT_INTER, dt_saida AS DT_SAIDA, cobranca AS MOT_SAIDA, CAST(NULL AS VARCHAR) AS PA_TRANSF, dias_perm AS DIAS_PERM, marca_uti AS MARCA_UTI, proc_rea AS PROC_REA, val_tot AS VAL_TOT, raca_cor AS RACA_COR FROM stays")
def proj_strict(spark, d):
    return roles.project(records(spark, d))


_OUT = {"transfer": "'31','32'", "discharge": "'11','12','14','15','16','18'", "permanence": "'21'", "death": "'41','42','43'"}
_C2 = f"CASE WHEN length({q_text('cobranca')}) < 2 THEN lpad({q_text('cobranca')}, 2, '0') ELSE {q_text('cobranca')} END"


@query(f"""SELECT stay_id, c IN ({_OUT['transfer']}) AS IS_TRANSFER_REGULATED, c IN ({_OUT['discharge']}) AS IS_DISCHARGE, c IN ({_OUT['permanence']}) AS IS_PERMANENCE, c IN ({_OUT['death']}) AS IS_DEATH,
  CASE {' '.join(f"WHEN c IN ({v}) THEN '{k}'" for k, v in _OUT.items())} ELSE 'other' END AS MOT_SAIDA_GROUP FROM (SELECT stay_id, {_C2} AS c FROM stays)""")
def proj_outcome_features(spark, d):
    r = records(spark, d).withColumn("MOT_SAIDA", F.col("COBRANCA"))
    return roles.outcome_features(r).select("stay_id", "IS_TRANSFER_REGULATED", "IS_DISCHARGE", "IS_PERMANENCE", "IS_DEATH", "MOT_SAIDA_GROUP")


@query(f"SELECT exit_id FROM transfer_exits WHERE trunc(coalesce({q_number('pa_transf')}, 0)) = 1 OR {q_text('pa_motsai')} IN ('31', '32')")
def filter_anchor(spark, d):
    return table(spark, d, "transfer_exits").where(match.is_anchor(F.col("pa_transf"), F.col("pa_motsai"), ["31", "32"])).select("exit_id")


@query(f"SELECT stay_id, icd, {Q_CHAPTER.format(c='icd')} AS chapter FROM (SELECT stay_id, {Q_ICD} AS icd FROM stays)")
def norm_icd_chapter(spark, d):
    icd = nz.diagnosis(F.col("DIAG_PRINC"))
    return records(spark, d).select("stay_id", icd.alias("icd"), nz.chapter(icd).alias("chapter"))


@query(f"SELECT stay_id, {q_age('idade')} AS age, {q_age('val_tot')} AS from_amount FROM stays")
def norm_age(spark, d):
    return records(spark, d).select("stay_id", nz.age(F.col("IDADE")).alias("age"), nz.age(F.col("VAL_TOT")).alias("from_amount"))


def _codes_sql(c: str) -> str:
    dg = q_digits(c)
    m = q_municipality(c)
    return (
        f"{m} AS catalog_code, CASE WHEN length({dg}) = 7 THEN left({dg}, 6) WHEN length({dg}) > 7 THEN right({dg}, 6) ELSE {dg} END AS node_code, "
        f"{q_code6(c)} AS strict6, CASE WHEN length({m}) >= 6 THEN left({m}, 6) ELSE '' END AS loose6"
    )


_CODE_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(350000 + o_custkey AS VARCHAR) WHEN 2 THEN CAST(3500000 + o_custkey AS VARCHAR) || '.0' WHEN 3 THEN '00' || CAST(3500000 + o_custkey AS VARCHAR) WHEN 4 THEN ' ' || CAST(3500000 + o_custkey AS VARCHAR) || ' ' ELSE CAST(o_custkey AS VARCHAR) END"


@query(f"SELECT o_orderkey, {_codes_sql('c')} FROM (SELECT o_orderkey, {_CODE_TEXT} AS c FROM orders)")
def norm_municipality_codes(spark, d):
    c = F.expr(_CODE_TEXT.replace("VARCHAR", "string"))
    return table(spark, d, "orders").select(
        "o_orderkey", nz.municipality(c).alias("catalog_code"), nz.municipality_for_nodes(c).alias("node_code"), nz.code6_strict(c).alias("strict6"), nz.code6_loose(c).alias("loose6")
    )


@query(f"SELECT edge_row, CASE WHEN dg = '' THEN '' ELSE lpad(CASE WHEN length(dg) > 7 THEN right(dg, 7) ELSE dg END, 7, '0') END AS cnes FROM (SELECT edge_row, {q_digits('source_facility_id')} AS dg FROM transfer_edges)")
def norm_cnes(spark, d):
    return table(spark, d, "transfer_edges").select("edge_row", nz.facility_code(F.col("source_facility_id")).alias("cnes"))


_FLAG_TEXT = "CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN ' sim ' WHEN 3 THEN 'F1' WHEN 4 THEN '0' WHEN 5 THEN '1.0' WHEN 6 THEN 'Yes' WHEN 7 THEN 'x10' WHEN 8 THEN 'true' WHEN 9 THEN '' ELSE 'no' END"
_FLAG = "CASE WHEN regexp_replace(upper(t), '[^0-9]', '', 'g') IN ('0', '1') THEN regexp_replace(upper(t), '[^0-9]', '', 'g') ELSE upper(t) END"


@query(f"""SELECT p_partkey, {_FLAG} AS flag, lower(t) IN ('1', 'true', 't', 'yes', 'y', 'sim', 's') AS code_true, {_FLAG} IN ('1', 'S', 'SIM', 'Y', 'YES', 'TRUE', 'T') AS reference_true,
  upper(t) IN ('1', 'S', 'SIM', 'Y', 'YES', 'TRUE', 'T') OR coalesce({q_number('t')} = 1, false) AS batch_true FROM (SELECT p_partkey, {q_text(_FLAG_TEXT)} AS t FROM part)""")
def norm_flags_truthy(spark, d):
    c = F.expr(_FLAG_TEXT)
    return table(spark, d, "part").select("p_partkey", nz.flag(c).alias("flag"), nz.truthy_code(c).alias("code_true"), nz.truthy_reference(c).alias("reference_true"), nz.truthy_batch(c).alias("batch_true"))


@query(f"SELECT stay_id, {q_number('val_tot')} AS amount, coalesce({q_number('dias_perm')}, 1.0) AS days, {q_text('raca_cor')} AS race FROM stays")
def norm_coercions(spark, d):
    return records(spark, d).select("stay_id", nz.number(F.col("VAL_TOT")).alias("amount"), nz.number_or(F.col("DIAS_PERM"), 1.0).alias("days"), nz.text(F.col("RACA_COR")).alias("race"))


# --- nodes and edges -----------------------------------------------------------------------------------------------------
_FLOOK = f"""SELECT location_id, 'facility:' || location_id AS node_id, municipality_code FROM (SELECT location_id, arg_min(p, (-n, p)) FILTER (p IS NOT NULL) AS municipality_code FROM (
  SELECT {q_text('cnes')} AS location_id, nullif({q_text('munic_res')}, '') AS p, count(*) AS n FROM stays GROUP BY 1, 2) WHERE location_id <> '' GROUP BY 1)"""
_FLOOK = f"""SELECT location_id, 'facility:' || location_id AS node_id, max(p) FILTER (r = 1) AS municipality_code FROM (
  SELECT *, CASE WHEN p IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY location_id, p IS NULL ORDER BY n DESC, p) END AS r FROM (
  SELECT {q_text('cnes')} AS location_id, nullif({q_text('munic_res')}, '') AS p, count(*) AS n FROM stays GROUP BY 1, 2)) WHERE location_id <> '' GROUP BY 1"""
_MLOOK = f"SELECT DISTINCT {q_text('munic_res')} AS location_id, 'municipality:' || {q_text('munic_res')} AS node_id FROM stays WHERE {q_text('munic_res')} <> ''"
_EMPTY = "CAST(NULL AS VARCHAR) AS name, {m} AS municipality_code, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS BIGINT) AS capacity_beds, CAST(NULL AS VARCHAR) AS habilitation_level"
_BUILT = f"SELECT node_id, 'facility' AS node_type, {_EMPTY.format(m='municipality_code')} FROM ({_FLOOK}) UNION ALL SELECT node_id, 'municipality', {_EMPTY.format(m='location_id')} FROM ({_MLOOK})"


@query(_FLOOK)
def nodes_facility_lookup(spark, d):
    return nodes.facility_lookup(records(spark, d).drop("CGC_HOSP"))


@query(_MLOOK)
def nodes_municipality_lookup(spark, d):
    return nodes.municipality_lookup(records(spark, d))


@query(_BUILT)
def nodes_build(spark, d):
    return nodes.build_nodes(records(spark, d))


def _node_code(c: str) -> str:
    dg = q_digits(c)
    return f"CASE WHEN length({dg}) = 7 THEN left({dg}, 6) WHEN length({dg}) > 7 THEN right({dg}, 6) ELSE {dg} END"


@query(f"""SELECT node_id, node_type, municipality_code FROM nodes UNION ALL SELECT 'municipality:' || c, 'municipality', c FROM (SELECT DISTINCT {_node_code('munic_res')} AS c FROM stays)
  WHERE c <> '' AND c NOT IN (SELECT {_node_code('municipality_code')} FROM nodes WHERE lower(node_type) = 'municipality')""")
def nodes_append_missing(spark, d):
    return nodes.append_municipalities(table(spark, d, "nodes").select(*nodes.NODE_SCHEMA), table(spark, d, "stays"), "munic_res").select("node_id", "node_type", "municipality_code")


@query("""SELECT node_id, min(name) AS name, count(*) AS n_nodes FROM (SELECT node_id, name, row_number() OVER (PARTITION BY node_id ORDER BY o, name NULLS LAST, municipality_code NULLS LAST) AS r FROM (
  SELECT node_id, 0 AS o, NULL AS name, municipality_code FROM (""" + _BUILT + """) UNION ALL SELECT node_id, 1, name, municipality_code FROM nodes WHERE trim(node_id) <> '')) WHERE r = 1 GROUP BY 1""")
def nodes_national_append(spark, d):
    out = nodes.append_reference(nodes_build(spark, d), table(spark, d, "nodes").select(*nodes.NODE_SCHEMA))
    return out.groupBy("node_id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n_nodes"))


_KNOWN = f"(SELECT DISTINCT {q_text('node_id')} FROM nodes WHERE {q_text('node_id')} <> '')"
_S, _T = f"'facility:' || {q_text('source_facility_id')}", f"CASE WHEN lower({q_text('target_location_type')}) = 'municipality' THEN 'municipality:' ELSE 'facility:' END || {q_text('target_location_id')}"
_MAPPED = f"SELECT edge_row, {_S} AS source_node_id, {_T} AS target_node_id, ({_S}) IN {_KNOWN} AS source_node_exists, ({_T}) IN {_KNOWN} AS target_node_exists FROM transfer_edges"


def _mapped(spark, d):
    return nodes.map_edges(table(spark, d, "transfer_edges"), table(spark, d, "nodes"))


@query(_MAPPED)
def edges_map(spark, d):
    return _mapped(spark, d).select("edge_row", "source_node_id", "target_node_id", "source_node_exists", "target_node_exists")


@query(f"""SELECT count(*) AS edges_total, count(*) FILTER (NOT source_node_exists) AS source_missing, count(*) FILTER (NOT target_node_exists) AS target_missing,
  round(count(*) FILTER (NOT source_node_exists) / count(*), 6) AS source_missing_ratio, round(count(*) FILTER (NOT target_node_exists) / count(*), 6) AS target_missing_ratio FROM ({_MAPPED})""")
def edges_coverage(spark, d):
    return nodes.coverage(_mapped(spark, d))


_RES = f"""SELECT 'municipality:' || m AS source_node_id, 'facility:' || f AS target_node_id, 'residence' AS edge_type, count(*) AS transfer_count,
  CAST(NULL AS DOUBLE) AS confidence_score, CAST(NULL AS DOUBLE) AS distance_km, 'residence' AS match_method, 'residence_v1_2026_04_26' AS rule_version, '2026-04-26' AS assumption_revision FROM (SELECT {q_code6('munic_res')} AS m, {q_text('cnes')} AS f FROM stays) WHERE m <> '' AND f <> '' GROUP BY m, f"""


@query(_RES)
def edges_residence(spark, d):
    return ed.residence_edges(records(spark, d))


_YEAR = f"""SELECT source_node_id, target_node_id, edge_type, sum(coalesce(CAST(transfer_count AS DOUBLE), 1.0)) AS transfer_count, round(avg(confidence_score), 6) AS confidence_score, arg_min(rule_version, (period, rule_version)) FILTER (rule_version IS NOT NULL) AS rule_version
  FROM (SELECT source_node_id, target_node_id, 'transfer' AS edge_type, transfer_count, confidence_score, rule_version, cmpt AS period FROM transfer_edges
  UNION ALL SELECT source_node_id, target_node_id, edge_type, transfer_count, confidence_score, rule_version, '000000' FROM ({_RES})) GROUP BY 1, 2, 3"""


def _periods(spark, d):
    t = table(spark, d, "transfer_edges").withColumn("edge_type", F.lit("transfer")).withColumn("period", F.col("cmpt"))
    cols = ["source_node_id", "target_node_id", "edge_type", "transfer_count", "confidence_score", "match_method", "rule_version", "assumption_revision", "period"]
    return t.select(*cols).unionByName(edges_residence(spark, d).withColumn("period", F.lit("000000")), allowMissingColumns=True)


@query(_YEAR.replace("arg_min(rule_version, (period, rule_version)) FILTER (rule_version IS NOT NULL)", "substr(min(CASE WHEN rule_version IS NOT NULL AND period IS NOT NULL THEN period || rule_version END), 7)"))
def edges_year_rollup(spark, d):
    return ed.roll_up(_periods(spark, d)).select("source_node_id", "target_node_id", "edge_type", "transfer_count", F.round("confidence_score", 6).alias("confidence_score"), "rule_version")


@query(f"""SELECT nodes_total, empty_node_id_rows, duplicate_node_id_rows, invalid_node_type_rows, node_name_coverage, edges_total, invalid_transfer_count_rows, source_node_missing_rows, target_node_missing_rows,
  round((source_node_missing_rows + target_node_missing_rows) / (2 * edges_total), 6) AS missing_node_reference_ratio FROM
  (SELECT count(*) AS nodes_total, count(*) FILTER (id = '') AS empty_node_id_rows, count(*) - count(DISTINCT id) AS duplicate_node_id_rows, count(*) FILTER (ty NOT IN ('facility', 'municipality')) AS invalid_node_type_rows,
   round(count(*) FILTER (nm <> '') / count(*), 6) AS node_name_coverage FROM (SELECT {q_text('node_id')} AS id, lower({q_text('node_type')}) AS ty, {q_text('name')} AS nm FROM nodes)),
  (SELECT count(*) AS edges_total, count(*) FILTER (transfer_count < 1) AS invalid_transfer_count_rows, count(*) FILTER ({q_text('source_node_id')} NOT IN {_KNOWN}) AS source_node_missing_rows,
   count(*) FILTER ({q_text('target_node_id')} NOT IN {_KNOWN}) AS target_node_missing_rows FROM transfer_edges)""")
def contract_metrics(spark, d):
    return nodes.contract_metrics(table(spark, d, "nodes"), table(spark, d, "transfer_edges"))


# --- enrichment and references -------------------------------------------------------------------------------------------
_CAT = "SELECT municipality_code || '0' AS ibge_id, municipality_code AS code6, coalesce(min(name), 'M' || municipality_code) AS m_name, left(municipality_code, 2) AS m_state, avg(latitude) AS lat, avg(longitude) AS lon FROM nodes WHERE node_type = 'municipality' AND regexp_full_match(municipality_code, '[0-9]{6}') GROUP BY municipality_code"


def _catalog(spark, d) -> tuple[DataFrame, DataFrame]:
    """A nested catalog and its centres, from the municipalities among the nodes."""
    m = table(spark, d, "nodes").where((F.col("node_type") == "municipality") & F.col("municipality_code").rlike(r"^\d{6}$")).groupBy("municipality_code")
    flat = m.agg(F.min("name").alias("name"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    sigla = F.substring("municipality_code", 1, 2).alias("sigla")
    nested = F.struct(F.struct(F.struct(sigla).alias("UF")).alias("mesorregiao")).alias("microrregiao")
    cat = flat.select(F.concat("municipality_code", F.lit("0")).cast("long").alias("id"), F.coalesce("name", F.concat(F.lit("M"), "municipality_code")).alias("nome"), nested)
    return cat, flat.select(F.concat("municipality_code", F.lit("0")).alias("ibge_id"), "lat", "lon")


_UNNAMED = "SELECT node_id, node_type, CASE WHEN substr(node_id, length(node_id), 1) IN ('0', '3', '6', '9') THEN NULL ELSE name END AS name, municipality_code, latitude, longitude FROM nodes"
_ENRICHED = f"""SELECT n.node_id, n.node_type, CASE WHEN node_type = 'municipality' AND {q_text('name')} = '' AND c.ibge_id IS NOT NULL THEN m_name || ' - ' || m_state
  WHEN node_type = 'facility' AND {q_text('name')} = '' THEN 'CNES ' || substr(node_id, 10) || CASE WHEN c.ibge_id IS NULL THEN '' ELSE ' (' || m_name || ' - ' || m_state || ')' END ELSE name END AS name,
  CASE WHEN (latitude IS NULL OR longitude IS NULL) AND lat IS NOT NULL AND lon IS NOT NULL AND (node_type = 'municipality' OR {q_text('name')} = '') THEN lat ELSE latitude END AS latitude,
  CASE WHEN (latitude IS NULL OR longitude IS NULL) AND lat IS NOT NULL AND lon IS NOT NULL AND (node_type = 'municipality' OR {q_text('name')} = '') THEN lon ELSE longitude END AS longitude, c.ibge_id IS NOT NULL AS resolved
  FROM ({_UNNAMED}) n LEFT JOIN ({_CAT}) c ON {q_municipality('n.municipality_code')} IN (c.code6, c.ibge_id)"""


def _enriched(spark, d):
    last = F.substring("node_id", -1, 1)
    some = table(spark, d, "nodes").select(*nodes.NODE_SCHEMA).withColumn("name", F.when(last.isin("0", "3", "6", "9"), None).otherwise(F.col("name")))
    return enrich.enrich_municipalities(some, *_catalog(spark, d))


@query(f"SELECT node_id, node_type, name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM ({_ENRICHED})")
def enrich_municipality(spark, d):
    return _enriched(spark, d).select("node_id", "node_type", "name", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(f"""SELECT count(*) FILTER (node_type = 'municipality') AS municipality_nodes_total, count(*) FILTER (node_type = 'municipality' AND resolved) AS municipality_nodes_enriched,
  count(*) FILTER (node_type = 'municipality' AND latitude IS NOT NULL AND longitude IS NOT NULL) AS municipality_nodes_with_coordinates, count(*) FILTER (node_type = 'facility') AS facility_nodes_total,
  count(*) FILTER (node_type = 'facility' AND {q_text('name')} <> '') AS facility_nodes_named, count(*) FILTER (node_type = 'facility' AND latitude IS NOT NULL AND longitude IS NOT NULL) AS facility_nodes_with_coordinates,
  count(*) FILTER (node_type = 'municipality' AND NOT resolved) AS missing_municipality_metadata FROM ({_ENRICHED})""")
def enrich_stats(spark, d):
    return enrich.enrichment_stats(_enriched(spark, d))


_FREF = "SELECT substr(node_id, 10) AS cnes, min(name) AS name, min(capacity_beds) AS capacity_beds FROM nodes WHERE node_type = 'facility' GROUP BY 1"


@query(f"""SELECT b.node_id, CASE WHEN {q_text('r.name')} <> '' THEN r.name END AS name, r.capacity_beds, (CASE WHEN {q_text('r.name')} <> '' THEN 1 ELSE 0 END) + (CASE WHEN r.capacity_beds IS NOT NULL THEN 1 ELSE 0 END) AS cells
  FROM ({_BUILT}) b LEFT JOIN ({_FREF}) r ON b.node_type = 'facility' AND substr(b.node_id, 10) = r.cnes""")
def enrich_facility_reference(spark, d):
    ref = table(spark, d, "nodes").where("node_type = 'facility'").groupBy(nz.facility_of_node(F.col("node_id")).alias("cnes")).agg(F.min("name").alias("name"), F.min("capacity_beds").alias("capacity_beds"))
    out, cells = enrich.enrich_facilities(nodes_build(spark, d), ref)
    return out.select("node_id", "name", "capacity_beds", cells.alias("cells"))


_CENT = f"SELECT ibge_id, code6, m_name, m_state, CASE WHEN m_state IN ('11', '53') OR code6 LIKE '%7' THEN NULL ELSE lat END AS lat, lon FROM ({_CAT})"
_MREF = f"""SELECT ibge_id, code6 AS municipality_code, m_name AS municipality_name, m_state AS uf, CASE WHEN p THEN lat ELSE coalesce(slat, nlat, -15.793889) END AS latitude, CASE WHEN p THEN lon ELSE coalesce(slon, nlon, -47.882778) END AS longitude,
  CASE WHEN p THEN 'ibge_malha' WHEN slat IS NOT NULL THEN 'uf_mean_fallback' ELSE 'national_mean_fallback' END AS coordinate_source FROM (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AS p,
  avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat END) OVER (PARTITION BY m_state) AS slat, avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon END) OVER (PARTITION BY m_state) AS slon,
  avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat END) OVER () AS nlat, avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon END) OVER () AS nlon FROM ({_CENT}))"""


def _reference(spark, d):
    cat, centres = _catalog(spark, d)
    holes = F.substring("ibge_id", 1, 2).isin("11", "53") | (F.substring("ibge_id", 6, 1) == "7")
    return enrich.municipality_reference(cat, centres.withColumn("lat", F.when(holes, None).otherwise(F.col("lat"))))


@query(f"SELECT ibge_id, municipality_code, municipality_name, uf, round(latitude + 1e-9, 6) AS latitude, round(longitude + 1e-9, 6) AS longitude, coordinate_source FROM ({_MREF})")
def ref_municipality(spark, d):
    return _reference(spark, d).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("latitude", "longitude")})


_FACS = "SELECT substr(node_id, 10) AS cnes, min(municipality_code) AS municipality_code, CASE WHEN substr(node_id, length(node_id), 1) = '1' THEN 'xx' ELSE '' END AS uf FROM nodes WHERE node_type = 'facility' GROUP BY ALL"
_CACHE = "SELECT location_id AS cnes, 'Casa ' || location_id AS name, CASE WHEN location_id LIKE '%5' THEN NULL ELSE -10.5 END AS latitude, -50.25 AS longitude FROM (SELECT DISTINCT location_id FROM facility_lookup WHERE regexp_full_match(location_id, '[0-9]{6}[0-4]|[0-9]{6}5'))"
_FACREF = f"""SELECT f.cnes, '2101' AS competence, m.ibge_id, f.municipality_code, municipality_name, CASE WHEN f.uf <> '' THEN upper(f.uf) ELSE upper(coalesce(m.uf, '')) END AS uf,
  coalesce(a.name, 'CNES ' || f.cnes || ' (' || coalesce(municipality_name, '') || ' - ' || CASE WHEN f.uf <> '' THEN upper(f.uf) ELSE upper(coalesce(m.uf, '')) END || ')') AS name,
  round(CASE WHEN a.latitude IS NOT NULL THEN a.latitude ELSE m.latitude END + 1e-9, 6) AS latitude, round(CASE WHEN a.latitude IS NOT NULL THEN a.longitude ELSE m.longitude END + 1e-9, 6) AS longitude,
  CASE WHEN a.latitude IS NOT NULL THEN 'cnes_api' ELSE coalesce(coordinate_source, 'missing') END AS coordinate_source, CASE WHEN a.name IS NOT NULL THEN 'cnes_api' ELSE 'synthetic_municipality' END AS name_source
  FROM ({_FACS}) f LEFT JOIN ({_MREF}) m USING (municipality_code) LEFT JOIN ({_CACHE}) a USING (cnes)"""


@query(_FACREF)
def ref_facilities(spark, d):
    n = table(spark, d, "nodes").where("node_type = 'facility'")
    facs = n.groupBy("node_id").agg(F.min("municipality_code").alias("municipality_code")).select(
        nz.facility_of_node(F.col("node_id")).alias("cnes"), "municipality_code", F.when(F.substring("node_id", -1, 1) == "1", "xx").otherwise("").alias("uf")
    )
    ids = table(spark, d, "facility_lookup").where(F.col("location_id").rlike(r"^\d{6}[0-5]$")).select(F.col("location_id").alias("cnes")).distinct()
    cache = ids.select("cnes", F.concat(F.lit("Casa "), "cnes").alias("name"), F.when(F.col("cnes").endswith("5"), None).otherwise(F.lit(-10.5)).alias("latitude"), F.lit(-50.25).alias("longitude"))
    out = enrich.facility_reference(facs, _reference(spark, d), cache, manifest.competence("202101"))
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("latitude", "longitude")})


@query(f"""SELECT count(*) AS n_facilities, count(*) FILTER (name_source = 'cnes_api') AS n_named, count(*) FILTER (coordinate_source = 'cnes_api') AS n_cnes_api, count(*) FILTER (coordinate_source = 'ibge_malha') AS n_ibge_malha,
  count(*) FILTER (coordinate_source = 'uf_mean_fallback') AS n_uf_mean_fallback, count(*) FILTER (coordinate_source = 'national_mean_fallback') AS n_national_mean_fallback, count(*) FILTER (coordinate_source = 'missing') AS n_missing FROM ({_FACREF})""")
def ref_counters(spark, d):
    return enrich.reference_counters(ref_facilities(spark, d))


@query("""SELECT p_partkey FROM part WHERE p_partkey % 2 = 1 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AND (p_size % 4 = 1 OR p_partkey % 7 = 0)""")
def ref_public_scope(spark, d):
    flags = table(spark, d, "part").selectExpr(
        "p_partkey", "cast(p_partkey % 2 AS string) AS vinc_sus", "CASE WHEN p_partkey % 3 = 0 THEN 'S' ELSE '0' END AS atendhos", "CASE WHEN p_partkey % 5 = 0 THEN '1.0' ELSE '' END AS leithosp",
        "cast(p_size % 4 AS string) AS niv_dep", "CASE WHEN p_partkey % 7 = 0 THEN '124-4' ELSE '4000' END AS nat_jur",
    )
    return enrich.in_scope(flags, "public_hospitals").select("p_partkey")


@query(f"SELECT DISTINCT code6 AS code, ibge_id FROM ({_CAT})")
def ref_catalog_codes(spark, d):
    cat, _ = _catalog(spark, d)
    return enrich.resolve(enrich.catalog_codes(cat, 6), "code", cat).select("code", "ibge_id")


@query(f"SELECT DISTINCT {q_text('cnes')} AS cnes FROM stays WHERE {q_text('cnes')} <> '' AND {q_text('cnes')} NOT IN (SELECT substr(node_id, 10) FROM nodes WHERE node_type = 'facility')")
def cache_missing(spark, d):
    from ..sources.readers import missing_keys

    want = table(spark, d, "stays").select(nz.text(F.col("cnes")).alias("cnes")).where("cnes != ''")
    have = table(spark, d, "nodes").where("node_type = 'facility'").select(nz.facility_of_node(F.col("node_id")).alias("cnes"))
    return missing_keys(want, have, "cnes")


# --- geometry ------------------------------------------------------------------------------------------------------------
_RING = """
p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y, CAST(embedding[2 * ((i + 1) % k) + 1] AS DOUBLE) AS x2, CAST(embedding[2 * ((i + 1) % k) + 2] AS DOUBLE) AS y2
  FROM (SELECT vec_id, embedding, len(embedding) // 2 AS k, unnest(range(len(embedding) // 2)) AS i FROM embeddings)),
s AS (SELECT vec_id, sum(x * y2 - x2 * y) AS a, sum((x + x2) * (x * y2 - x2 * y)) AS cx, sum((y + y2) * (x * y2 - x2 * y)) AS cy FROM p GROUP BY 1)"""


@query(f"WITH {_RING.strip()} SELECT vec_id, round(abs(a) / 2, 4) AS area, round(cx / 3, 4) + 0.0 AS moment_x, round(cy / 3, 4) + 0.0 AS moment_y FROM s")
def geo_ring_centroid(spark, d):
    """Area and first moments of open rings made of the pairs of a vector; the centroid is moment by doubled signed area."""
    e = table(spark, d, "embeddings")
    pts = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.array(F.get("embedding", 2 * i).cast("double"), F.get("embedding", 2 * i + 1).cast("double")))
    e = e.withColumn("ring", geometry.clean_ring(pts))
    ring = F.col("ring")
    c = geometry.ring_centroid(ring)
    signed = F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda a, i: a + F.get(F.get(ring, i), F.lit(0)) * F.get(F.get(ring, i + 1), F.lit(1)) - F.get(F.get(ring, i + 1), F.lit(0)) * F.get(F.get(ring, i), F.lit(1)))
    return e.select("vec_id", c.alias("c"), signed.alias("a")).select("vec_id", F.round(F.col("c.weight"), 4).alias("area"), (F.round(F.col("c.lon") * F.col("a"), 4) + 0.0).alias("moment_x"), (F.round(F.col("c.lat") * F.col("a"), 4) + 0.0).alias("moment_y"))


@query("SELECT node_id, longitude + 0.5 AS lon, latitude + 0.5 AS lat FROM (SELECT node_id, round(min(longitude), 5) AS longitude, round(min(latitude), 5) AS latitude FROM nodes WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1)".replace("longitude + 0.5", "round(longitude + 0.7 + 1e-9, 4)").replace("latitude + 0.5", "round(latitude + 0.5 + 1e-9, 4)"))
def geo_polygon_centroid(spark, d):
    """Two-part polygons around each located node: a unit square, and one of four times its area one to the side."""
    n = table(spark, d, "nodes").where("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy("node_id").agg(F.round(F.min("longitude"), 5).alias("x"), F.round(F.min("latitude"), 5).alias("y"))
    at = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    near = F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)))
    far = F.array(F.array(at(-0.25, -0.5), at(1.75, -0.5), at(1.75, 1.5), at(-0.25, 1.5)))
    c = geometry.geometry_centroid(F.lit("MultiPolygon"), F.lit(None).cast("array<array<array<double>>>"), F.array(near, far))
    return n.select("node_id", F.round(c["lon"] + 1e-9, 4).alias("lon"), F.round(c["lat"] + 1e-9, 4).alias("lat"))


# --- batch filters -------------------------------------------------------------------------------------------------------
@query(f"SELECT stay_id FROM stays WHERE upper({q_text('diag_princ')}) LIKE 'I%' OR upper({q_text('diag_princ')}) LIKE 'J1%'")
def batch_icd_filter(spark, d):
    return ed.with_diagnosis(records(spark, d), ["I", "J1"]).select("stay_id")


@query(f"""SELECT stay_id FROM stays WHERE CASE WHEN length({q_municipality('munic_res')}) >= 6 THEN left({q_municipality('munic_res')}, 6) ELSE '' END IN (SELECT code6 FROM ({_CAT}) WHERE m_state IN ('35', '31'))""")
def batch_uf_records(spark, d):
    cat, _ = _catalog(spark, d)
    codes = enrich.catalog_rows(cat).select("code6", F.col("m_state").alias("state"))
    return ed.in_states(records(spark, d), codes, ["31", "35"], "stay_id").select("stay_id")


_NSTATE = "SELECT node_id, left(min(municipality_code), 2) AS state FROM nodes GROUP BY 1"


@query(f"SELECT edge_row, s.state AS source_uf, t.state AS target_uf FROM transfer_edges e JOIN ({_NSTATE}) s ON e.source_node_id = s.node_id JOIN ({_NSTATE}) t ON e.target_node_id = t.node_id WHERE s.state IN ('31', '35', '41') AND t.state IN ('31', '35', '41')")
def batch_uf_edges(spark, d):
    state = table(spark, d, "nodes").groupBy("node_id").agg(F.substring(F.min("municipality_code"), 1, 2).alias("state"))
    return ed.edges_in_states(table(spark, d, "transfer_edges"), state, ["31", "35", "41"]).select("edge_row", "source_uf", "target_uf")


@query("SELECT edge_row FROM transfer_edges WHERE coalesce(transfer_count, 1) >= 5")
def batch_threshold(spark, d):
    return ed.at_least(table(spark, d, "transfer_edges"), 5).select("edge_row")


# --- graph ---------------------------------------------------------------------------------------------------------------
_GE = f"""g AS (SELECT s AS source_node_id, t AS target_node_id, edge_type, transfer_count, confidence_score FROM (
  SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY edge_type DESC) AS r FROM (SELECT s, t, edge_type, sum(coalesce(CAST(c AS DOUBLE), 1.0)) AS transfer_count, avg(coalesce(f, 0.0)) AS confidence_score FROM (
  SELECT {q_text('source_node_id')} AS s, {q_text('target_node_id')} AS t, 'transfer' AS edge_type, transfer_count AS c, confidence_score AS f FROM transfer_edges
  UNION ALL SELECT source_node_id, target_node_id, edge_type, transfer_count, confidence_score FROM ({_RES})) WHERE coalesce(c, 1) >= {{k}} AND s <> '' AND t <> '' GROUP BY 1, 2, 3)) WHERE r = 1),
v AS (SELECT node_id, first(node_type ORDER BY node_type NULLS LAST, name NULLS LAST, municipality_code NULLS LAST) AS node_type, first(name ORDER BY node_type NULLS LAST, name NULLS LAST, municipality_code NULLS LAST) AS name FROM (
  SELECT {q_text('node_id')} AS node_id, node_type, name, municipality_code FROM nodes WHERE {q_text('node_id')} <> '' UNION ALL SELECT source_node_id, NULL, NULL, NULL FROM g UNION ALL SELECT target_node_id, NULL, NULL, NULL FROM g) GROUP BY 1)"""
_DEG = """deg AS (SELECT v.node_id, coalesce(sum(i), 0) AS in_degree, coalesce(sum(o), 0) AS out_degree, coalesce(sum(i + o), 0) AS degree, coalesce(sum(i * w), 0.0) AS weighted_in, coalesce(sum(o * w), 0.0) AS weighted_out, coalesce(sum(w), 0.0) AS weighted_degree
  FROM v LEFT JOIN (SELECT source_node_id AS node_id, 0 AS i, 1 AS o, transfer_count AS w FROM g UNION ALL SELECT target_node_id, 1, 0, transfer_count FROM g) USING (node_id) GROUP BY 1)"""


def g_sql(k: int = 1, degrees: bool = False) -> str:
    return "WITH RECURSIVE " + _GE.replace("{k}", str(k)) + (", " + _DEG if degrees else "")


def _graph(spark, d, k: float = 1.0):
    return graph.build(table(spark, d, "nodes"), _periods(spark, d), k, order="period")


@query(g_sql() + " SELECT source_node_id, target_node_id, edge_type, transfer_count, round(confidence_score, 6) AS confidence_score FROM g")
def graph_edges(spark, d):
    return _graph(spark, d)[1].select("source_node_id", "target_node_id", "edge_type", "transfer_count", F.round("confidence_score", 6).alias("confidence_score"))


@query(g_sql(1, True) + " SELECT node_id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(degree AS BIGINT) AS degree, weighted_in, weighted_out, weighted_degree FROM deg")
def graph_degrees(spark, d):
    return graph.degrees(*_graph(spark, d))


def _top_sql(column: str) -> str:
    return g_sql(1, True) + f" SELECT node_id, {column} AS weighted_degree, coalesce(node_type, 'unknown') AS node_type, coalesce(name, '') AS name FROM (SELECT * FROM deg ORDER BY {column} DESC, node_id LIMIT 20) JOIN v USING (node_id)"


@query(_top_sql("weighted_in"))
def graph_degree_topn_in(spark, d):
    return graph.top_degree(*_graph(spark, d), "in", 20)


@query(_top_sql("weighted_out"))
def graph_degree_topn_out(spark, d):
    return graph.top_degree(*_graph(spark, d), "out", 20)


@query(_top_sql("weighted_degree"))
def graph_degree_topn_total(spark, d):
    return graph.top_degree(*_graph(spark, d), "total", 20)


@query(g_sql() + " SELECT n AS n_nodes, m AS n_edges, w AS total_weight, round(m / (CAST(n AS DOUBLE) * (n - 1)), 8) AS density, round(2 * m / n, 6) AS average_degree FROM (SELECT count(*) AS n FROM v), (SELECT count(*) AS m, sum(transfer_count) AS w FROM g)")
def graph_summary(spark, d):
    return graph.summary(*_graph(spark, d))


@query(g_sql(1, True) + """, r AS (SELECT min(degree) AS lo, max(degree) AS hi FROM deg) SELECT CAST(least(floor((degree - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, count(*) AS n_nodes,
  min(round(lo + least(floor((degree - lo) / ((hi - lo) / 40)), 39) * ((hi - lo) / 40), 6)) AS bin_start FROM deg, r GROUP BY 1""")
def graph_degree_histogram(spark, d):
    return graph.degree_histogram(*_graph(spark, d))


_ISLANDS = "e AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM g WHERE edge_type = 'transfer' AND source_node_id <> target_node_id), "
_WCC = g_sql(12) + ", " + _ISLANDS + "u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (SELECT node_id, node_id FROM v UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a), w AS (SELECT a AS node_id, min(b) AS component FROM reach GROUP BY 1) "
_SCC = g_sql(12) + ", " + _ISLANDS + "reach(a, b) AS (SELECT node_id, node_id FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), w AS (SELECT x.a AS node_id, max(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1) "


def _islands(spark, d):
    """Only transfer edges, of rows with at least 12 transfers, which is what the ``_min12`` queries say."""
    v, e = _graph(spark, d, 12)
    return v, e.where("edge_type = 'transfer'")


# labels by key instead of all pairs, so that the whole graph can be gone through
_WCC_ALL = g_sql() + """, u AS MATERIALIZED (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM g WHERE source_node_id <> target_node_id UNION SELECT DISTINCT target_node_id, source_node_id FROM g WHERE source_node_id <> target_node_id),
  w(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM v UNION
    (SELECT u.b, min(w.component) FROM w JOIN u ON u.a = w.node_id JOIN recurring.w AS r ON r.node_id = u.b WHERE w.component < r.component GROUP BY u.b)) """


@query(_WCC_ALL + "SELECT node_id, component FROM w")
def graph_wcc(spark, d):
    """Weak components of the whole graph: every edge of every type, none left out for its count."""
    return graph.weak_components(*_graph(spark, d))


@query(_WCC_ALL + "SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM w GROUP BY 1) GROUP BY 1")
def graph_wcc_sizes(spark, d):
    return graph.component_sizes(graph_wcc(spark, d))


@query()
def graph_scc(spark, d):
    """Strong components of the whole graph; SQL would need all pairs, so they are tested against brute force."""
    return graph.strong_components(*_graph(spark, d))


@query()
def graph_scc_sizes(spark, d):
    return graph.component_sizes(graph_scc(spark, d))


@query(_WCC + "SELECT * FROM w")
def graph_wcc_min12(spark, d):
    return graph.weak_components(*_islands(spark, d))


@query(_WCC + "SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM w GROUP BY 1) GROUP BY 1")
def graph_wcc_sizes_min12(spark, d):
    return graph.component_sizes(graph_wcc_min12(spark, d))


@query(_SCC + "SELECT * FROM w")
def graph_scc_min12(spark, d):
    return graph.strong_components(*_islands(spark, d))


@query(_SCC + "SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM w GROUP BY 1) GROUP BY 1")
def graph_scc_sizes_min12(spark, d):
    return graph.component_sizes(graph_scc_min12(spark, d))


@query(g_sql(1, True) + """, kn AS (SELECT node_id FROM deg ORDER BY weighted_degree DESC, node_id LIMIT 100), ke AS (SELECT * FROM g WHERE source_node_id IN (SELECT node_id FROM kn) AND target_node_id IN (SELECT node_id FROM kn))
  SELECT source_node_id, target_node_id, transfer_count FROM ke ORDER BY transfer_count DESC, source_node_id, target_node_id LIMIT 150""")
def graph_subgraph(spark, d):
    return graph.subgraph(*_graph(spark, d), 100, 150)[1].select("source_node_id", "target_node_id", "transfer_count")


@query(g_sql() + " SELECT node_id FROM v WHERE node_id IN (SELECT source_node_id FROM g WHERE edge_type = 'residence' UNION SELECT target_node_id FROM g WHERE edge_type = 'residence')")
def graph_edge_type(spark, d):
    return graph.of_type(*_graph(spark, d), "residence")[0].select("node_id")


@query(g_sql() + """, st AS (SELECT min(source_node_id) AS n FROM g), l AS (SELECT source_node_id AS a, target_node_id AS b FROM g UNION SELECT target_node_id, source_node_id FROM g), h1 AS (SELECT DISTINCT b FROM l JOIN st ON a = n WHERE b <> n),
  h2 AS (SELECT DISTINCT b FROM l WHERE a IN (SELECT b FROM h1) AND b NOT IN (SELECT b FROM h1) AND b NOT IN (SELECT n FROM st)) SELECT n AS node_id, 0 AS hop FROM st UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2""")
def graph_two_hop(spark, d):
    e = _graph(spark, d)[1]
    return graph.neighbourhood(e, e.agg(F.min("source_node_id").alias("node_id")), 2)


@query(g_sql() + " SELECT node_id FROM v WHERE node_type = 'municipality'")
def graph_attribute_filter(spark, d):
    return graph.select_nodes(_graph(spark, d)[0], "node_type", ["municipality"])


@query(g_sql() + """, pl AS (SELECT node_id, min((latitude, longitude)) AS p FROM nodes WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1) SELECT source_node_id, target_node_id, transfer_count, a.p[1] AS source_latitude, a.p[2] AS source_longitude,
  b.p[1] AS target_latitude, b.p[2] AS target_longitude, round(least(greatest(1 + 0.35 * transfer_count, 1.0), 8.0), 6) AS line_width, a.p IS NOT NULL AND b.p IS NOT NULL AS drawn
  FROM (SELECT * FROM g ORDER BY transfer_count DESC, source_node_id, target_node_id LIMIT 500) LEFT JOIN pl a ON source_node_id = a.node_id LEFT JOIN pl b ON target_node_id = b.node_id""")
def viz_map_edges(spark, d):
    v, e = _graph(spark, d)
    return graph.map_edges(table(spark, d, "nodes"), e, 500)


@query(g_sql(1, True) + " SELECT node_id, round(least(greatest(8 + 0.6 * CAST(degree AS DOUBLE), 8.0), 40.0), 6) AS node_size, round(least(greatest(0.5 * weighted_degree, 0.8), 12.0), 6) AS edge_width, round(least(5.0, greatest(0.6, 0.04 * weighted_degree)), 6) AS page_width FROM deg")
def viz_scales(spark, d):
    deg = graph.degrees(*_graph(spark, d))
    return deg.select("node_id", F.round(nz.node_size(F.col("degree")), 6).alias("node_size"), F.round(nz.edge_width(F.col("weighted_degree")), 6).alias("edge_width"), F.round(nz.page_line_width(F.col("weighted_degree")), 6).alias("page_width"))


@query(g_sql() + " SELECT source_node_id, target_node_id FROM g WHERE edge_type = 'transfer' AND transfer_count >= 10 AND source_node_id IN (SELECT node_id FROM v WHERE node_type = 'facility') AND target_node_id IN (SELECT node_id FROM v WHERE node_type = 'facility') ORDER BY transfer_count DESC, 1, 2 LIMIT 80000")
def viz_ui_filter(spark, d):
    v, e = _graph(spark, d)
    kind = graph.select_nodes(v, "node_type", ["facility"])
    some = ed.at_least(e.where("edge_type = 'transfer'"), 10)
    for c in ("source_node_id", "target_node_id"):
        some = some.join(kind.select(F.col("node_id").alias(c)), c, "left_semi")
    return ed.top_by_count(some, 80_000).select("source_node_id", "target_node_id")


@query(f"SELECT {q_text('node_id')} AS node_id, {q_text('node_type')} AS node_type, {q_text('name')} AS name, {q_text('municipality_code')} AS municipality_code, latitude, longitude FROM nodes")
def export_ui_nodes(spark, d):
    return sinks.page_nodes(table(spark, d, "nodes"))


@query(g_sql() + " SELECT source_node_id, target_node_id, edge_type, transfer_count, confidence_score, '' AS match_method FROM g")
def export_ui_edges(spark, d):
    return sinks.page_edges(_graph(spark, d)[1]).withColumn("match_method", F.lit(""))


# --- manifest ------------------------------------------------------------------------------------------------------------
_FILES = "SELECT left(file_name, 8) || '.dbc' AS name, sum(length(payload)) AS size FROM raw_records GROUP BY 1"
_PARSED = f"SELECT substr(name, 3, 2) AS uf, 2000 + CAST(substr(name, 5, 2) AS INT) AS year, CAST(substr(name, 7, 2) AS INT) AS month, size FROM ({_FILES}) WHERE regexp_full_match(name, 'RD[A-Z]{{2}}[0-9]{{4}}\\.dbc')"


def _files(spark, d):
    f = table(spark, d, "raw_records").groupBy(F.concat(F.substring("file_name", 1, 8), F.lit(".dbc")).alias("name")).agg(F.sum(F.length("payload")).alias("size"))
    return manifest.parse_names(f)


@query(f"""SELECT y AS year, m AS month, count(size) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes, coalesce(string_agg(DISTINCT uf, ',' ORDER BY uf), '') AS ufs
  FROM (SELECT CAST(y AS INT) AS y, CAST(unnest(range(1, 13)) AS INT) AS m FROM (SELECT unnest([2020, 2021]) AS y)) LEFT JOIN ({_PARSED}) p ON p.year = y AND p.month = m GROUP BY 1, 2""")
def manifest_grid(spark, d):
    years, months = manifest.numbers("2020-2021", 2000, 2030, "years"), manifest.numbers("1-12", 1, 12, "months")
    return manifest.by_month(manifest.select_files(_files(spark, d), years, months), years, months)


@query(f"SELECT uf, year, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM ({_PARSED}) GROUP BY ROLLUP (uf, year) UNION ALL SELECT 'SP', NULL, 0, 0 WHERE 'SP' NOT IN (SELECT uf FROM ({_PARSED}))")
def manifest_by_uf(spark, d):
    return manifest.by_state(_files(spark, d), ["SP"])


_OUT = f"""SELECT name, substr(name, 3, 2) AS uf, 2000 + CAST(substr(name, 5, 2) AS INT) AS year, CAST(substr(name, 7, 2) AS INT) AS month, substr(name, 9, 1) AS part, size
  FROM (SELECT left(file_name, 8) || chr(CAST(97 + file_id % 3 AS INT)) || '.dbc' AS name, sum(length(payload)) AS size FROM raw_records GROUP BY 1) WHERE regexp_full_match(name, 'PAQA[0-9]{{4}}[a-z]\\.dbc')"""


@query(f"SELECT name, uf, year, month, part, CAST(size AS BIGINT) AS size FROM ({_OUT}) ORDER BY year, month, part, name LIMIT 20")
def manifest_outpatient(spark, d):
    """The first files of an outpatient listing, in the order in which they are fetched."""
    name = F.concat(F.substring("file_name", 1, 8), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("file_id") % 3 + 1).cast("int")), F.lit(".dbc"))
    f = table(spark, d, "raw_records").groupBy(name.alias("name")).agg(F.sum(F.length("payload")).cast("long").alias("size"))
    return manifest.in_order(manifest.parse_names(f, manifest.outpatient("PAQA")), 20).select("name", "uf", "year", "month", "part", "size")


@query(g_sql() + """, pl AS (SELECT * FROM nodes WHERE latitude IS NOT NULL AND longitude IS NOT NULL), ids AS (SELECT DISTINCT node_id FROM pl), t AS (SELECT source_node_id IN (SELECT node_id FROM ids) AND target_node_id IN (SELECT node_id FROM ids) AS drawn
  FROM (SELECT * FROM g ORDER BY transfer_count DESC, source_node_id, target_node_id LIMIT 500))
  SELECT (SELECT count(*) FROM pl WHERE lower(node_type) = 'facility') AS facility_markers, (SELECT count(*) FROM pl WHERE lower(node_type) = 'municipality') AS municipality_markers, (SELECT round(avg(latitude), 6) FROM pl) AS centre_latitude,
  (SELECT round(avg(longitude), 6) FROM pl) AS centre_longitude, count(*) AS edges_considered, count(*) FILTER (drawn) AS edges_drawn, count(*) FILTER (NOT drawn) AS edges_without_coordinates FROM t""")
def viz_map_summary(spark, d):
    places, e = table(spark, d, "nodes"), _graph(spark, d)[1]
    return graph.map_summary(places, graph.map_edges(places, e, 500))


@query()
def gate_header_report(spark, d):
    """The schema gate for the header of every file of raw_records."""
    headers = drift.line_fields(table(spark, d, "raw_records"), ["file_id"]).groupBy("file_id").agg(F.array_sort(F.collect_set("field")).alias("header"))
    return roles.gate_headers(headers, "file_id", "header")


@query(f"SELECT node_type, node_id, name, municipality_code, row_number() OVER (ORDER BY node_type, node_id) AS place FROM ({SQL['nodes_build']}) ORDER BY place LIMIT 200")
def nodes_sorted(spark, d):
    """The first nodes as the sinks write them, by type and id."""
    first = nodes_build(spark, d).orderBy("node_type", "node_id").limit(200)
    return first.select("node_type", "node_id", "name", "municipality_code", F.row_number().over(Window.orderBy("node_type", "node_id")).cast("long").alias("place"))
