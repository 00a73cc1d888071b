"""SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from ..functions import fields

_DAY = (
    "CASE WHEN regexp_full_match(trim(nasc), '[0-9]{8}') THEN try_strptime(trim(nasc), '%Y%m%d') "
    "WHEN regexp_full_match(trim(nasc), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_strptime(trim(nasc), '%Y-%m-%d') END"
)
_STATES = ", ".join(f"'{s}'" for s in fields.STATE_CODES)
_PLACE = f"CASE WHEN regexp_full_match(trim(munic_res), '[0-9]{{6,7}}') AND substr(trim(munic_res), 1, 2) IN ({_STATES}) THEN substr(trim(munic_res), 1, 6) END"
_ENTRY = (
    "CASE WHEN regexp_full_match(trim(dt_inter), '[0-9]{14}') THEN try_strptime(trim(dt_inter), '%Y%m%d%H%M%S') "
    "WHEN regexp_full_match(trim(dt_inter), '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN try_strptime(trim(dt_inter), '%Y-%m-%d %H:%M:%S') END"
)
_P1 = f"""
WITH s AS (SELECT stay_id, {_DAY} AS day, {_PLACE} AS place, {_ENTRY} AS t FROM stays),
s2 AS (SELECT * FROM s WHERE day BETWEEN TIMESTAMP '1900-01-01' AND TIMESTAMP '2021-12-31' AND t BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2021-12-31 23:59:59'),
e AS (SELECT exit_id, {_DAY} AS day, {_PLACE} AS place, dt_saida AS t FROM transfer_exits),
j AS (SELECT exit_id, stay_id, abs(epoch_us(e.t) - epoch_us(s2.t)) AS us FROM e JOIN s2 USING (day, place))
SELECT exit_id, stay_id, us / 1e6 AS distance_s FROM j WHERE us <= 172800000000
QUALIFY row_number() OVER (PARTITION BY exit_id ORDER BY us, stay_id) = 1
"""
_P8_PLAN = """
WITH s AS (SELECT source_name AS source, target_share, max_repeats, count(doc_id) AS n_docs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS available_tokens
  FROM mix_targets LEFT JOIN documents ON source = source_name GROUP BY 1, 2, 3),
u AS (SELECT *, available_tokens * max_repeats AS most, available_tokens * max_repeats / target_share AS full_at FROM s WHERE available_tokens > 0 AND target_share > 0 AND max_repeats > 0),
o AS (SELECT *, coalesce(sum(most) OVER w, 0) AS full_before, sum(target_share) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_share FROM u
  WINDOW w AS (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(((SELECT sum(n_chars) FROM documents) - full_before) / open_share, full_at) FILTER (((SELECT sum(n_chars) FROM documents) - full_before) / open_share <= full_at) AS level FROM o)
SELECT s.source, s.target_share, s.max_repeats, s.n_docs, s.available_tokens,
  CAST(round(CASE WHEN u.source IS NULL THEN 0 ELSE least(most, coalesce((SELECT level FROM l), most / s.target_share) * s.target_share) END) AS BIGINT) AS planned_tokens
FROM s LEFT JOIN u ON s.source = u.source
"""
SQL = {"p8_plan_by_length": _P8_PLAN, "p1_found": f"SELECT exit_id, stay_id FROM ({_P1})", "p1_nearest": _P1}
