"""Extra columns with clashing names, empty and very long values, repeated rows: no operator may trip over them."""

from datetime import datetime

from pyspark.sql import functions as F

from caudal.operators import drift, edges, graph, match, nodes, orphans, profile, skew

T0 = datetime(2021, 3, 1)
CLASH = ("n", "key_rows", "_salt", "value", "column_name", "token", "field", "text", "waiting", "_r", "rank", "strength", "tokens", "_doc", "m", "c")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def violations(rows):
    return profile.violations(profile.value_deltas(rows, list(profile.RULES)), rows, "stay_id")


def test_clashing_columns(spark):
    rows = clashing(spark.createDataFrame([(1, "350000", "a", 1), (1, None, "a", 2)], "load_id long, munic_res string, k string, v long"))
    assert profile.load_profile(profile.value_deltas(rows, ["munic_res"])).first().n_blank == 1
    assert violations(clashing(spark.createDataFrame([(1, 7, "x", None, " ", "1")], "load_id long, stay_id long, munic_res string, nasc string, dt_inter string, cgc_hosp string"))).count() == 2
    assert skew.salted_totals(rows, "k", "v", ["a"]).first().total == 3
    assert skew.salted_top(rows, "k", "munic_res", "v", 1, ["a"]).count() == 1
    raw = clashing(spark.createDataFrame([(1, 1, 1, '{"A": "x"}'), (2, 2, 1, '{"B": "20210101"}')], "raw_id long, file_id long, stream_id long, payload string").drop("field"))
    ch = drift.schema_changes(raw)
    assert {(r.change_kind, r.field_name) for r in ch.collect()} == {("added", "B"), ("removed", "A")}
    assert drift.unified(raw, ch, ["raw_id", "stream_id", "file_id"])[0].count() == 2
    parents = clashing(spark.createDataFrame([("k", T0, None)], "ref_id string, born timestamp, gone timestamp"))
    refs = spark.createDataFrame([("t", 1, "c", "p", "k", T0)], orphans.REFS)
    assert orphans.track_orphans(refs, parents, "ref_id", "born", "gone")[0].count() == 0
    rec = clashing(spark.createDataFrame([("1", "355030")], "CNES string, MUNIC_RES string"))
    assert nodes.build_nodes(rec).count() == 2 and edges.residence_edges(rec).count() == 1
    e = spark.createDataFrame([("facility:1", "municipality:2", 1.0, "transfer")], "source_node_id string, target_node_id string, transfer_count double, edge_type string")
    v, g = graph.build(clashing(nodes.build_nodes(rec)), clashing(e))
    assert graph.summary(v, g).first().n_edges == 1 and graph.top_degree(v, g, "in", 1).first().node_id == "municipality:2"


def test_long_and_empty_values(spark):
    long = "9" * 100_000
    rows = spark.createDataFrame([(1, 1, long, "", "x" * 100_000, "0" * 14), (1, 2, "", None, None, " ")], "load_id long, stay_id long, munic_res string, nasc string, dt_inter string, cgc_hosp string")
    assert {(r.stay_id, r.column_name) for r in violations(rows).collect()} == {(1, "munic_res"), (1, "dt_inter"), (1, "cgc_hosp")}
    raw = spark.createDataFrame([(1, 1, 1, f'{{"A": "{long}"}}'), (2, 2, 1, f'{{"A": "{long}", "": ""}}')], "raw_id long, file_id long, stream_id long, payload string")
    assert {(r.change_kind, r.field_name) for r in drift.schema_changes(raw).collect()} == {("added", "")}
    df = spark.createDataFrame([("p", "1", "F", "5", "I" * 50_000, "A", "x", long)], "patient_id string, PA_TRANSF string, PA_SEXO string, PA_IDADE string, PA_CIDPRI string, PA_CODUNI string, DT_INTER string, DT_SAIDA string")
    assert match.infer(df, [])[0].count() == 0


def test_repeated_rows_are_counted_as_they_are(spark):
    raw = spark.createDataFrame([(1, 1, 1, '{"A": "x"}')] * 3 + [(2, 2, 1, '{"A": 5}')] * 2, "raw_id long, file_id long, stream_id long, payload string")
    ch = drift.schema_changes(raw)
    assert [(r.change_kind, r.field_name) for r in ch.collect()] == [("retyped", "A")]
    e = spark.createDataFrame([("facility:1", "facility:2", 2.0)] * 2, "source_node_id string, target_node_id string, transfer_count double")
    v = spark.createDataFrame([("facility:1",)] * 2, "node_id string")
    assert graph.build(v, e)[1].first().transfer_count == 4.0 and graph.build(v, e)[0].count() == 2
