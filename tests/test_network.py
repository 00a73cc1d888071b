"""Operators of the flow network on small inputs: the known cases, and odd ones."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caudal.functions import geometry
from caudal.functions import normalize as nz
from caudal import session
from caudal.operators import edges, enrich, graph, manifest, match, nodes, roles

REC = "patient_id string, PA_TRANSF string, PA_MOTSAI string, PA_SEXO string, PA_IDADE string, PA_CIDPRI string, PA_CODUNI string, DT_INTER string, DT_SAIDA string"


def run(spark, rows, codes=(), **cfg):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid long, " + REC)
    ev, rej = match.infer(df, list(codes), match.MatchConfig(order="rid", **cfg))
    return ev.collect(), {r.reason: r.n for r in rej.collect()}


def anchor(sex="F", age="55", icd="I500", fac="A", entry="2021-01-01", leave="2021-01-02 06:00:00", flag="1", reason=None, who="p"):
    return (who, flag, reason, sex, age, icd, fac, entry, leave)


def other(entry, sex="F", age="55", icd="I509", fac="B", who="p"):
    return (who, "0", None, sex, age, icd, fac, entry, None)


def test_match_happy(spark):
    ev, rej = run(spark, [anchor(), other("2021-01-03 08:00:00")])
    assert rej == {} and [(e.source_facility_id, e.target_location_id, e.delta_hours) for e in ev] == [("A", "B", 26.0)]
    assert len(ev[0].event_id) == 20
    assert match.transfer_edges(spark.createDataFrame(ev)).first().transfer_count == 1


@pytest.mark.parametrize("rows, reason", [
    ([anchor(leave="2021-01-01 10:00:00"), other("2021-01-02 06:00:00")], "no_candidate_in_time_window"),
    ([anchor(), other("2021-01-03 08:00:00", sex="M")], "demographic_mismatch"),
    ([anchor(age="55"), other("2021-01-03 08:00:00", age=None)], "demographic_mismatch"),
    ([anchor(), other("2021-01-03 08:00:00", icd="O470")], "clinical_discontinuity"),
    ([anchor(leave=None)], "missing_discharge_datetime"),
    ([anchor(age="131")], "missing_demographic_data"),
    ([anchor(age="45.5")], "missing_demographic_data"),
    ([anchor(sex=" ")], "missing_demographic_data"),
    ([anchor(icd="D")], "missing_or_invalid_icd"),
    ([anchor(who="  ")], "missing_patient_key"),
])
def test_match_rejections(spark, rows, reason):
    assert run(spark, rows) == ([], {reason: 1})


def test_match_ends_ties_and_copies(spark):
    for hours, found in ((24, 1), (48, 1), (23.999, 0), (48.001, 0)):
        entry = datetime.fromtimestamp(datetime(2021, 1, 2, 6).timestamp() + hours * 3600).isoformat(sep=" ")
        assert len(run(spark, [anchor(), other(entry)])[0]) == found
    tie = [anchor(flag=None, reason="TR"), other("2021-01-03 08:00:00", icd="I500", fac="C"), other("2021-01-03 08:00:00", fac="B")]
    ev, rej = run(spark, tie, ["TR"])
    assert ev[0].target_location_id == "C" and rej == {}
    shared = [anchor(), anchor(), other("2021-01-03 08:00:00"), *[other("2021-01-03 08:00:00", fac="Z")] * 5]
    assert [e.target_location_id for e in run(spark, shared)[0]] == ["B", "B"]
    same = [anchor(), other("2021-01-03 08:00:00", fac="A")]
    assert len(run(spark, same)[0]) == 1 and run(spark, same, exclude_same_facility=True)[1] == {"no_candidate_in_time_window": 1}
    assert run(spark, [anchor(entry=None)]) == ([], {}) and run(spark, []) == ([], {})
    own = [anchor(entry="2021-01-03 08:00:00", leave="2021-01-02 06:00:00")]
    assert run(spark, own)[1] == {"no_candidate_in_time_window": 1}
    with pytest.raises(ValueError):
        match.MatchConfig(min_hours=3, max_hours=2)
    with pytest.raises(ValueError):
        match.prepare(spark.createDataFrame([], "a int"), [], match.MatchConfig())


def test_match_past_repeated_lines_of_the_own_facility(spark):
    rows = [anchor(), *[other("2021-01-03 08:00:00", fac="A")] * 3, other("2021-01-03 08:00:00", fac="B"), other("2021-01-03 08:00:00", fac="C")]
    ev, rej = run(spark, rows, exclude_same_facility=True)
    assert [e.target_location_id for e in ev] == ["B"] and rej == {}
    assert [e.target_location_id for e in run(spark, rows)[0]] == ["A"]


def test_match_scope(spark):
    rows = [("p", "1", "F", "5", "I5", "A", "2021-01-30", "2021-01-31", "01"), ("p", "0", "F", "5", "I5", "B", "2021-02-01", None, "02")]
    df = spark.createDataFrame(rows, "patient_id string, PA_TRANSF string, PA_SEXO string, PA_IDADE string, PA_CIDPRI string, PA_CODUNI string, DT_INTER string, DT_SAIDA string, m string")
    assert match.infer(df, [])[0].count() == 1 and match.infer(df, [], match.MatchConfig(scope="m"))[0].count() == 0


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("code, chapter", [("A00", "I"), ("D48", "II"), ("D49", "III"), ("D", None), ("H59", "VII"), ("H60", "VIII"), ("H", None), ("U07", "XXII"), ("Z9", "XXI"), ("Y", "XX"), ("1", None), (None, None)])
def test_chapters(spark, code, chapter):
    assert one(spark, lambda c: nz.chapter(nz.diagnosis(c)), code) == chapter


@pytest.mark.parametrize("f, x, want", [
    (nz.municipality, "3550308.0", "3550308"), (nz.municipality_for_nodes, "3550308.0", "503080"), (nz.code6_strict, "3550308", "355030"), (nz.code6_strict, "35503", ""),
    (nz.code6_loose, "35503", ""), (nz.municipality, None, ""), (nz.facility_code, " 77 ", "0000077"), (nz.facility_code, "", ""), (nz.facility_code, "123456789", "3456789"),
    (nz.zero_fill, "1", "01"), (nz.zero_fill, "123", "123"), (nz.number, "nan", None), (nz.number, "1.0d", None), (nz.number, " 2e1 ", 20.0), (nz.truthy_code, "Sim", True), (nz.truthy_batch, "1.00", True),
    (nz.truthy_reference, "1.0", False), (nz.age, "130", 130), (nz.age, "-1", None), (lambda c: nz.moment(c).cast("string"), "20210124", "2021-01-24 00:00:00"), (lambda c: nz.moment(c).cast("string"), "2021-02-30", None),
])
def test_scalars(spark, f, x, want):
    assert one(spark, f, x) == want


def test_subject_key(spark):
    df = spark.createDataFrame([("19800102", "f", "45", "3550308"), ("1981-03-04", "M", "46", "3552205"), (None, "M", "1", "1")], "b string, s string, a string, r string")
    assert [r[0] for r in df.select(nz.subject_key(F.col("b"), F.col("s"), F.col("a"), F.col("r"))).collect()] == ["1980-01-02|F|45|3550308", "1981-03-04|M|46|3552205", ""]


def test_projection_and_outcomes(spark):
    header = "MUNIC_RES CGC_HOSP DIAG_PRINC NASC IDADE SEXO DT_INTER DT_SAIDA COBRANCA DIAS_PERM MARCA_UTI PROC_REA VAL_TOT RACA_COR N_AIH".split()
    found, missing = roles.projection(header, True)
    assert (found["CODMUNRES"], found["CNES"], found["MOT_SAIDA"], found["N_AIH"]) == ("MUNIC_RES", "CGC_HOSP", "COBRANCA", "N_AIH") and missing == ["PA_TRANSF"]
    df = roles.project(spark.createDataFrame([("1", "2")], "MUNIC_RES string, extra string"))
    assert df.columns == list(roles.CANONICAL) and df.first().CODMUNRES == "1"
    codes = spark.createDataFrame([(c,) for c in ("31", "11", "21", "41", "99", None)], "MOT_SAIDA string")
    assert [r.MOT_SAIDA_GROUP for r in roles.outcome_features(codes).collect()] == ["transfer", "discharge", "permanence", "death", "other", "other"]


def test_gate():
    pa = ["PA_CODUNI", "PA_PROC_ID", "PA_CMP", "PA_MVM", "PA_SEXO", "PA_IDADE", "PA_CIDPRI", "PA_CNSMED", "PA_MUNPCN", "PA_MOTSAI"]
    blocked = roles.schema_gate(pa, 2)
    assert not blocked.passed and len(blocked.blockers) == 1 and "pair" in blocked.blockers[0] and "month" in str(blocked.warnings)
    assert roles.schema_gate([*pa, "DT_INTER", "DT_SAIDA"], 2).passed and not roles.schema_gate([*pa, "DT_INTER", "DT_SAIDA"], 0).passed
    sih = "N_AIH MUNIC_RES CNES DIAG_PRINC IDADE SEXO DT_INTER DT_SAIDA MOT_SAIDA".split()
    g = roles.schema_gate(sih, 2)
    assert g.passed and g.profile == "sih" and g.roles["patient_key"] == "N_AIH" and not g.probabilistic
    g = roles.schema_gate(["NASC", *sih[1:]], 2)
    assert g.passed and g.roles["patient_key"] is None and g.probabilistic
    assert roles.schema_gate([]).profile == "unknown" and "FAIL" in str(roles.schema_gate([]))


def test_nodes(spark):
    rec = spark.createDataFrame([("1001", "355030", "355030"), ("1001", "355030", "350950"), ("1002", "350950", "355030"), ("1002", "350950", "351060"), (" ", None, "999999")], "CNES string, MUNIC_MOV string, MUNIC_RES string")
    n = {r.node_id: r.municipality_code for r in nodes.build_nodes(rec).collect()}
    assert n["facility:1001"] == "355030" and sum(k.startswith("municipality:") for k in n) == 4
    tie = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", " "), ("2", None)], "CNES string, MUNIC_RES string")
    assert {r.location_id: r.municipality_code for r in nodes.facility_lookup(tie).collect()} == {"1": "a", "2": None}
    e = spark.createDataFrame([("1001", "1002", "facility"), ("1001", "355030", "municipality"), ("9999", "355030", "municipality")], "source_facility_id string, target_location_id string, target_location_type string")
    known = spark.createDataFrame([("facility:1001",), ("facility:1002",), ("municipality:355030",), ("facility:1001",)], "node_id string")
    c = nodes.coverage(nodes.map_edges(e, known)).first()
    assert (c.edges_total, c.source_missing, c.target_missing) == (3, 1, 0)
    assert nodes.coverage(nodes.map_edges(e.limit(0), known)).first().source_missing_ratio == 0.0
    some = nodes.as_nodes(known.where("node_id LIKE 'm%'"), node_id=F.col("node_id"), node_type=F.lit("municipality"), municipality_code=F.lit("355030"))
    assert nodes.append_municipalities(some, spark.createDataFrame([("355030",), ("330455",), ("1302603",), (None,)], "c string"), "c").count() == 3
    with pytest.raises(ValueError):
        nodes.build_nodes(spark.createDataFrame([], "x string"))


def test_contract(spark):
    n = spark.createDataFrame([("facility:1", "facility", "1", "A"), ("municipality:2", "municipality", "2", "B")], "node_id string, node_type string, municipality_code string, name string")
    e = spark.createDataFrame([("facility:1", "municipality:2", 1.0)], "source_node_id string, target_node_id string, transfer_count double")
    assert nodes.contract(n, e)["passed"]
    assert not nodes.contract(n.limit(1), e)["passed"]
    blank = nodes.contract(n.withColumn("name", F.lit(" ")), e)
    assert blank["passed"] and blank["warnings"]
    null = e.withColumn("transfer_count", F.lit(None).cast("double"))
    assert nodes.contract(n, null)["passed"] and not nodes.contract(n, null, strict_nulls=True)["passed"]
    assert not nodes.contract(n.drop("node_type"), e)["passed"]
    assert nodes.contract_metrics(n.limit(0), e.limit(0)).first().nodes_total == 0


def test_enrichment(spark):
    cat = spark.createDataFrame([(3550308, "Sao Paulo", ((("SP",),),)), (1100015, "Alta", None)], "id long, nome string, microrregiao struct<mesorregiao: struct<UF: struct<sigla: string>>>")
    centres = spark.createDataFrame([("3550308", -23.55052, -46.63331)], "ibge_id string, lat double, lon double")
    base = spark.createDataFrame([("municipality:355030", "municipality", None, "355030"), ("facility:2077485", "facility", None, "355030"), ("facility:1", "facility", "Named", "355030"), ("facility:2", "facility", " ", "110001"), ("facility:3", "facility", "", None)], "node_id string, node_type string, name string, municipality_code string")
    n = nodes.as_nodes(base, **{c: F.col(c) for c in base.columns})
    got = {r.node_id: r for r in enrich.enrich_municipalities(n, cat, centres).collect()}
    assert got["municipality:355030"].name == "Sao Paulo - SP" and got["facility:2077485"].name == "CNES 2077485 (Sao Paulo - SP)"
    assert got["facility:2077485"].latitude == -23.55052 and got["facility:1"].latitude is None
    assert got["facility:2"].name == "CNES 2 (Alta)" and got["facility:3"].name == "CNES 3"
    ref = spark.createDataFrame([("2077485", "Hospital", " ", 1.5), ("2077485", "Other", "x", 2.5)], "cnes string, name string, municipality_code string, latitude double")
    out, cells = enrich.enrich_facilities(n, ref)
    r = out.where("node_id = 'facility:2077485'").select("name", "municipality_code", "latitude", cells.alias("c")).first()
    assert (r.name, r.municipality_code, r.latitude, r.c) == ("Hospital", "355030", 1.5, 2)
    assert sorted(r.code for r in enrich.catalog_codes(cat, 6).collect()) == ["110001", "355030"]
    with pytest.raises(ValueError):
        enrich.catalog_codes(cat, 5)
    with pytest.raises(ValueError):
        enrich.public_hospital(cat)


def centroid(spark, kind, p, m=None):
    r = spark.createDataFrame([(kind, p, m)], "k string, p array<array<array<double>>>, m array<array<array<array<double>>>>")
    c = r.select(geometry.geometry_centroid(F.col("k"), F.col("p"), F.col("m")).alias("c")).first().c
    return None if c is None else (round(c.lon, 6), round(c.lat, 6))


def test_geometry(spark):
    sq = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    closed = [*sq, sq[0]]
    assert centroid(spark, "Polygon", [closed]) == centroid(spark, "Polygon", [sq]) == (0.5, 0.5)
    assert centroid(spark, "Polygon", [[*sq[:2], [9.0], None, *sq[2:]]]) == (0.5, 0.5)
    assert centroid(spark, "Polygon", [closed, [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]]) == (0.5, 0.5)
    assert centroid(spark, "Polygon", [[[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [0.0, 0.0]]]) == (1.0, 1.0)
    big = [[10.0, 0.0], [12.0, 0.0], [12.0, 2.0], [10.0, 2.0]]
    assert centroid(spark, "MultiPolygon", None, [[sq], [big]]) == (round((0.5 + 4 * 11) / 5, 6), round((0.5 + 4) / 5, 6))
    assert centroid(spark, "Polygon", []) is None and centroid(spark, None, None) is None and centroid(spark, "Point", None) is None


def g(spark, es, vs=()):
    e = spark.createDataFrame([(a, b, float(w), "transfer") for a, b, w in es], "source_node_id string, target_node_id string, transfer_count double, edge_type string")
    v = spark.createDataFrame([(x, None, None) for x in sorted({*vs, *(x for a, b, _ in es for x in (a, b))})], "node_id string, node_type string, name string")
    return v, e


def test_graph(spark):
    v, e = g(spark, [("a", "b", 2), ("b", "a", 1), ("b", "c", 5), ("c", "c", 3)], ["z"])
    d = {r.node_id: r for r in graph.degrees(v, e).collect()}
    assert (d["c"].in_degree, d["c"].out_degree, d["c"].degree, d["c"].weighted_degree) == (2, 1, 3, 11.0) and d["z"].degree == 0
    s = graph.summary(v, e).first()
    assert (s.n_nodes, s.n_edges, s.average_degree, s.density) == (4, 4, 2.0, round(4 / 12, 8))
    assert graph.subgraph(v, e, 10, 10)[0].count() == 4 and graph.subgraph(v, e, 3, 1)[0].count() == 2
    assert graph.summary(v.limit(0), e.limit(0)).first().density == 0.0
    assert sorted((r.bin, r.n_nodes) for r in graph.degree_histogram(v, e, 5).collect()) == [(0, 1), (3, 1), (4, 2)]
    assert {(r.node_id, r.hop) for r in graph.neighbourhood(e, v.where("node_id = 'a'"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_components_against_brute_force(spark):
    import random

    for seed in range(3):
        rnd = random.Random(seed)
        es = [(f"n{rnd.randint(0, 25):02d}", f"n{rnd.randint(0, 25):02d}", 1) for _ in range(24)] + [(f"p{k}", f"p{k + 1}", 1) for k in range(9)]
        v, e = g(spark, es, ["lone"])
        ids = [r.node_id for r in v.collect()]
        reach = {x: {x} for x in ids}
        both = {x: {x} for x in ids}
        for _ in ids:
            for a, b, _w in es:
                for x in ids:
                    if a in reach[x]:
                        reach[x].add(b)
                    if a in both[x] or b in both[x]:
                        both[x] |= {a, b}
        assert {r.node_id: r.component for r in graph.weak_components(v, e).collect()} == {x: min(both[x]) for x in ids}
        assert {r.node_id: r.component for r in graph.strong_components(v, e).collect()} == {x: max(y for y in reach[x] if x in reach[y]) for x in ids}
    v, e = g(spark, [("a", "b", 1)])
    assert graph.weak_components(v.limit(0), e.limit(0)).count() == graph.strong_components(v.limit(0), e.limit(0)).count() == 0


def test_paths_rings_and_lassos(spark, monkeypatch):
    """A long path, a ring, and a ring with tails take few tables, however long they are."""
    name = lambda k: f"n{k * 7919 % 100_003:06d}"
    path = [(name(k), name(k + 1)) for k in range(10_000)]
    ring = [(f"r{k:03d}", f"r{(k + 1) % 300:03d}") for k in range(300)]
    tails = [(f"s{k:03d}", f"s{k + 1:03d}") for k in range(100)] + [("s100", "r000"), ("r150", "t000")] + [(f"t{k:03d}", f"t{k + 1:03d}") for k in range(100)]
    links = path + ring + tails
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, by=None: written.append(1) or session.cut(df, by))
    e = spark.createDataFrame(links, "source_node_id string, target_node_id string")
    v = spark.createDataFrame([(x,) for x in {x for l in links for x in l}], "node_id string")
    got = {r.node_id: r.component for r in graph.strong_components(v, e).collect()}
    assert len(got) == v.count() and all(c == ("r299" if n.startswith("r") else n) for n, c in got.items())
    assert len(written) < 200


def test_components_are_whole_or_none(spark):
    whole = lambda x: [(f"{x}{i}", f"{x}{j}", 1) for i in (1, 2, 3) for j in (1, 2, 3) if i != j]
    v, e = g(spark, [*whole("c"), ("c2", "b1", 1), *whole("b")])
    with pytest.raises(RuntimeError):
        graph.strong_components(v, e, rounds=1)
    with pytest.raises(RuntimeError):
        graph.weak_components(v, e, rounds=1)
    assert {r.node_id: r.component for r in graph.strong_components(v, e).collect()} == {f"{x}{i}": f"{x}3" for x in "bc" for i in (1, 2, 3)}


def test_components_of_the_whole_graph(spark, folder):
    from caudal.plans import network

    v, e = (x.collect() for x in network._graph(spark, folder))
    ids = {r.node_id for r in v}
    assert any(r.edge_type == "residence" for r in e) and any(r.transfer_count < 12 for r in e)
    after, before = {x: set() for x in ids}, {x: set() for x in ids}
    for r in e:
        after[r.source_node_id].add(r.target_node_id)
        before[r.target_node_id].add(r.source_node_id)

    def reached(x, *steps):
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for z in set().union(*(s[y] for s in steps)) - seen:
                seen.add(z)
                todo.append(z)
        return seen

    weak, strong = {}, {}
    for x in ids:
        weak[x] = weak.get(x) or min(reached(x, after, before))
        if x not in strong:
            own = reached(x, after) & reached(x, before)
            strong.update(dict.fromkeys(own, max(own)))
    got = {n: network.QUERIES[n](spark, folder).collect() for n in ("graph_wcc", "graph_scc")}
    assert len(got["graph_wcc"]) == len(got["graph_scc"]) == len(ids)
    assert {r.node_id: r.component for r in got["graph_wcc"]} == weak
    assert {r.node_id: r.component for r in got["graph_scc"]} == strong


def test_rollup_and_build(spark):
    rows = [("f:1", "f:2", "transfer", 2.0, 1.0, None, "02"), ("f:1", "f:2", "transfer", None, 0.5, "m2", "03"), ("f:1", "f:2", "residence", 9.0, None, "m1", "01"), (" ", "f:2", None, 5.0, None, None, "01")]
    p = spark.createDataFrame(rows, "source_node_id string, target_node_id string, edge_type string, transfer_count double, confidence_score double, match_method string, period string")
    r = edges.roll_up(p).where("edge_type = 'transfer' AND source_node_id = 'f:1'").first()
    assert (r.transfer_count, r.confidence_score, r.match_method) == (3.0, 0.75, "m2")
    v, e = graph.build(spark.createDataFrame([("f:1", "facility", "x"), ("f:1", "facility", "a"), ("", "facility", "b")], "node_id string, node_type string, name string"), p, 2, order="period")
    r = e.collect()
    assert len(r) == 1 and (r[0].edge_type, r[0].transfer_count) == ("transfer", 2.0)
    assert {x.node_id: x.name for x in v.collect()} == {"f:1": "a", "f:2": None}


def test_selectors():
    assert manifest.numbers("2021,2023-2024", 2000, 2030) == {2021, 2023, 2024} and manifest.numbers("0,3", 1, 12, lenient=True) == {3}
    for bad in ("0", "", "5-3", "13"):
        with pytest.raises(ValueError):
            manifest.numbers(bad, 1, 12)
    assert manifest.states("sp, rj") == ["RJ", "SP"] and manifest.states("ALL") == []
    with pytest.raises(ValueError):
        manifest.states("SP,XX")
    assert manifest.competence("202101") == manifest.competence("2101") == "2101"
    assert manifest.batch_tag("Sih Br!", 2021, 1, ["SP"], ["I5"], 2.5) == "sihbr_202101_ufs-sp_icd-i5_tmin-2p5" and manifest.sanitise("--") == "all"
