"""Sources and sinks as round trips on temporary files; remote ones with fakes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from caudal.operators import graph, manifest, roles
from caudal.plans import pipelines
from caudal.sources import dbf, readers, remote, sinks
from caudal.streaming import live

FIELDS = [("CNES", "C", 7), ("IDADE", "N", 3), ("DIAG_PRINC", "C", 4)]
ROWS = [("0000077", 45, "I500"), ("0000078", None, "É1"), ("0000079", 7, None)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("007", None, 'a "b";\nc'), ("NA", "x", "")], "id string, n string, t string")
    sinks.write_csv_file(df, f"{tmp_path}/a.csv")
    assert open(f"{tmp_path}/a.csv", "rb").read(3) == b"\xef\xbb\xbf"
    got = readers.read_csv(spark, f"{tmp_path}/a.csv").collect()
    assert [tuple(r) for r in got] == [("007", None, 'a "b";\nc'), (None, "x", None)]
    assert readers.read_header(spark, f"{tmp_path}/a.csv") == ["id", "n", "t"]
    sinks.save(df, f"{tmp_path}/a.parquet")
    assert spark.read.parquet(f"{tmp_path}/a.parquet").count() == 2
    with pytest.raises(ValueError):
        sinks.save(df, "a.txt")


def test_code_book(spark):
    book = spark.createDataFrame([("31", "true", "1"), (" 32 ", "Sim", "yes"), ("11", "false", "true"), ("", "1", "1"), ("12", "1", None)], "code string, is_transfer string, validated string")
    assert readers.transfer_codes(book) == ["31", "32"]
    with pytest.raises(ValueError):
        readers.transfer_codes(book.drop("validated"))


def test_dbf(spark, tmp_path):
    data = dbf.write_dbf(ROWS, FIELDS)
    (tmp_path / "a.dbf").write_bytes(data)
    bad = bytearray(dbf.write_dbf(ROWS, FIELDS))
    bad[bad.index(b" 45")  : bad.index(b" 45") + 3] = b"4x5"
    bad[dbf.parse_header(bytes(bad))[1] + 2 * dbf.parse_header(bytes(bad))[2]] = ord("*")
    (tmp_path / "b.dbf").write_bytes(bytes(bad))
    spark.dataSource.register(dbf.DbfSource)
    got = spark.read.format("dbf").load(str(tmp_path)).orderBy("CNES", "IDADE").collect()
    assert [tuple(r) for r in got] == [("0000077", None, "I500"), ("0000077", "45", "I500"), ("0000078", None, "É1"), ("0000078", None, "É1"), ("0000079", "7", None)]
    two = spark.read.format("dbf").option("columns", "DIAG_PRINC,NONE").option("limit", 1).load(str(tmp_path / "a.dbf"))
    assert [tuple(r) for r in two.collect()] == [("I500", None)]
    assert roles.project(spark.read.format("dbf").load(str(tmp_path / "a.dbf"))).where("CNES = '0000077'").first().IDADE == "45"
    with pytest.raises(Exception):
        spark.read.format("dbf").load(f"{tmp_path}/none").collect()


def test_dbf_splits_and_names_files(spark, tmp_path):
    (tmp_path / "STSP2101.dbf").write_bytes(dbf.write_dbf(ROWS * 50, FIELDS))
    whole = list(dbf.records(dbf.write_dbf(ROWS * 50, FIELDS)))
    path, n = str(tmp_path / "STSP2101.dbf"), len(whole)
    assert [r for k in range(0, n, 7) for r in dbf.records(dbf.load(path, k, min(7, n - k)))] == whole
    spark.dataSource.register(dbf.DbfSource)
    got = spark.read.format("dbf").option("file_column", "_file").load(str(tmp_path))
    assert got.count() == n and {r._file for r in got.collect()} == {"STSP2101.dbf"}


def test_explode():
    assert dbf.explode(bytes.fromhex("00048224258f807f")) == b"AIAIAIAIAIAIA"
    with pytest.raises(ValueError):
        dbf.explode(b"\x07\x04")
    with pytest.raises(EOFError):
        dbf.explode(bytes.fromhex("00048224"))


def test_compressed_table():
    def literal(data: bytes) -> bytes:
        bits = "".join("0" + f"{b:08b}"[::-1] for b in data) + "1" + "0000000" + "1" * 8  # longest length code and all extra bits: the end
        return bytes([0, 4]) + bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))

    plain = dbf.write_dbf(ROWS, FIELDS)
    head = dbf.parse_header(plain)[1]
    packed = plain[:head] + b"\0\0\0\0" + literal(plain[head:])
    assert list(dbf.records(dbf.decompress_dbc(packed))) == list(dbf.records(plain))


def test_caches(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"centroids": {"3550308": {"lat": "-23.5", "lon": -46.6}, "1": {"lat": "x", "lon": 1}}}))
    assert [tuple(r) for r in readers.read_centres(spark, f"{tmp_path}/c.json").collect()] == [("3550308", -23.5, -46.6)]
    (tmp_path / "f.json").write_text(json.dumps({"facilities": {"77": {"name": "H", "municipality_code": "3550308", "latitude": "1.5", "longitude": None}, "": {"name": "x"}}}))
    cached = readers.read_facilities(spark, f"{tmp_path}/f.json")
    assert [tuple(r) for r in cached.collect()] == [("0000077", "H", "355030", 1.5, None)]
    asked = []

    def fetch(k):
        asked.append(k)
        return {"cnes": k, "name": "new"} if k != "0000079" else None

    want = spark.createDataFrame([("0000077",), ("0000078",), ("0000079",), ("0000078",), (None,)], "cnes string")
    assert sorted(r.cnes for r in readers.refresh_cache(want, cached, "cnes", fetch).collect()) == ["0000077", "0000078"] and asked == ["0000078", "0000079"]
    (tmp_path / "m.json").write_text(json.dumps([{"id": 3550308, "nome": "SP", "microrregiao": {"mesorregiao": {"UF": {"sigla": "SP"}}}}]))
    (tmp_path / "e.json").write_text("[]")
    assert readers.read_catalog(spark, f"{tmp_path}/e.json", lambda: f"{tmp_path}/m.json").count() == 1
    with pytest.raises(ValueError):
        readers.read_catalog(spark, f"{tmp_path}/e.json")
    answer = spark.createDataFrame([(77, " ", "Company", 3550308, "1.5", "x")], "codigo_cnes long, nome_fantasia string, nome_razao_social string, codigo_municipio long, latitude_estabelecimento_decimo_grau string, longitude_estabelecimento_decimo_grau string")
    assert tuple(readers.facility_record(answer).first()) == ("0000077", "Company", "355030", 1.5, None)


def test_geojson(spark, tmp_path):
    sq = lambda x: {"geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1]]]}}
    multi = {"geometry": {"type": "MultiPolygon", "coordinates": [[sq(4)["geometry"]["coordinates"][0]]]}}
    (tmp_path / "g.json").write_text(json.dumps({"features": [sq(0), multi, {"geometry": None}]}))
    r = readers.read_geojson_centres(spark, f"{tmp_path}/g.json").first()
    assert (r.lon, r.lat) == (2.5, 0.5)


def test_lake(spark, tmp_path):
    rec = spark.createDataFrame([("355030", "1", "31", 2021, 1, "SP"), ("355030", "1", "11", 2021, 2, "SP"), ("330455", "2", None, 2021, 2, "RJ")], "MUNIC_RES string, CNES string, COBRANCA string, year int, month int, uf string")
    pipelines.project_lake(rec, f"{tmp_path}/lake")
    assert readers.read_months(spark, f"{tmp_path}/lake", 2021, [2], ["RJ"]).first().CNES == "2"
    plan = readers.read_months(spark, f"{tmp_path}/lake", 2021, [2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan
    files = readers.list_raw(spark, f"{tmp_path}/lake", "parquet")
    assert {(r.month, r.uf) for r in files.collect()} == {(1, "SP"), (2, "SP"), (2, "RJ")}
    assert readers.read_projected(spark, f"{tmp_path}/lake/year=2021/month=1/uf=SP").first().CODMUNRES == "355030"


@pytest.mark.parametrize("suffix", ["gexf", "graphml"])
def test_graph_files(spark, tmp_path, suffix):
    v = spark.createDataFrame([("facility:1", 'A & "B"', None), ("facility:2", None, 1.5)], "node_id string, name string, latitude double")
    e = spark.createDataFrame([("facility:1", "facility:2", 3.0, None)], "source_node_id string, target_node_id string, transfer_count double, edge_type string")
    sinks.write_graph(v, e, f"{tmp_path}/g.{suffix}")
    gv, ge = readers.read_graph(spark, f"{tmp_path}/g.{suffix}")
    assert {r.node_id for r in gv.collect()} == {"facility:1", "facility:2"}
    assert (ge.first().source_node_id, ge.first().target_node_id) == ("facility:1", "facility:2")
    # attributes come back, so a stored graph can be measured
    assert {r.node_id: r.name for r in gv.collect()} == {"facility:1": 'A & "B"', "facility:2": None}
    assert ge.first().transfer_count == 3.0 and graph.summary(gv, ge).first().total_weight == 3.0
    assert "None" not in open(f"{tmp_path}/g.{suffix}").read()
    with pytest.raises(ValueError):
        sinks.write_graph(v, e, "g.txt")


def test_page_exports(spark, tmp_path):
    n = spark.createDataFrame([("facility:1", "facility", "</script>", None, -1.0, -2.0), ("municipality:2", "municipality", None, "2", None, 1.0)], "node_id string, node_type string, name string, municipality_code string, latitude double, longitude double")
    e = spark.createDataFrame([("facility:1", "municipality:2", "transfer", 3.0, None, None), ("facility:1", "facility:1", "transfer", 1.0, 1.0, "m")], "source_node_id string, target_node_id string, edge_type string, transfer_count double, confidence_score double, match_method string")
    meta = sinks.export_page(n, e, str(tmp_path), "t")
    lines = [json.loads(x) for x in open(f"{tmp_path}/{meta['nodes_jsonl']}")]
    assert {x["node_id"]: x["latitude"] for x in lines} == {"facility:1": -1.0, "municipality:2": None}
    s = sinks.write_map(n, e, f"{tmp_path}/m.html")
    assert (s["edges_considered"], s["edges_drawn"], s["edges_without_coordinates"], s["facility_markers"]) == (2, 1, 1, 1)
    assert "</script>\"" not in open(f"{tmp_path}/m.html").read()


def test_graph_page_and_plots(spark, tmp_path):
    n = spark.createDataFrame([(f"facility:{k}", "facility", "</script>" if k == 1 else None, None) for k in range(6)], "node_id string, node_type string, name string, municipality_code string")
    e = spark.createDataFrame([(f"facility:{k}", f"facility:{(k + 1) % 6}", "transfer", float(k), 1.0) for k in range(6)], "source_node_id string, target_node_id string, edge_type string, transfer_count double, confidence_score double")
    assert sinks.write_graph_page(n, e, f"{tmp_path}/g.html") == {"nodes_drawn": 6, "edges_drawn": 6, "max_nodes": 900, "max_edges": 1200, "edge_type": "all"}
    assert sinks.write_graph_page(n, e, f"{tmp_path}/g.html", 3, 1)["edges_drawn"] == 1
    assert open(f"{tmp_path}/g.html").read().count("</script>") == 1
    assert sinks.write_bars(graph.component_sizes(graph.weak_components(n, e)), "size", "n_components", f"{tmp_path}/p.svg", "Sizes") == 1
    assert "<rect" in open(f"{tmp_path}/p.svg").read()


def test_remote(spark, tmp_path):
    calls, naps = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return b'{"a": 1}'

    assert remote.fetch_json(lambda _: flaky(), "u", sleep=naps.append) == {"a": 1} and naps == [1.0, 2.0]

    def gone():
        raise remote.NotFound

    assert remote.with_retries(gone, allow_missing=True) is None
    with pytest.raises(remote.NotFound):
        remote.with_retries(gone)
    names = remote.listing(spark, [("RDSP2107.dbc", 5), ("PASP2107b.dbc", 5), ("RDRJ2101.dbc", 6)])
    assert sorted((r.uf, r.year, r.month) for r in names.collect()) == [("RJ", 2021, 1), ("SP", 2021, 7)]
    parts = remote.listing(spark, [("RDSP2107.dbc", 5), ("PASP2107b.dbc", 5), ("PASP2101a.dbc", 6), ("PASP2107a.dbc", 7)], manifest.outpatient("PASP"))
    assert [(r.uf, r.year, r.month, r.part) for r in manifest.in_order(parts).collect()] == [("SP", 2021, 1, "a"), ("SP", 2021, 7, "a"), ("SP", 2021, 7, "b")]
    assert [r.name for r in manifest.in_order(parts, 1).collect()] == ["PASP2101a.dbc"]
    body, cut = b"0123456789", [4]

    def retrieve(name, offset):
        part = body[offset:]
        if cut and name == "a":
            yield part[: cut.pop()]
            raise OSError
        yield part if name != "bad" else b"x"

    out = remote.download([("a", 10), ("bad", 10)], str(tmp_path), retrieve, retries=1, sleep=naps.append)
    assert out.downloaded == 1 and len(out.failures) == 1 and (tmp_path / "a").read_bytes() == body
    assert remote.download([("a", 10)], str(tmp_path), retrieve).skipped == 1


def records(spark):
    rows = [("p", "1", "31", "19800101", "F", "41", "I500", "355030", "2021-01-01", "2021-01-02", 2021, 1, "SP"), ("p", "2", "12", "19800101", "F", "41", "I509", "355030", "2021-01-03", "2021-01-05", 2021, 1, "SP"), ("q", "3", "12", None, "M", "5", "J18", "330455", "2021-02-03", None, 2021, 2, "RJ")]
    return spark.createDataFrame(rows, "N_AIH string, CNES string, COBRANCA string, NASC string, SEXO string, IDADE string, DIAG_PRINC string, MUNIC_RES string, DT_INTER string, DT_SAIDA string, year int, month int, uf string")


def test_year(spark, tmp_path):
    pipelines.project_lake(records(spark), f"{tmp_path}/lake")
    v, e, rej = pipelines.run_year(spark, f"{tmp_path}/lake", 2021, ["31", "32"])
    assert {(r.source_node_id, r.target_node_id, r.edge_type) for r in e.collect()} == {("facility:1", "facility:2", "transfer"), ("municipality:355030", "facility:1", "residence"), ("municipality:355030", "facility:2", "residence"), ("municipality:330455", "facility:3", "residence")}
    assert v.count() == 5 and rej.count() == 0
    assert pipelines.run_year(spark, f"{tmp_path}/lake", 2021, ["31"], states=["RJ"])[1].count() == 1
    with pytest.raises(FileNotFoundError):
        pipelines.run_year(spark, f"{tmp_path}/lake", 2020, ["31"])


def test_year_keeps_its_months(spark, tmp_path):
    """Confidence is the mean of the monthly rows, texts are those of the first month."""
    rows = [(f"p{m}{k}", str(k % 2 + 1), "31" if k < 2 else "12", "19800101", "F", str(41 + k % 2), "I500", f"35503{m}", f"2021-0{m}-0{1 + 2 * (k // 2)}", f"2021-0{m}-0{2 + 2 * (k // 2)}", 2021, m, "SP") for m in (1, 2) for k in range(4)]
    pipelines.project_lake(spark.createDataFrame(rows, records(spark).schema), f"{tmp_path}/lake")
    v, e, _ = pipelines.run_year(spark, f"{tmp_path}/lake", 2021, ["31"])
    flows = e.where("edge_type = 'transfer'").collect()
    assert {(r.source_node_id, r.target_node_id, r.transfer_count) for r in flows} == {("facility:1", "facility:1", 2.0), ("facility:2", "facility:2", 2.0)}
    monthly = spark.createDataFrame([("f:1", "f:2", "transfer", 3.0, 1.0, "m1", "202101"), ("f:1", "f:2", "transfer", 1.0, 0.5, "m2", "202102")], "source_node_id string, target_node_id string, edge_type string, transfer_count double, confidence_score double, match_method string, period string")
    from caudal.operators import edges

    assert tuple(edges.roll_up(monthly).first()) == ("f:1", "f:2", "transfer", 4.0, 0.75, "m1")


def test_stored_months(spark, tmp_path):
    pipelines.project_lake(records(spark), f"{tmp_path}/lake")
    options = pipelines.YearOptions(months=[1, 2], min_names=0.0)
    args = (spark, f"{tmp_path}/lake", f"{tmp_path}/out", ["31"])
    assert pipelines.write_year(spark, f"{tmp_path}/out", options) == 2
    assert pipelines.run_months(*args, options) == 0
    first = f"{tmp_path}/out/sih_br_202101"
    names = set(os.listdir(first))
    assert {f"{n}_sih_br_202101.csv" for n in ("nodes", "transfer_edges", "residence_edges", "facility_lookup", "municipality_lookup")} <= names
    before = os.path.getmtime(f"{first}/summary_sih_br_202101.json")
    assert pipelines.run_months(*args, options) == 0 and os.path.getmtime(f"{first}/summary_sih_br_202101.json") == before
    assert pipelines.write_year(spark, f"{tmp_path}/out", options) == 0
    edges = readers.read_csv(spark, f"{tmp_path}/out/sih_br_2021_edges.csv")
    assert {r.edge_type for r in edges.collect()} == {"transfer", "residence"} and {r.rule_version for r in edges.where("edge_type = 'residence'").collect()} == {"residence_v1_2026_04_26"}
    assert os.path.isfile(f"{tmp_path}/out/ui/sih_br_2021_nodes.jsonl")
    # a contract that fails ends the run
    strict = pipelines.YearOptions(months=[1, 2], max_missing=-1.0, force=True)
    assert pipelines.run_months(*args, strict) == 2


def test_batch(spark, tmp_path):
    _, _, flows = pipelines.movements(records(spark), ["31"])
    cat = spark.createDataFrame([(3550308, "Sao Paulo", ((("SP",),),)), (3304557, "Rio", ((("RJ",),),))], readers.CATALOG)
    ref = spark.createDataFrame([("9", "Hospital", "355030", 1.0, 2.0, "1"), ("", "none", "1", None, None, "1"), ("8", "Private", "355030", None, None, "0")], "cnes string, name string, municipality_code string, latitude double, longitude double, is_public_hospital string")
    b = pipelines.run_batch(records(spark), flows, pipelines.BatchOptions(states=["SP"], scope="public_hospitals"), cat, reference=ref)
    assert b.exit_code == 0 and b.summary["records"] == 2 and b.summary["nodes"] == {"facility": 3, "municipality": 1} and b.coverage["edges_total"] == 1
    assert b.edges.first().source_uf == "SP"
    pipelines.write_batch(b, str(tmp_path), parquet=True)
    assert readers.read_csv(spark, f"{tmp_path}/nodes_batch_202101_ufs-sp.csv").count() == 4
    fails = pipelines.run_batch(records(spark), flows, pipelines.BatchOptions(diagnoses=["J"]))
    assert fails.exit_code == 2 and not fails.contract["passed"]
    with pytest.raises(ValueError):
        pipelines.run_batch(records(spark), flows, pipelines.BatchOptions(states=["SP"]))


def test_streams(spark, tmp_path):
    schema = "subject string, left timestamp, entered timestamp, sex string, age long, chapter string, facility string"
    rows = [("p", "2021-01-02 06:00:00", "2021-01-01 00:00:00", "F", 5, "IX", "A"), ("p", None, "2021-01-03 08:00:00", "F", 5, "IX", "B"), ("p", None, "2021-01-03 09:00:00", "F", 5, "IX", "C"), ("p", None, "2021-01-09 08:00:00", "F", 5, "IX", "D")]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("left", "entered")})
    df.write.parquet(f"{tmp_path}/in")
    s = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.movements_stream(s().where("left IS NOT NULL"), s()).writeStream.format("memory").queryName("moves").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.target_location_id, r.delta_hours) for r in live.nearest(spark.table("moves")).collect()] == [("B", 26.0)] and spark.table("moves").count() == 2
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "load_id long, c string")
    rows.write.parquet(f"{tmp_path}/rows")
    q = live.profile_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows"), f"{tmp_path}/store", ["c"]).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.load_id, r.value or "", r.n) for r in live.read_store(spark, f"{tmp_path}/store").collect()) == [(1, "a", 2), (2, "", 1)]


def test_no_key_and_no_code_is_left_out(spark):
    cached = spark.createDataFrame([("02", "b")], "cnes string, name string")
    asked = []
    fetch = lambda k: asked.append(k) or (None if k == "01" else {"cnes": k, "name": "x"})
    got = readers.refresh_cache(spark.createDataFrame([(f"{k:02d}",) for k in range(1, 6)], "cnes string"), cached, "cnes", fetch, limit=2)
    assert sorted(r.cnes for r in got.collect()) == ["02", "03", "04", "05"] and asked == ["01", "03", "04", "05"]
    book = spark.createDataFrame([(str(k), "1", "1") for k in range(3)], "code string, is_transfer string, validated string")
    assert readers.transfer_codes(book, 3) == ["0", "1", "2"]
    with pytest.raises(ValueError):
        readers.transfer_codes(book, 2)
