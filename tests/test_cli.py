import json

import pytest

from caudal.cli import main
from caudal.sources import sinks
from test_sources import records


@pytest.fixture
def files(spark, tmp_path):
    sinks.write_csv_file(records(spark).drop("year", "month", "uf"), f"{tmp_path}/in.csv")
    (tmp_path / "codes.csv").write_text("code,description,is_transfer,validated\n31,x,true,true\n11,y,false,true\n")
    return tmp_path


def test_from_records_to_graph(spark, files, capsys):
    run = lambda *a: main([*a], spark)
    assert run("gate", "--input", f"{files}/in.csv", "--codes", f"{files}/codes.csv", "--output", f"{files}/gate.json") == 0
    assert json.load(open(files / "gate.json"))["passed"] is True
    assert run("match", "--input", f"{files}/in.csv", "--codes", f"{files}/codes.csv", "--output", f"{files}/out") == 0
    assert len(open(files / "out/transfer_edges.csv").readlines()) == 2
    assert run("nodes", "--input", f"{files}/in.csv", "--output", f"{files}/out") == 0
    assert run("batch", "--input", f"{files}/in.csv", "--edges", f"{files}/out/transfer_edges.csv", "--output", f"{files}/b") == 0
    nodes, edges = f"{files}/b/nodes_batch_202101.csv", f"{files}/b/transfer_edges_batch_202101.csv"
    assert run("validate", "--nodes", nodes, "--edges", edges) == 0
    capsys.readouterr()
    assert run("metrics", "--nodes", nodes, "--edges", edges) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["n_edges"] == 1 and report["weak_components"] == {"1": 3, "2": 1}
    assert run("map", "--nodes", nodes, "--edges", edges, "--output", f"{files}/m.html") == 0
    assert run("project", "--input", f"{files}/in.csv", "--output", f"{files}/p.parquet") == 0


def test_failures(spark, files):
    sinks.write_csv_file(spark.createDataFrame([("1",)], "PA_CMP string"), f"{files}/bad.csv")
    assert main(["gate", "--input", f"{files}/bad.csv"], spark) == 2
    assert main(["match", "--input", f"{files}/bad.csv", "--output", f"{files}/o"], spark) == 2
    assert main(["batch", "--input", f"{files}/in.csv", "--edges", f"{files}/in.csv", "--output", f"{files}/o", "--ufs", "XX"], spark) == 2
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_reference(spark, files):
    sinks.write_csv_file(spark.createDataFrame([("77", "355030", "1", "1", "0", "1"), ("78", "355030", "0", "1", "0", "1"), ("77", "355031", "1", "1", "0", "1")], "CNES string, CODUFMUN string, VINC_SUS string, ATENDHOS string, LEITHOSP string, NIV_DEP string"), f"{files}/st.csv")
    (files / "m.json").write_text(json.dumps([{"id": 3550308, "nome": "SP", "microrregiao": {"mesorregiao": {"UF": {"sigla": "SP"}}}}]))
    (files / "c.json").write_text(json.dumps({"centroids": {"3550308": {"lat": -23.5, "lon": -46.6}}}))
    (files / "f.json").write_text(json.dumps({"facilities": {"0000077": {"name": "Hospital"}}}))
    args = ["reference", "--input", f"{files}/st.csv", "--output", f"{files}/r.csv", "--catalog", f"{files}/m.json", "--centres", f"{files}/c.json", "--cache", f"{files}/f.json"]
    assert main(args, spark) == 0
    lines = open(files / "r.csv", encoding="utf-8-sig").read().splitlines()
    assert len(lines) == 2 and "0000077" in lines[1] and "Hospital" in lines[1] and "-23.5" in lines[1]
