import pytest

from caudal.llm import mixture
from caudal.llm.mixture import Source, water_fill


def test_water_filling():
    assert water_fill([]) == {}
    exact = water_fill([Source("a", 100, 0.5, 1), Source("b", 10, 0.5, 3)])
    assert exact == {"a": pytest.approx(30), "b": pytest.approx(30)}
    got = water_fill([Source("a", 100, 0.5, 1), Source("b", 10, 0.25, 2), Source("c", 100, 0.25, 1)], 150)
    assert got["b"] == 20 and got["a"] + got["c"] == pytest.approx(130) and got["a"] == pytest.approx(2 * got["c"])
    chain = water_fill([Source("a", 10, 0.4, 1), Source("b", 40, 0.4, 1), Source("c", 1000, 0.2, 1)], 200)
    assert chain == {"a": 10, "b": 40, "c": pytest.approx(150)}
    assert water_fill([Source("a", 10, 0.5, 1), Source("b", 10, 0.5, 1)], 100) == {"a": 10, "b": 10}
    assert water_fill([Source("a", 0, 0.5, 1), Source("b", 10, 0.5, 2), Source("c", 5, 0.1, 0)]) == {"a": 0, "b": 20, "c": 0}


def test_mix(spark):
    docs = [(i, "big" if i < 600 else "small" if i < 640 else None if i < 650 else "other", 50 + i * 7 % 90) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 4), ("gone", 0.0, 2), (None, 0.1, 1)], "source_name string, target_share double, max_repeats int")
    selection, report = mixture.mix(df, targets)
    rows, rep = selection.collect(), {r.source: r for r in report.collect()}
    assert {r.source for r in rows} == {"big", "small"}
    for name, cap, share in (("big", 1, 0.7), ("small", 4, 0.3)):
        own = [r for r in rows if r.source == name]
        assert max(r.repeats for r in own) <= cap and len({r.doc_id for r in own}) == len(own)
        assert sum(r.n_tokens * r.repeats for r in own) == rep[name].used_tokens
        assert rep[name].reached_share == pytest.approx(share, abs=0.005)
    again, _ = mixture.mix(df.repartition(7), targets)
    assert sorted(again.collect()) == sorted(rows)
    other, _ = mixture.mix(df, targets, seed=5)
    assert sorted(other.collect()) != sorted(rows)
    capped, rep2 = mixture.mix(df, targets, total=1e9)
    assert {r.source: r.epochs for r in rep2.collect() if r.used_docs} == {"big": 1.0, "small": 4.0}
    assert mixture.mix(df.limit(0), targets)[0].count() == 0 and mixture.mix(df, targets.limit(0))[1].count() == 0


def test_redistribution_in_two_rounds(spark):
    """c is full at once; what it lacks fills b, too, and a takes the rest."""
    sources = [mixture.Source("a", 10_000, 0.4, 2), mixture.Source("b", 3_200, 0.3, 1), mixture.Source("c", 100, 0.3, 2)]
    assert mixture.water_fill(sources, 10_000) == {"a": 6600.0, "b": 3200.0, "c": 200.0}
    docs = spark.createDataFrame([(i, s, 10) for i, s in enumerate("a" * 1000 + "b" * 320 + "c" * 10)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(s.name, s.share, s.max_repeats) for s in sources], "source_name string, target_share double, max_repeats int")
    selection, report = mixture.mix(docs, targets, total=10_000)
    assert {r.source: (r.planned_tokens, r.used_tokens, r.most_repeats) for r in report.collect()} == {"a": (6600, 6600, 1), "b": (3200, 3200, 1), "c": (200, 200, 2)}
    assert selection.count() == 660 + 320 + 10


def test_many_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(3000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source_name string, target_share double, max_repeats int")
    monkeypatch.setattr(mixture, "BUCKETS", 2)
    monkeypatch.setattr(mixture, "PAGES_A_BUCKET", 10)
    assert mixture.mix(docs, targets, total=45_000)[1].first().used_tokens == 45_000


def test_tokens_are_exact_in_pieces(spark, monkeypatch):
    text = "A câmara  de Vila, 123 casas!\n\n  foo bar\tbaz  qux it's " * 400
    enc = mixture._encoder(mixture.TOKENIZER)
    monkeypatch.setattr(mixture, "PIECE", 100)
    assert len(mixture._pieces(text)) > 20 and "".join(mixture._pieces(text)) == text
    assert sum(len(enc.encode_ordinary(p)) for p in mixture._pieces(text)) == len(enc.encode_ordinary(text))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [r.n_tokens for r in mixture.count_tokens(df, ["doc_id"]).orderBy("doc_id").collect()] == [len(enc.encode_ordinary(text)), 0, 0]
