import random

import numpy as np
import pytest

from caudal.llm import content

FILLER = "the council of Vila opened a market and later old Bena sold ten crates of sugar near the harbour before winter".split()
SAID = {"abusive": "you are a stupid worthless fool and everyone knows it", "hateful": "those people are vermin and must be driven from our town", "sexual": "she undressed and they moaned in naked passion all night"}


def page(rnd, said=()):
    words = [rnd.choice(FILLER) for _ in range(rnd.randint(20, 120))]
    for s in said:
        at = rnd.randint(0, len(words))
        words[at:at] = s.split()
    return " ".join(words)


@pytest.fixture(scope="module")
def pages_():
    rnd = random.Random(5)
    rows = []
    for i in range(500):
        kinds = [c for c in content.CATEGORIES if rnd.random() < 0.08]
        rows.append((i, page(rnd, [SAID[c] for c in kinds]), "s", kinds))
    return rows


def frames(spark, rows, wrong=0.01):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, t, s, [], 1.0) for i, t, s, _ in rows], "doc_id long, text string, source string, line_boxes array<struct<x0:int>>, abusive double")
    marks = spark.createDataFrame([(i, *[int((c in k) != (rnd.random() < wrong)) for c in content.CATEGORIES]) for i, _, _, k in rows], "doc_id long, abusive int, hateful int, sexual int")
    return docs, marks


def test_held_out_accuracy(spark, pages_):
    docs, marks = frames(spark, pages_)
    chain = content.train(docs, marks.where("doc_id < 350"))
    got = {r.doc_id: r for r in content.score(docs, chain, ["doc_id", "source"]).where("doc_id >= 350").collect()}
    for c in content.CATEGORIES:
        said = {i for i, _, _, k in pages_ if i >= 350 and c in k}
        found = {i for i, r in got.items() if r[f"is_{c}"]}
        assert len(said & found) >= 0.9 * len(said) and len(found - said) <= 3


def test_few_marks(spark, pages_):
    """Unmarked pages help where marks are few; with next to none nothing is taken for a hit."""
    docs, marks = frames(spark, pages_, wrong=0.0)
    chain = content.train(docs, marks.where("doc_id < 150"))
    got = content.score(docs.where("doc_id >= 150"), chain, ["doc_id"]).collect()
    for c in content.CATEGORIES:
        said = {i for i, _, _, k in pages_ if c in k}
        found = {r.doc_id for r in got if r[f"is_{c}"]}
        assert len(found & said) >= 0.7 * len([i for i in said if i >= 150]) and len(found - said) <= 5
    rnd = random.Random(8)
    noise = spark.createDataFrame([(i, *[int(rnd.random() < 0.05) for _ in content.CATEGORIES]) for i in range(60)], marks.schema)
    got = content.score(docs, content.train(docs, noise), ["doc_id"]).collect()
    assert sum(r[f"is_{c}"] for r in got for c in content.CATEGORIES) <= 0.1 * len(got)


def test_best_threshold():
    rnd = np.random.default_rng(2)
    y = np.concatenate([np.ones(40), np.zeros(400)])
    good = np.where(y > 0, 0.8, 0.1) + rnd.uniform(-0.05, 0.05, 440)
    assert 0.15 < content.best_threshold(good, y) < 0.76
    assert content.best_threshold(rnd.uniform(0, 1, 440), y) > 0.9
    assert content.best_threshold(good, 0 * y) > 1


def test_odd_pages(spark, pages_):
    docs, marks = frames(spark, pages_[:120])
    marks = marks.unionByName(marks.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1, 1), (9999, 1, None, 0), (3, None, None, None)], marks.schema))
    chain = content.train(docs, marks)
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", []), (3, "x " * 200_000 + SAID["abusive"], "s", None)], "doc_id long, text string, source string, line_boxes array<struct<x0:int>>")
    got = {r.doc_id: r for r in content.score(odd, chain, ["doc_id"]).collect()}
    assert len(got) == 3 and got[3].abusive > got[2].abusive
    assert content.score(odd.limit(0), chain, ["doc_id"]).count() == 0


def test_no_marks(spark, pages_):
    docs, marks = frames(spark, pages_[:5])
    chain = content.train(docs, marks.limit(0))
    assert not any(r[f"is_{c}"] for r in content.score(docs, chain, ["doc_id"]).collect() for c in content.CATEGORIES)


def test_windows_against_brute_force():
    rnd = np.random.default_rng(7)
    pages_words = [["w%d" % k for k in rnd.integers(0, 9, n)] for n in (0, 1, 5, 40, 0, 14)]
    f = content.Features([[f"w{k}" for k in range(9)] * 3] * 3 + pages_words * 3)
    weight = rnd.normal(size=len(f.value))
    got = content.worst_windows(len(pages_words), f.flat(pages_words), weight)
    for p, g in zip(pages_words, got):
        best = None
        for a in range(len(p)):
            w = p[a : a + content.WINDOW]
            s = sum(weight[f.index[x]] for x in w if x in f.index) + sum(weight[f.index[x]] for x in (f"{u} {v}" for u, v in zip(w, w[1:])) if x in f.index)
            best = s if best is None else max(best, s)
        assert g == pytest.approx(best or 0.0)


def test_spelling():
    assert content.words("I d i o t s and idddiot vvorker", None) == content.words("idiots and idiot worker", None)
