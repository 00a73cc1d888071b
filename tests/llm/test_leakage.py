import random

import numpy as np
import pytest

from caudal.llm import leakage, pages

WORDS = "castle river winter purple engine market soldier velvet garden bridge copper lantern meadow thunder orchard pepper saddle anchor basket candle hammer kettle mirror needle pillow ribbon shovel ticket wagon barrel".split()


def passage(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice(WORDS) + rnd.choice(["", "s", "ed"]) for _ in range(n)]


def lines(words, width=40):
    out, line = [], ""
    for w in words:
        if len(line) + len(w) > width:
            out.append(line.strip())
            line = ""
        line += w + " "
    return [*out, line.strip()]


@pytest.fixture(scope="module")
def item():
    return passage(1, 60)


def docs(spark, rows):
    schema = "doc_id long, text string, item_id string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int>>"
    return spark.createDataFrame([(i, t, "clash", b) for i, t, b in rows], schema)


def test_finds_what_is_printed(spark, item):
    other = lambda k: passage(100 + k, 80)
    noisy = " ".join(item[10:40]).replace("e", "c", 9).replace("n", "u", 5).replace("l", "1", 5).replace("rn", "m")
    left, right = lines(item[:30], 30), lines(other(3), 30)
    mixed = [x for pair in zip(left, right) for x in pair] + right[len(left) :]
    boxes = [(60, 0, 300, 9) if k % 2 == 0 and k < 2 * len(left) else (600, 0, 900, 9) for k in range(len(mixed))]
    gaps = [f"{a}    {b}" for a, b in zip(left, right)] + right[len(left) :]
    broken = "\n".join(lines(item[20:45])).replace("castle", "cas-\ntle").upper()
    advert = [*lines(item[:12]), "FINEST BOOTS ON SALE NOW, ONLY 12 CROWNS THE PAIR", *lines(item[12:24])]
    rows = [
        (1, " ".join(other(1) + item + other(2)), None), (2, noisy, None), (3, "\n".join(mixed), boxes), (4, "\n".join(gaps), None), (5, broken, None),
        (6, "\n".join(advert), None), (7, " ".join(other(4) + item[5:20] + other(5)), None), (8, " ".join(other(6) + item[5:17] + other(7)), None),
        (9, " ".join(item[5:13] + other(8) + item[30:38]), None), (10, None, None), (11, "", []), (12, " ".join(other(9)), [(None, None, None, None)]),
        (13, " ".join(other(10) * 400 + item + other(11) * 400), None), (1, " ".join(other(1) + item + other(2)), None),
    ]
    rows += [(100 + k, " ".join(other(100 + k)), None) for k in range(40)]
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(passage(2, 50))), (9, "too short"), (10, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(docs(spark, rows), items).collect())
    assert got == [(1, 7), (1, 7), (2, 7), (3, 7), (4, 7), (5, 7), (6, 7), (7, 7), (13, 7)]


def test_a_passage_on_a_third_of_all_pages_is_still_found(spark, item):
    rows = [(k, " ".join(passage(500 + k, 60) + (item[:40] if k % 3 == 0 else [])), None) for k in range(60)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in leakage.find_leaks(docs(spark, rows), items).collect()) == list(range(0, 60, 3))


def misread(words, k, rnd):
    """``k`` of the words each with one letter misread, as a scanner does."""
    out = list(words)
    for at in rnd.sample(range(len(out)), k):
        c = rnd.randrange(len(out[at]))
        out[at] = out[at][:c] + rnd.choice("xkzw") + out[at][c + 1 :]
    return out


def invented(rnd):
    return "".join(rnd.choice(["ba", "de", "li", "mo", "ri", "ta", "ne", "so", "pi", "ga", "ve", "cho", "lu", "fa", "ju", "te", "no", "sa", "vi", "que"]) for _ in range(rnd.choice([1, 2, 2, 3])))


def test_short_passages_with_misread_words_are_found(spark):
    rnd = random.Random(11)
    texts = {k: [invented(rnd) for _ in range(60)] for k in range(10)}
    rows, truth = [], set()
    for k in range(200):
        page = [invented(rnd) for _ in range(120)]
        if k < 100:
            item, at = k % 10, rnd.randrange(45)
            page[50:50] = misread(texts[item][at : at + 15], k % 5, rnd)
            truth.add((k, item))
        elif k < 150:  # too few words
            item, at = k % 10, rnd.randrange(49)
            page[50:50] = texts[item][at : at + 11]
        rows.append((k, "\n".join(lines(page)), None))
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs(spark, rows), items).collect()}
    assert got <= truth
    assert len(got) >= 0.95 * len(truth)


def test_worn_prints_on_a_third_of_all_pages_are_still_found(spark):
    rnd = random.Random(12)
    text = [invented(rnd) for _ in range(60)]
    rows = []
    for k in range(300):
        page = [invented(rnd) for _ in range(80)]
        if k % 3 == 0:
            page[40:40] = misread(text[10:40], 5, rnd)
        rows.append((k, "\n".join(lines(page)), None))
    items = spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")
    got = {r.doc_id for r in leakage.find_leaks(docs(spark, rows), items).collect()}
    assert got <= set(range(0, 300, 3)) and len(got) >= 98


def test_equal_items_other_scripts_and_empty_tables(spark):
    items = spark.createDataFrame([(k, " ".join(passage(k % 4, 40))) for k in range(6)], "item_id long, text string")
    rows = [(k, " ".join(passage(k, 40)), None) for k in range(4)] + [(9 + k, " ".join(passage(60 + k, 40)), None) for k in range(20)]
    assert sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(docs(spark, rows), items).collect()) == [(0, 0), (0, 4), (1, 1), (1, 5), (2, 2), (3, 3)]
    assert leakage.find_leaks(docs(spark, []), items).count() == 0
    assert leakage.find_leaks(docs(spark, rows), items.limit(0)).count() == 0
    rnd = random.Random(5)
    greek = ["".join(rnd.choice("αβγδεζηθικλμνξ") for _ in range(6)) for _ in range(40)]
    odd = [(1, " ".join(greek[5:30]) + " \U0001f600", None), (2, "€" * 500, None)] + rows
    one = spark.createDataFrame([(1, " ".join(greek))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.find_leaks(docs(spark, odd), one).collect()] == [(1, 1)]


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -6), h[i - 1, j] - 6, h[i, j - 1] - 6, h[i, :j].max() - 40)
    return h.max()


def test_alignment_against_plain_dynamic_programming():
    rnd = random.Random(4)
    for _ in range(20):
        a = "".join(rnd.choice("abc") for _ in range(60))
        b = a[:25] + "".join(rnd.choice("xyz") for _ in range(30)) + a[25:50] + "q" + a[50:]
        m = leakage.smith_waterman(leakage.codes(a), leakage.codes(b))
        at = m[m >= 0]
        assert (np.diff(at) > 0).all() and all(a[i] == b[j] for i, j in enumerate(m) if j >= 0)
        assert plain_score(a, b) == 2 * 25 + 2 * 25 - 40 + (20 - 6)
        assert len(at) == 60


def test_chained_anchors_against_the_whole_alignment():
    """On pages with a passage, worn and interrupted, chaining finds the words that aligning all with all finds."""
    rnd = random.Random(6)
    lost = more = 0
    for k in range(60):
        words = [invented(rnd) for _ in range(40)]
        page = [invented(rnd) for _ in range(60)]
        at, n = rnd.randrange(15), rnd.randrange(12, 25)
        printed = misread(words[at : at + n], k % 4, rnd)
        if k % 2:
            printed[n // 2 : n // 2] = [invented(rnd) for _ in range(9)]
        page[30:30] = printed
        stream, ends = leakage.item_words(" ".join(words))
        a, b, ends = leakage.codes(stream), leakage.codes(pages.fold(" ".join(page))), np.asarray(ends)
        whole = leakage.longest_run(leakage.smith_waterman(a, b), ends)
        chained = leakage.printed_words(a, leakage.windows(a, leakage.ANCHOR), ends, b, leakage.sorted_windows(b), 15)
        lost += chained < 15 <= whole
        more += whole < 15 <= chained
    # a word misread at the end of a passage is only reached from the anchors
    assert lost == 0 and more <= 3


def test_reading_order():
    assert pages.read_columns("", None) == [""]
    assert pages.read_columns("a\nb\nc\nd", [60, 700, 62, 705]) == ["a\nc", "b\nd"]
    assert pages.read_columns("a x   b y\nc   d\ne", [60, 60, 60]) == ["a x\nc\ne", "b y\nd"]
    assert pages.read_columns("a\nb", [60, None]) == ["a\nb"]
    assert pages.fold("Vellio, jardirn!") == pages.fold("velho jardim!".replace("h", "li"))
