import random
from datetime import datetime

from pyspark.sql import functions as F

from caudal.llm import linkage

N = "notice_id long, origin string, birth_day string, sex_code string, residence string, age_years int, postal_code string, cid string, aih_hint string, arrival_day string, sent_at timestamp, stay_id string"
S = "stay_id long, n_aih string, nasc string, sexo string, munic_res string, cep string, diag_princ string, dt_inter string, idade string, notice_id string, arrived_at timestamp"
T = datetime(2021, 5, 1)


def stay(i, aih, nasc="19700305", sex="1", place="355030", cep="01001000", cid="I500", entry="2021-04-10 08:00:00", age="51"):
    return (i, aih, nasc, sex, place, cep, cid, entry, age, "clash", T)


def notice(i, birth="05/03/1970", sex="masc", place="3550308", age=51, post="01001-000", cid="I50.0", hint=None, day="2021-04-10"):
    return (i, "lab", birth, sex, place, age, post, cid, hint, day, T, "clash")


def run(spark, notices, stays):
    out = linkage.link(spark.createDataFrame(notices, N), spark.createDataFrame(stays, S)).collect()
    assert all(0 <= r.confidence <= 1 for r in out)
    return sorted((r.notice_id, r.stay_id) for r in out)


FILLER = [stay(1000 + k, f"35219{k:08d}", f"19{50 + k % 40}{1 + k % 12:02d}{1 + k % 28:02d}", "13"[k % 2], f"35{1000 + k % 97:04d}", f"0{2000000 + k * 37}", f"{'ABCD'[k % 4]}{k % 90:02d}0", f"2021-0{1 + k % 9}-{1 + k % 27:02d} 10:00:00") for k in range(300)]


def test_links_lines_of_one_stay_and_nothing_alike(spark):
    stays = [stay(1, "3521000000017"), stay(2, " 3521000000017 ", cep=None), stay(3, "3521999999999", entry="2021-08-20 09:00:00", cid="K359"), *FILLER]
    notices = [
        notice(1), notice(2, birth="5 mar 1970", post=None, hint="********00017"), notice(3, birth=None, place=None, hint="3521.0000.00017"),
        notice(4, birth="19700503", sex=None), notice(5, sex="fem", day="2021-01-02", cid="S220"), notice(6, None, None, None, None, None, None, None, None), notice(1),
    ]
    got = run(spark, notices, stays)
    assert got == sorted((n, s) for n in (1, 2, 3, 4) for s in (1, 2))


def test_a_hot_block_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT_PAIRS", 4)
    monkeypatch.setattr(linkage, "HOT_SIDE", 1)
    stays = [stay(k, f"35210000{k:05d}", nasc="19010101", cep=f"010{k:05d}", cid=f"I{k % 90:02d}0") for k in range(1, 60)]
    notices = [notice(k, birth="01/01/1901", post=f"010{k:05d}", cid=f"I{k % 90:02d}0") for k in range(1, 60, 7)]
    assert run(spark, notices, stays) == [(k, k) for k in range(1, 60, 7)]


def crowd(n_notices, n_stays):
    """Rows that share place and arrival and nothing else but what sex and age share by chance."""
    stays = [stay(k, f"35210{k:08d}", nasc=f"19{40 + k % 50}{1 + k % 12:02d}{1 + k % 28:02d}", sex="13"[k % 2], cep=f"{10000000 + 7919 * k}", cid=f"{'IJKLMN'[k % 6]}{k % 97:02d}0", age=str(20 + k % 60)) for k in range(1, n_stays + 1)]
    notices = [notice(k, birth=f"{1 + k % 28:02d}/{1 + k % 12:02d}/{1900 + k % 30}", sex="mf"[k % 2], post=f"{90000000 + 7919 * k}", cid=f"{'ABCD'[k % 4]}{k % 97:02d}1", age=90 + k % 10) for k in range(1, n_notices + 1)]
    return notices, stays


def test_a_hot_block_gives_no_product(spark):
    notices, stays = crowd(100, 3000)
    n = linkage.shape_notices(spark.createDataFrame(notices, N)).cache()
    s = linkage.shape_stays(spark.createDataFrame(stays, S)).cache()
    assert linkage.candidates(n, s, 3000).count() < 0.1 * 100 * 3000


def test_a_crowd_hides_no_link(spark):
    notices, stays = crowd(60, 600)
    told = [stays[k][:1] + (f"35219{k:08d}",) + stays[k][2:] for k in range(0, 600, 40)]
    days = lambda x: f"{x[6:8]}/{x[4:6]}/{x[:4]}"
    notices += [notice(1000 + s[0], birth=days(s[2]), sex=s[3], age=int(s[8]), post=s[5], cid=None) for s in told]
    wanted = {(1000 + s[0], s[0]) for s in told}
    assert set(run(spark, notices, stays)) == wanted


def test_a_stay_that_nothing_speaks_against_is_found_in_a_hot_block(spark, monkeypatch):
    """It agrees with the notice in just what the whole crowd agrees in, but what it doesn't tell contradicts in the others."""
    monkeypatch.setattr(linkage, "HOT_PAIRS", 4)
    monkeypatch.setattr(linkage, "HOT_SIDE", 1)
    stays = [stay(k, f"35210000{k:05d}", nasc=f"19{30 + k}0101", cid="K359") for k in range(1, 7)]
    notices = [notice(k, birth=f"0{k}/12/1999", cid="S220") for k in range(1, 7)]
    told = notice(100, birth="20/07/1985", cid="I500")
    assert run(spark, [*notices[:5], told], [*stays, stay(50, "open", nasc=None, cid=None), stay(51, None, cid="Z380", nasc="19600606"), *FILLER]) == [(k, 50) for k in (1, 2, 3, 4, 5, 100)]


def test_every_line_of_a_hot_block_is_a_candidate(spark, monkeypatch):
    """Also of lines that differ in the last character of the diagnosis only."""
    monkeypatch.setattr(linkage, "HOT_PAIRS", 4)
    monkeypatch.setattr(linkage, "HOT_SIDE", 1)
    stays = [stay(k, "A" if k < 9 else "B", cid=f"I50{k}") for k in range(10)]
    n = linkage.shape_notices(spark.createDataFrame([notice(k, post=f"0100{k}000", cid="I50") for k in range(1, 4)], N)).cache()
    s = linkage.shape_stays(spark.createDataFrame([*stays, *FILLER], S)).cache()
    edges = linkage.candidates(n, s, 310)
    assert edges.count() == edges.select("notice_id", "line").distinct().count() == 3 * 10


def mixed(rnd):
    """The fields of a row from small pools, with gaps and slips."""
    some = lambda pool, gap=0.25: None if rnd.random() < gap else rnd.choice(pool)
    day = some([(5, 3, 70), (3, 5, 70), (6, 3, 70), (20, 11, 48), (2, 11, 84)])
    return {"day": day, "sex": some("13"), "place": some(["355030", "355031", "330455"]), "post": some(["01001000", "01001100", "20040020"]), "cid": some(["I500", "I509", "K359"]), "tail": some(["00017", "00071", "00400"], 0.5), "arrival": some(["2021-04-10", "2021-04-11", "2021-04-16"], 0.1), "age": some(["51", "52", "73"])}


def test_hot_blocks_give_the_same_links_as_others(spark, monkeypatch):
    rnd = random.Random(6)
    stays, notices = [], []
    for i in range(1, 121):
        f = mixed(rnd)
        nasc = f["day"] and f"19{f['day'][2]:02d}{f['day'][1]:02d}{f['day'][0]:02d}"
        stays.append(stay(i, f["tail"] and f"3521{i % 40:04d}{f['tail']}", nasc, f["sex"], f["place"], f["post"], f["cid"], f["arrival"] and f"{f['arrival']} 08:00:00", f["age"]))
    for i in range(1, 81):
        f = mixed(rnd)
        birth = f["day"] and f"{f['day'][0]:02d}/{f['day'][1]:02d}/19{f['day'][2]:02d}"
        notices.append(notice(i, birth, f["sex"], f["place"], f["age"] and int(f["age"]), f["post"], f["cid"], f["tail"] and f"********{f['tail']}", f["arrival"]))
    n, s = spark.createDataFrame(notices, N), spark.createDataFrame([*stays, *FILLER], S)
    shaped = linkage.shape_notices(n).cache(), linkage.shape_stays(s).cache()

    def result(pairs, side, tile):
        monkeypatch.setattr(linkage, "HOT_PAIRS", pairs)
        monkeypatch.setattr(linkage, "HOT_SIDE", side)
        monkeypatch.setattr(linkage, "TILE", tile)
        links = {(r.notice_id, r.stay_id, round(r.score, 6), r.confidence) for r in linkage.link(n, s).collect()}
        return links, {(r.notice_id, r.line): (round(r.bits, 6), round(r.rarest, 6)) for r in linkage.candidates(*shaped, 420).collect()}

    links, edges = result(10**9, 10**9, 4096)
    assert len(links) > 10
    for pairs, side, tile in ((4, 1, 7), (60, 4, 4096)):
        got, some = result(pairs, side, tile)
        assert got == links
        # only what does not exceed the floor is left out of the edges of hot blocks
        assert some.items() <= edges.items() and len(some) > len(edges) / 2


def test_notices_alike_support_each_other_and_each_get_a_row(spark):
    got = run(spark, [notice(k) for k in range(1, 6)], [stay(1, "3521000000017"), *FILLER])
    assert got == [(k, 1) for k in range(1, 6)]


def test_ties_and_empty_tables(spark):
    twins = [stay(1, "3521000000001"), stay(2, "3521000000002"), *FILLER]
    assert run(spark, [notice(1)], twins) == []
    assert run(spark, [], twins) == run(spark, [notice(1)], []) == []


def test_days(spark):
    rows = [("1990-01-02", "1990-01-02"), ("02/01/1990", "1990-01-02"), ("02.01.90", "1990-01-02"), ("02.01.15", "2015-01-02"), ("2 jan 1990", "1990-01-02"), ("19900102", "1990-01-02"), ("31/02/1990", None), ("", None), (None, None), ("x", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(linkage.any_day(F.col("a")).cast("string").alias("got"), "b").collect()
    assert all(r.got == r.b for r in got)
