"""Operators p2 to p5: brute force on small inputs, odd inputs, and agreement with their SQL."""

import json
import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from caudal.operators import drift, orphans, profile, skew

T0 = datetime(2021, 1, 1)


def refs_df(spark, rows):
    return spark.createDataFrame(rows, orphans.REFS)


def test_orphans_against_brute_force(spark):
    rnd = random.Random(1)
    parents = []
    for k in range(12):
        for _ in range(rnd.randint(0, 3)):
            born = T0 + timedelta(days=rnd.randint(0, 150))
            parents.append((f"k{k}", born, rnd.choice([None, born + timedelta(days=rnd.randint(-5, 60))])))
    refs = [("t", i, "c", rnd.choice(["a", "b", None]), f"k{rnd.randint(0, 14)}", T0 + timedelta(days=rnd.randint(0, 150))) for i in range(300)]
    found, snapshots, state = orphans.track_orphans(refs_df(spark, refs), spark.createDataFrame(parents, "id string, born timestamp, gone timestamp"), "id", "born", "gone")
    alive = lambda k, t: any(p == k and b <= t and (g is None or g > t) for p, b, g in parents)
    assert sorted(r.row_key for r in found.collect()) == sorted(i for _, i, _, _, k, t in refs if not alive(k, t))
    end = datetime(2021, 6, 1)
    waiting = sum(r.n_refs for r in state.collect() if r.waiting)
    assert waiting == sum(not any(p == k and b < end and (g is None or g >= end) for p, b, g in parents) for _, _, _, _, k, _ in refs)
    per = defaultdict(list)
    for r in snapshots.collect():
        per[r.table_name, r.period].append(r)
    for rows in per.values():
        before = 0
        for r in sorted(rows, key=lambda r: r.epoch):
            assert r.n_waiting == before + r.n_opened + r.n_reopened - r.n_resolved
            before = r.n_waiting


def test_orphans_delivery_by_delivery(spark, monkeypatch):
    """Many small deliveries end as one large delivery does, layers added up in between."""
    monkeypatch.setattr(orphans, "MOST_LAYERS", 2)
    rnd = random.Random(3)
    day = lambda n: T0 + timedelta(days=rnd.randint(0, n))
    parents = [(f"k{rnd.randint(0, 9)}", b := day(150), rnd.choice([None, b + timedelta(days=rnd.randint(1, 60))])) for _ in range(20)]
    refs = refs_df(spark, [("t", i, "c", rnd.choice(["a", "b", None]), f"k{rnd.randint(0, 12)}", day(150)) for i in range(200)] + [("t", 900, "c", "a", "k1", None)])
    lives = spark.createDataFrame(parents, "id string, born timestamp, gone timestamp")
    whole = orphans.track_orphans(refs, lives, "id", "born", "gone")
    tracker, events = orphans.OrphanTracker(spark), orphans.parent_events(lives, "id", "born", "gone")
    found, snapshots, since = [], [], "0001-01-01"
    for _, end in orphans.months("202101", "202105"):
        part = refs.where(f"seen_at >= '{since}' AND seen_at < '{end}'" + (" OR seen_at IS NULL" if since == "0001-01-01" else ""))
        f, s = tracker.advance(part, events.where(f"at >= '{since}' AND at < '{end}'"), [end])
        found += f.collect()
        snapshots += s.collect()
        since = end
    key = lambda rows: sorted(map(str, rows))
    assert key(found) == key(whole[0].collect()) and 900 in {r.row_key for r in found}
    assert key(snapshots) == key(whole[1].collect())
    assert key(tracker.state().collect()) == key(whole[2].collect())
    assert sum(r.n_waiting for r in whole[1].where("epoch = '2021-06-01'").collect()) == sum(r.n_refs for r in whole[2].collect() if r.waiting)


def test_orphans_odd_inputs(spark):
    none = spark.createDataFrame([], "id string, born timestamp, gone timestamp")
    found, snapshots, state = orphans.track_orphans(refs_df(spark, []), none, "id", "born", "gone")
    assert found.count() == snapshots.count() == state.count() == 0
    odd = [("t", 1, "c", None, None, T0), ("t", 2, "c", "p", "", T0), ("t", 3, "c", "p", "k", None), ("t", 4, "c", "p", "k", T0), ("t", 4, "c", "p", "k", T0)]
    found, snapshots, state = orphans.track_orphans(refs_df(spark, odd), none, "id", "born", "gone")
    assert Counter(r.row_key for r in found.collect()) == {2: 1, 3: 1, 4: 2}
    found, snapshots, state = orphans.track_orphans(refs_df(spark, odd[2:3]), none, "id", "born", "gone")
    assert found.count() == 1 and snapshots.first().n_waiting == 1 and state.first().waiting


def test_profile_and_signed_deltas(spark):
    rows = [(1, "350000", "x"), (1, " 350000 ", "x"), (1, None, "y"), (1, "  ", "z"), (1, "99", None), (2, "3500001", "x")]
    df = spark.createDataFrame(rows, "load_id long, munic_res string, n string")
    store = profile.apply_deltas(None, profile.value_deltas(df, ["munic_res", "n"]))
    p = {(r.load_id, r.column_name): r for r in profile.load_profile(store).collect()}
    m = p[1, "munic_res"]
    assert (m.n_rows, m.n_blank, m.n_distinct, m.n_bad, m.n_well, m.n_top, m.min_value, m.max_value) == (5, 2, 2, 1, 2, 2, "350000", "99")
    assert m.entropy == pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)), abs=1e-6)
    assert p[2, "munic_res"].n_alt == 1 and p[1, "n"].n_bad is None
    taken = profile.apply_deltas(store, profile.value_deltas(df.where("load_id = 1"), ["munic_res", "n"], sign=-1))
    assert {r.load_id for r in taken.collect()} == {2}
    assert profile.load_profile(profile.value_deltas(df.limit(0), ["n"])).count() == 0


def test_the_store_adds_deliveries_up(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "load_id long, k string")
    store = profile.ValueStore(spark, str(tmp_path))
    assert store.counts().count() == 0
    first, second = df([(1, "a"), (1, "a"), (1, None)]), df([(2, "a"), (1, "b")])
    for _ in range(2):  # a delivery that comes again counts once
        store.apply(profile.value_deltas(first, ["k"]), "d1")
    store.apply(profile.value_deltas(second, ["k"]), "d2")
    store.apply(profile.value_deltas(df([(1, "a"), (1, "b")]), ["k"], sign=-1), "d3")
    want = {(1, "a", 1), (1, None, 1), (2, "a", 1)}
    assert {(r.load_id, r.value, r.n) for r in store.counts().collect()} == want
    store.compact()
    assert store.deliveries == ["d3-all"] and {(r.load_id, r.value, r.n) for r in store.counts().collect()} == want


def test_profile_changes(spark):
    first = [(1, "350000")] * 8 + [(1, "360000")] * 2
    second = [(2, "4100000")] * 6 + [(2, None)] * 4
    store = profile.value_deltas(spark.createDataFrame(first + second + [(4, None)], "load_id long, munic_res string"), ["munic_res"])
    got = {(r.load_id, r.finding) for r in profile.load_changes(store).collect()}
    assert got == {(2, "null_change"), (2, "top_change"), (2, "form_change"), (2, "region_change")}


def test_profile_of_all_columns(spark):
    rows = [(1, "-1", "9,50", "20210507101500", "x"), (1, "9", "10.00", "2021-05-06 10:15:00", "x"), (1, "10", "1e3", "2021-02-22T08:15", None), (1, None, "100", "20210231000000", "y")]
    df = spark.createDataFrame(rows, "load_id long, idade string, val_tot string, dt_saida string, feed string")
    p = {r.column_name: r for r in profile.full_profile(profile.value_deltas(df, ["idade", "val_tot", "dt_saida", "feed"])).collect()}
    assert [(p[c].n_bad, p[c].n_well, p[c].n_alt, p[c].low, p[c].high) for c in ("idade", "val_tot", "dt_saida", "feed")] == [
        (1, 2, 0, "9", "10"), (1, 3, 1, "9.50", "100.00"), (2, 2, 1, "2021-05-06 10:15:00", "2021-05-07 10:15:00"), (None, None, None, "x", "y"),
    ]


def test_profile_and_changes_of_every_column(spark, folder):
    from caudal.plans import core_problems

    stays = spark.read.parquet(f"{folder}/stays.parquet")
    got = core_problems.p3_profile_all(spark, folder).collect()
    assert {r.column_name for r in got} == set(stays.columns) - {"load_id"} and {r.column_name for r in got if r.n_bad is None} == {"feed"}
    ages = [r.idade.strip() for r in stays.collect() if r.idade and r.idade.strip()]
    assert sum(r.n_bad for r in got if r.column_name == "idade") == sum(not (a.isdigit() and int(a) <= 130) for a in ages)
    values = defaultdict(Counter)
    for r in stays.collect():
        for c in stays.columns:
            values[r.load_id, c][None if r[c] is None or not str(r[c]).strip() else str(r[c]).strip()] += 1
    want = set()
    for (load, c), now in values.items():
        if c != "load_id" and (before := values.get((load - 1, c))):
            nulls, tops = ([x[None] / x.total() for x in (now, before)], [[n for v, n in x.items() if v is not None] for x in (now, before)])
            if abs(nulls[0] - nulls[1]) >= 0.10 - 1e-9:
                want.add((load, c, "null_change"))
            if all(tops) and abs(max(tops[0]) / sum(tops[0]) - max(tops[1]) / sum(tops[1])) >= 0.15 - 1e-9:
                want.add((load, c, "top_change"))
    found = [tuple(r) for r in core_problems.p3_changes_all(spark, folder).collect()]
    assert {x for x in found if x[2] in ("null_change", "top_change")} == want and {c for _, c, _ in want} - set(profile.RULES)
    named = {(r.load_id, r.column_name, r.finding) for r in core_problems.p3_found(spark, folder).collect() if r.finding != "bad_value"}
    assert {x for x in found if x[1] in profile.RULES} == named


def raw_df(spark, files, stream=1):
    rows = []
    for fid, lines in files.items():
        for n, line in enumerate(lines):
            rows.append((len(rows), fid, stream, n, line if isinstance(line, str) or line is None else json.dumps(line)))
    return spark.createDataFrame(rows, "raw_id long, file_id long, stream_id long, line_no int, payload string")


def changes(spark, files):
    return {(r.file_id, r.change_kind, r.field_name, r.prior_name) for r in drift.schema_changes(raw_df(spark, files)).collect()}


def test_drift_kinds(spark):
    day = lambda i: f"202101{10 + i:02d}"
    a = [{"DAY": day(i), "AGE": f"{i * 7 % 90:03d}", "KEY": f"{10**12 + i * 7919}", "OUT": "1"} for i in range(12)]
    b = [{"D_DAY": day(i), "AGE": i * 7 % 90, "KEY": f"{10**12 + i * 7919}"} for i in range(12)]
    c = [{"D_DAY": f"2021-01-{10 + i}", "AGE": i * 7 % 90, "KEY": f"{10**12 + i * 7919}", "OUT": "2", "d_day": None} for i in range(12)]
    got = changes(spark, {101: a, 102: b, 103: c, 105: a})
    assert got == {
        (102, "renamed", "D_DAY", "DAY"), (102, "removed", "OUT", ""), (102, "retyped", "AGE", ""),
        (103, "retyped", "D_DAY", ""), (103, "added", "OUT", ""), (103, "added", "d_day", ""),
    }


def test_drift_odd_inputs(spark):
    assert changes(spark, {}) == set()
    assert changes(spark, {1: [None, "", "[1]", "not json", {}], 2: [{"A": "x"}, {"A": None}, {"A": "x"}]}) == set()
    assert changes(spark, {1: [{"A": None}], 2: [{"A": "5"}, {"A": "5"}]}) == set()


def columns_of(placed):
    return {(r.stream_id, r.file_id, r.field): r.column for r in placed.collect()}


def test_drift_unified(spark):
    a = [{"DT": f"202101{10 + i}", "V": 1.5 + i, "N": f"{i:03d}"} for i in range(10)]
    b = [{"DATE": f"1{i}/01/2021", "V": f"{1 + i},25", "N": i} for i in range(10)]
    broken = [None, " ", "no json", '{"V": 1.5, "V": 2.5}', "[1]"]
    raw = raw_df(spark, {1: a, 2: b + broken})
    ch = drift.schema_changes(raw)
    out, placed = drift.unified(raw, ch, ["raw_id", "stream_id", "file_id"])
    names = columns_of(placed)
    assert names[1, 1, "DT"] == names[1, 2, "DATE"] and out.count() == 25
    kinds = dict(out.dtypes)
    assert kinds[names[1, 1, "DT"]] == "date" and kinds["V"] == "double"
    last = out.where("raw_id = 19").first()
    assert str(last[names[1, 1, "DT"]]) == "2021-01-19" and last.V == 10.25 and last.N == "009" and last.schema_version == 2
    # nothing that can't be read is lost
    assert [r.unread for r in out.where("raw_id >= 20").orderBy("raw_id").collect()] == [[], [], ["no json"], ['{"V": 1.5, "V": 2.5}'], ["[1]"]]


def test_streams_keep_their_own_names(spark):
    day = lambda i: f"202101{10 + i:02d}"
    one = raw_df(spark, {1: [{"A": day(i)} for i in range(9)], 2: [{"B": day(i)} for i in range(9)]})
    two = raw_df(spark, {1: [{"B": f"remark {'abcdefghi'[i] * 3}"} for i in range(9)]}, stream=2)
    raw = one.unionByName(two)
    out, placed = drift.unified(raw, drift.schema_changes(raw), ["raw_id", "stream_id", "file_id"])
    names = columns_of(placed)
    assert names[1, 1, "A"] == names[1, 2, "B"] != names[2, 1, "B"]
    assert all(r[names[2, 1, "B"]].startswith("remark") and not r.unread for r in out.where("stream_id = 2").collect())
    assert all(r[names[1, 1, "A"]] for r in out.where("stream_id = 1").collect())


def test_a_name_that_comes_back_for_something_else_is_another_field(spark):
    day = lambda i: f"202101{10 + i:02d}"
    files = {
        1: [{"X": day(i)} for i in range(9)], 2: [{"Y": day(i)} for i in range(9)],
        3: [{"Y": day(i), "X": f"2019-12-{10 + i}"} for i in range(9)], 4: [{"Y": f"{i}", "X": f"2019-12-{10 + i}"} for i in range(9)],
    }
    raw = raw_df(spark, files)
    out, placed = drift.unified(raw, drift.schema_changes(raw), ["raw_id", "stream_id", "file_id"])
    names = columns_of(placed)
    assert names[1, 1, "X"] == names[1, 2, "Y"] == names[1, 3, "Y"] != names[1, 3, "X"]
    both = out.where("file_id = 3").first()
    assert str(both[names[1, 3, "X"]]).startswith("2019") and str(both[names[1, 3, "Y"]]).startswith("2021")
    # what doesn't fit the kind of its column isn't lost
    assert sorted(x for r in out.where("file_id = 4").collect() for x in r.unread) == [f"Y={i}" for i in range(9)]


def test_skew_against_plain(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice([None, *"abcdef"]), f"m{rnd.randint(0, 20)}", rnd.choice([None, -1, 1, 2, 5])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, m string, v long")
    heavy = skew.heavy_keys(df, "k", 0.1)
    assert "hot" in heavy and None not in heavy
    want = defaultdict(lambda: [0, None])
    for k, _, v in rows:
        want[k][0] += 1
        want[k][1] = want[k][1] if v is None else (want[k][1] or 0) + v
    assert {r.k: [r.n_rows, r.total] for r in skew.salted_totals(df, "k", "v", heavy).collect()} == dict(want)
    top = skew.salted_top(df, "k", "m", "v", 2, heavy).collect()
    per = defaultdict(lambda: [0, 0])
    for k, m, v in rows:
        per[k, m][0] += v or 0
        per[k, m][1] += 1
    for r in top:
        ranked = sorted((-s, -n, m) for (k, m), (s, n) in per.items() if k == r.k)
        assert ranked[r["rank"] - 1] == (-r.strength, -r.n_rows, r.m)
    assert skew.salted_totals(df.limit(0), "k", "v", []).count() == 0
