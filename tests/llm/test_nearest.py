import random

from caudal.llm import nearest

LEFT, RIGHT = "left_id long, t long, k string, extra string", "right_id long, t long, k string, extra string"


def brute(left, right, tol):
    out = []
    for i, t, k, _ in left:
        best = min(((abs(t - u), j) for j, u, q, _ in right if None not in (t, k, u) and q == k and abs(t - u) <= tol), default=None)
        if best:
            out.append((i, best[1], best[0]))
    return sorted(out)


def run(spark, left, right, tol, rings=nearest.RINGS):
    got = nearest.nearest_within(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], tol, rings)
    return sorted((r.left_id, r.right_id, r.distance) for r in got.collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    moment = lambda: rnd.choice([None, *range(-300, 300)])
    key = lambda: "hot" if rnd.random() < 0.4 else rnd.choice([None, "a", "b", "c"])
    left = [(i, moment(), key(), "x") for i in range(120)]
    right = [(i, moment(), key(), "y") for i in range(150)]
    assert run(spark, left, right, 64) == brute(left, right, 64)
    assert run(spark, left, right, 7, 3) == brute(left, right, 7)


def test_ends_ties_and_copies(spark):
    right = [(5, 100, "a", ""), (4, 100, "a", ""), (9, 148, "a", ""), (3, 52, "a", "")]
    assert run(spark, [(1, 100, "a", ""), (1, 100, "a", ""), (2, 196, "a", ""), (3, 197, "a", ""), (4, 124, "a", ""), (5, 76, "a", "")], right, 48) == [
        (1, 4, 0), (1, 4, 0), (2, 9, 48), (4, 4, 24), (5, 3, 24),
    ]


def test_empty_sides(spark):
    row = [(1, 1, "a", "")]
    assert run(spark, [], row, 5) == run(spark, row, [], 5) == run(spark, [], [], 5) == []


def test_a_dense_entity_starts_with_finer_rings(spark, monkeypatch):
    rnd = random.Random(9)
    left = [(i, "a", rnd.randrange(2_000_000)) for i in range(300)]
    right = [(i, "a", rnd.randrange(2_000_000)) for i in range(3000)]
    monkeypatch.setattr(nearest, "MOST", 20)
    l, r = spark.createDataFrame(left, "left_id long, who string, t long"), spark.createDataFrame(right, "right_id long, who string, t long")
    points = r.dropDuplicates(["who", "t"])
    rings = nearest._rings(points, ["who"], 1_000_000, 6)
    assert rings > 6
    got = {x.left_id: (x.right_id, x.distance) for x in nearest.nearest_within(l, r, ["who"], 1_000_000).collect()}
    want = {i: min((abs(t - u), j) for j, _, u in right) for i, _, t in left}
    assert got == {i: (j, d) for i, (d, j) in want.items()}
