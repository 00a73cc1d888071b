"""Matching notices to stays without a common key, as a collective graph linkage.

1. Candidate graph: records share an edge if they agree on a pair of partial attributes (blocks such as birth day and residence,
   tail of the admission number and arrival). An edge is worth the bits of the blocks it shares, rare ones more.
   A block with more than ``HOT_SIDE`` rows on either side and more than ``HOT_PAIRS`` pairs is hot: its pairs are never stored, but
   judged where they meet (``_with_hot``). That is another way to the same edges, however large a block is; no pair is left out.
2. Meta-blocking: edges far below the best edge of their notice are pruned.
3. Evidence: every attribute of a surviving edge is compared, near misses weigh less than agreement, contradictions count
   against. Agreement counts in full if the rarest block shared is rare, less as the block is common (``RARE_PART``). An edge that
   this much speaks against (``FLOOR``) is none, in a block of any size: support adds at most ``SUPPORT``, so it could never be a match.
4. Propagation: lines of the same admission number are one stay, and notices of one stay support each other, while rival stays
   of a notice weaken each other. Repeated until no score moves by more than ``STABLE``; from ``WHOLE_STEPS`` rounds on each step
   is half the one before, so that scores that would swing come to rest.

Stays alike in all that is compared are one line until the end, notices likewise, so copies never multiply.
All steps are joins and aggregations; the graph never leaves the executors.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..session import cut

#: From here on the pairs of a block are judged in tiles of ``TILE`` rows a side; these numbers change the way, never the edges.
HOT_PAIRS, HOT_SIDE, TILE = 2_000, 8, 4_096
#: An edge must be worth this part of the best edge of its notice.
PRUNE = 0.34
#: The evidence an edge must exceed; at or below it no belief is above 4e-6.
FLOOR = -10.0
WHOLE_STEPS, STABLE = 4, 0.05
SUPPORT, RIVALRY = 1.0, 2.0
#: Score from which an edge is a match, and the lead it needs over the best other stay of its notice.
ACCEPT, LEAD = 15.0, 2.0
ARRIVAL_SLACK = 3

#: A block counts as rare while it holds at most this power of the number of stays.
RARE_PART = 0.5

# Portuguese month names as abbreviated in notices, and the codes of the sexes.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
MALE, FEMALE = ("1", "m", "masc", "masculino"), ("3", "f", "fem", "feminino")

ATTRIBUTES = ["ymd", "birth", "sex", "place", "post", "cid", "number", "tail", "arrival", "age"]


def any_day(value: Column) -> Column:
    """A date in any of the writings yyyy-MM-dd, yyyyMMdd, dd/MM/yyyy, dd.MM.yy and d mon yyyy; two-digit years up to 21 are 20yy."""
    v = F.lower(F.trim(value))
    month = F.lit(None).cast("string")
    for n, name in enumerate(MONTHS, 1):
        month = F.when(v.contains(name), f"{n:02d}").otherwise(month)
    g = lambda pattern, k: F.regexp_extract(v, pattern, k)
    dotted, spelled, slashed = r"^(\d{2})\.(\d{2})\.(\d{2})$", r"^(\d{1,2}) [a-z]{3,9} (\d{4})$", r"^(\d{2})[/.-](\d{2})[/.-](\d{4})$"
    yy = g(dotted, 3)
    compact = (
        F.when(v.rlike(r"^\d{8}$"), v)
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.translate(F.substring(v, 1, 10), "-", ""))
        .when(v.rlike(slashed), F.concat(g(slashed, 3), g(slashed, 2), g(slashed, 1)))
        .when(v.rlike(dotted), F.concat(F.when(yy <= "21", "20").otherwise("19"), yy, g(dotted, 2), g(dotted, 1)))
        .when(v.rlike(spelled), F.concat(g(spelled, 2), month, F.lpad(g(spelled, 1), 2, "0")))
    )
    return F.try_to_timestamp(compact, F.lit("yyyyMMdd")).cast("date")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _shaped(day: Column, sex: Column, place: Column, post: Column, cid: Column, number: Column, tail: Column, arrival: Column, age: Column) -> list[Column]:
    """The common columns; fillers (one digit repeated) count as missing."""
    s = F.lower(F.trim(sex))
    full = lambda c, n: F.when(c.rlike(rf"^\d{{{n}}}$") & ~c.rlike(r"^(\d)\1*$"), c)
    code = F.regexp_replace(F.upper(cid), "[^A-Z0-9]", "")
    return [
        F.date_format(day, "yyMMdd").alias("ymd"),
        day.alias("birth"),
        F.when(s.isin(*MALE), "1").when(s.isin(*FEMALE), "3").alias("sex"),
        full(F.substring(_digits(place), 1, 6), 6).alias("place"),
        full(_digits(post), 8).alias("post"),
        F.when(code.rlike(r"^[A-Z]\d{2,3}$"), code).alias("cid"),
        full(number, 13).alias("number"),
        full(tail, 5).alias("tail"),
        arrival.alias("arrival"),
        age.alias("age"),
    ]


def shape_notices(n: DataFrame) -> DataFrame:
    hint = F.trim("aih_hint")
    masked = hint.rlike(r"^\*+\d{5}$")
    number = F.when(~masked, _digits(hint))
    tail = F.when(masked, F.substring(hint, -5, 5)).when(F.length(number) == 13, F.substring(number, 9, 5))
    cols = _shaped(any_day(F.col("birth_day")), F.col("sex_code"), F.col("residence"), F.col("postal_code"), F.col("cid"), number, tail, any_day(F.col("arrival_day")), F.col("age_years").cast("int"))
    return n.where("notice_id IS NOT NULL").select("notice_id", *cols)


def shape_stays(s: DataFrame) -> DataFrame:
    number = F.trim("n_aih")
    age = F.when(F.trim("idade").rlike(r"^\d{1,3}$"), F.trim("idade").cast("int"))
    cols = _shaped(any_day(F.col("nasc")), F.col("sexo"), F.col("munic_res"), F.col("cep"), F.col("diag_princ"), number, F.when(F.length(number) == 13, F.substring(number, 9, 5)), F.to_date(_entry_day(F.col("dt_inter"))), age)
    shaped = s.where("stay_id IS NOT NULL").select("stay_id", *cols, fields.trimmed(F.col("n_aih")).alias("_aih"))
    # lines without a number are one stay if they agree in all that is compared and the birth and arrival are known
    profile = F.when(F.col("birth").isNotNull() & F.col("arrival").isNotNull(), F.concat_ws("|", "birth", "arrival", *[F.coalesce(c, F.lit("?")) for c in ("sex", "place", "post", "cid")]))
    named = shaped.withColumn("entity", F.coalesce("_aih", profile, F.concat(F.lit("stay "), F.col("stay_id").cast("string")))).drop("_aih")
    # rows of one stay that agree in all that is compared are one line until the end
    return named.withColumn("line", F.xxhash64("entity", *ATTRIBUTES))


def _entry_day(value: Column) -> Column:
    """The day of an entry, also where its time is none."""
    v = F.translate(F.substring(F.trim(value), 1, 10), "-", "")
    return F.try_to_timestamp(F.when(F.substring(v, 1, 8).rlike(r"^\d{8}$"), F.substring(v, 1, 8)), F.lit("yyyyMMdd")).cast("date")


BLOCKS: dict[str, tuple[str, str]] = {
    "birth-place": ("ymd", "place"),
    "birth-arrival": ("ymd", "arrival"),
    "birth-post": ("ymd", "post"),
    "post-arrival": ("post", "arrival"),
    "place-arrival": ("place", "arrival"),
    "tail-place": ("tail", "place"),
    "tail-birth": ("tail", "ymd"),
    "tail-arrival": ("tail", "arrival"),
}
#: The low bits of a block key are the number of its block.
BLOCK_BITS = 3


def _keys(rows: DataFrame, row_id: str, slack: int) -> DataFrame:
    """(row_id, key): a hash per block that the row has both attributes of; arrivals also for the days around."""
    hashes = []
    for number, (a, b) in enumerate(BLOCKS.values()):
        for k in range(-slack, slack + 1) if b == "arrival" else (0,):
            second = F.date_add(b, k).cast("string") if b == "arrival" else F.col(b)
            key = F.call_function("shiftleft", F.xxhash64(F.lit(number), F.col(a), second), F.lit(BLOCK_BITS)).bitwiseOR(F.lit(number))
            hashes.append(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), key))
    return rows.select(row_id, F.explode(F.array_compact(F.array(*hashes))).alias("key"))


def _tiled(near: DataFrame, far: DataFrame, sizes: DataFrame, far_id: str) -> DataFrame:
    """``near`` joined to ``far`` by key. The pairs of a key are spread over tiles, so no task holds all of a large one."""
    tiles = sizes.select("key", F.ceil(F.col("n_notices") / TILE).alias("_h"), F.ceil(F.col("n_stays") / TILE).alias("_w"))
    at = lambda c, n: F.pmod(F.xxhash64(c), n)
    along = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = near.join(tiles, "key").select(*near.columns, at("notice_id", F.col("_h")).alias("_i"), along(F.col("_w")).alias("_j"))
    right = far.join(tiles, "key").select(*far.columns, at(far_id, F.col("_w")).alias("_j"), along(F.col("_h")).alias("_i"))
    return left.join(right, ["key", "_i", "_j"]).drop("_i", "_j")


def _with_hot(cold: DataFrame, near: DataFrame, far: DataFrame, sizes: DataFrame, notices: DataFrame, stays: DataFrame, n_stays: int) -> DataFrame:
    """All edges, pruned: those of ``cold`` with the bits of the hot keys that they share too, and those that share only hot keys.

    ``cold`` (notice_id, line, bits, rarest) are the edges of the other keys by these keys alone; ``near`` (notice_id, key, bits) and
    ``far`` (line, key) the rows of hot keys, ``sizes`` (key, n_notices, n_stays). Pairs of hot keys that are pruned or don't
    exceed ``FLOOR`` are dropped in the task where they meet, and are neither shuffled nor written.
    """
    worths = cut(near.groupBy("notice_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "bits"))).alias("worths")))
    lists = cut(far.groupBy("line").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    far = cut(far.join(lists, "line"))
    shared = F.array_compact(F.transform("keys", lambda k: F.try_element_at("worths", k)))
    total = F.aggregate("shared", F.lit(0.0), lambda a, x: a + x)
    both = cold.join(worths, "notice_id", "left").join(lists, "line", "left").withColumn("shared", F.coalesce(shared, F.array().cast("array<double>")))
    cold = cut(both.select("notice_id", "line", (F.col("bits") + total).alias("bits"), F.greatest("rarest", F.array_max("shared")).alias("rarest")))

    def ways(best: DataFrame) -> DataFrame:
        """The rows of ``near`` without the blocks that together aren't worth enough to stand beside the best edge of the notice: an
        edge that is kept shares one of the other keys."""
        block = F.col("key").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        top = near.groupBy("notice_id", block.alias("block")).agg(F.max("bits").alias("top"))
        reach = F.sum("top").over(Window.partitionBy("notice_id").orderBy("top", "block").rowsBetween(Window.unboundedPreceding, 0))
        enough = top.withColumn("reach", reach).join(best, "notice_id", "left").where(F.col("reach") + 1e-6 >= PRUNE * F.coalesce("best", F.lit(0.0)))
        rows = cut(near.withColumn("block", block).join(enough.select("notice_id", "block"), ["notice_id", "block"]).select("notice_id", "key"))
        return rows.join(rows.groupBy("notice_id").agg(F.collect_list("key").alias("via")), "notice_id").join(worths, "notice_id")

    # the best edge needs no stays, only the lists of keys that they have
    of_cold = cold.groupBy("notice_id").agg(F.max("bits").alias("best"))
    of_hot = _tiled(ways(of_cold), far.select("key", "keys").distinct(), sizes, "keys").withColumn("shared", shared).groupBy("notice_id").agg(F.max(total).alias("best"))
    best = cut(of_cold.unionByName(of_hot).groupBy("notice_id").agg(F.max("best").alias("best")))

    left = ways(best).join(best, "notice_id").join(notices.select("notice_id", *[F.col(c).alias(f"n_{c}") for c in ATTRIBUTES]), "notice_id")
    right = far.join(left.select("key").distinct(), "key", "left_semi").join(stays.dropDuplicates(["line"]).select("line", *[F.col(c).alias(f"s_{c}") for c in ATTRIBUTES]), "line")
    # a pair counts at the first of its keys
    met = _tiled(left, right, sizes, "line").where(F.col("key") == F.get(F.filter("keys", lambda k: F.array_contains("via", k)), 0))
    met = met.withColumn("shared", shared).withColumns({"bits": total, "rarest": F.array_max("shared")}).where(F.col("bits") >= PRUNE * F.col("best"))
    new = evidence(met, n_stays).where(F.col("own") > FLOOR).select("notice_id", "line", "bits", "rarest").join(cold, ["notice_id", "line"], "left_anti")
    kept = cold.join(best, "notice_id").where(F.col("bits") >= PRUNE * F.col("best")).drop("best")
    return kept.unionByName(new)


def candidates(notices: DataFrame, stays: DataFrame, n_stays: int) -> DataFrame:
    """(notice_id, line, bits, rarest) of the candidate graph, pruned; of hot blocks only what exceeds ``FLOOR``, as ``link`` asks of all.
    ``n_stays``: how many stays the bits are reckoned against; ``rarest``: the bits of the rarest block shared."""
    n_keys = cut(_keys(notices, "notice_id", ARRIVAL_SLACK))
    wanted = n_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_notices"))
    # only two numbers of a stay travel here, and only keys that some notice has go on
    s_keys = _keys(stays, "line", 0).join(wanted, "key")
    s_keys = cut(s_keys.groupBy("key", "line").agg(F.first("n_notices").alias("n_notices")))
    per = s_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_stays"), F.first("n_notices").alias("n_notices"))
    total = F.lit(float(max(n_stays, 2)))
    is_hot = (F.col("n_stays") * F.col("n_notices") > HOT_PAIRS) & (F.least("n_stays", "n_notices") > HOT_SIDE)
    sizes = cut(per.select("key", is_hot.alias("hot"), F.log2(total / F.col("n_stays")).alias("bits"), "n_notices", "n_stays"))
    left, right = n_keys.join(sizes.select("key", "hot", "bits"), "key"), s_keys.select("key", "line")
    shared = left.where("NOT hot").join(right, "key").select("notice_id", "line", "bits")
    edges = shared.groupBy("notice_id", "line").agg(F.sum("bits").alias("bits"), F.max("bits").alias("rarest"))
    hot = sizes.where("hot").select("key", "n_notices", "n_stays")
    if not hot.isEmpty():
        near = cut(left.where("hot").select("notice_id", "key", "bits"))
        return _with_hot(edges, near, right.join(hot.select("key"), "key"), hot, notices, stays, n_stays)
    best = F.max("bits").over(Window.partitionBy("notice_id"))
    return edges.withColumn("_best", best).where(F.col("bits") >= PRUNE * F.col("_best")).drop("_best")


def evidence(pairs: DataFrame, n_stays: int) -> DataFrame:
    """Adds ``own``, the evidence of the edge by itself; columns n_* are the notice's, s_* the stay's."""
    n, s = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"s_{c}"))

    full = (1 - RARE_PART) * math.log2(max(n_stays, 2))
    worth = F.least(F.greatest(F.col("rarest") / full, F.lit(0.0)), F.lit(1.0))

    def weigh(c: str, agree: float, near: Column | None, close: float, differ: float) -> Column:
        w = F.when(n(c).isNull() | s(c).isNull(), 0.0).when(n(c) == s(c), worth * agree)
        if near is not None:
            w = w.when(near, worth * close)
        return w.otherwise(differ)

    def near_text(c: str) -> Column:
        """One edit apart, or two with the same characters; these are only sorted where that decides."""
        edits = F.levenshtein(n(c), s(c), 2)
        return F.when(edits < 0, False).when(edits <= 1, True).otherwise(F.sort_array(F.split(n(c), "")) == F.sort_array(F.split(s(c), "")))

    days = F.abs(F.datediff(n("arrival"), s("arrival")))
    swapped = (F.year(n("birth")) == F.year(s("birth"))) & (F.month(n("birth")) == F.dayofmonth(s("birth"))) & (F.dayofmonth(n("birth")) == F.month(s("birth")))
    tail_near = near_text("tail")
    # a birth day may be off by up to a dozen days
    shifted = F.abs(F.datediff(n("birth"), s("birth"))) <= 12
    return pairs.withColumn(
        "own",
        weigh("ymd", 9.0, near_text("ymd") | swapped | shifted, 3.0, -6.0)
        + weigh("sex", 1.0, None, 0.0, -5.0)
        + weigh("place", 6.0, near_text("place"), 2.0, -4.0)
        + weigh("post", 9.0, near_text("post"), 4.0, -2.0)
        + F.when(n("cid").isNull() | s("cid").isNull(), 0.0).when(n("cid") == s("cid"), 5.0).when(F.substring(n("cid"), 1, 3) == F.substring(s("cid"), 1, 3), 4.0).otherwise(-7.0)
        + F.when(n("tail").isNull() | s("tail").isNull(), 0.0)
        .when(n("number").isNotNull() & (n("number") == s("number")), 14.0)
        .when(n("tail") == s("tail"), F.when(n("number").isNull(), 9.0).when(F.levenshtein(n("number"), s("number")) <= 2, 9.0).otherwise(-2.0))
        .when(n("number").isNotNull() & (F.levenshtein(n("number"), s("number")) <= 2), 7.0)
        .when(n("number").isNull() & tail_near, 3.0)
        .otherwise(-8.0)
        + F.when(days.isNull(), 0.0).when(days == 0, 6.0).when(days == 1, 5.0).when(days <= 3, 3.0).otherwise(-12.0)
        + F.when(n("age").isNull() | s("age").isNull(), 0.0).when(F.abs(n("age") - s("age")) <= 1, 2.0).otherwise(-2.0),
    )


def propagate(edges: DataFrame) -> DataFrame:
    """(notice_id, line, entity, own) to (notice_id, entity, own) with ``score`` and ``confidence``, both of the entity as a whole."""
    at_entity = cut(edges.groupBy("notice_id", "entity").agg(F.max("own").alias("own"), F.max("n_same").alias("n_same")))
    sure = lambda c: 1 / (1 + F.exp((F.lit(ACCEPT) - F.col(c)) / 2))
    state = at_entity.withColumn("score", F.col("own"))
    for k in count():
        step = 0.5 ** max(0, k + 1 - WHOLE_STEPS)
        belief = state.withColumn("belief", sure("score"))
        of_stay = belief.groupBy("entity").agg(F.sum(F.col("belief") * F.col("n_same")).alias("stay_belief"))
        of_notice = belief.groupBy("notice_id").agg(F.max(F.struct("belief", "entity")).alias("first"))
        others = belief.join(of_notice, "notice_id").where(F.col("entity") != F.col("first.entity")).groupBy("notice_id").agg(F.max("belief").alias("second"))
        near = belief.join(of_stay, "entity").join(of_notice, "notice_id").join(others, "notice_id", "left")
        support = F.least(F.greatest(F.col("stay_belief") - F.col("belief"), F.lit(0.0)), F.lit(1.0))
        rival = F.when(F.col("entity") == F.col("first.entity"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("first.belief"))
        goal = F.col("own") + SUPPORT * support - RIVALRY * rival
        fresh = near.withColumn("_score", F.col("score") + step * (goal - F.col("score")))
        fresh = cut(fresh.select("notice_id", "entity", "n_same", "own", F.col("_score").alias("score"), F.abs(F.col("_score") - F.col("score")).alias("moved")))
        state = fresh.drop("moved")
        if (fresh.agg(F.max("moved")).first()[0] or 0.0) <= STABLE:
            return state.withColumn("confidence", F.round(sure("score"), 6))


def link(notices: DataFrame, stays: DataFrame) -> DataFrame:
    """(notice_id, stay_id, score, confidence): the stay that each notice tells of, one row for each of its lines, or none.

    ``notices`` and ``stays`` are as in the tables of these names; extra columns don't matter. A notice may have nulls anywhere;
    one without any pair of block attributes links to nothing. Repeated notices (same id) are one, the first in
    the order of their attributes. Ties between two stays leave
    the notice without one, as it can't tell of both.
    """
    first = Window.partitionBy("notice_id").orderBy(*[F.col(c).asc_nulls_last() for c in ATTRIBUTES])
    every = cut(shape_notices(notices).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("alike", F.xxhash64(*ATTRIBUTES)))
    n = cut(every.groupBy("alike").agg(F.min("notice_id").alias("notice_id"), F.count(F.lit(1)).alias("n_same"), *[F.first(c).alias(c) for c in ATTRIBUTES]))
    s = cut(shape_stays(stays))
    n_stays = s.count()
    pairs = cut(candidates(n, s, n_stays))
    # what follows from other columns doesn't travel
    slim = s.select("line", "birth", "sex", "place", "post", "cid", "number", "arrival", "age", F.when(F.col("entity") == F.col("number"), None).otherwise(F.col("entity")).alias("_e"), F.when(F.col("number").isNull(), F.col("tail")).alias("_t"))
    wanted = slim.join(pairs.select("line").distinct(), "line", "left_semi").distinct()
    wanted = wanted.withColumns({"ymd": F.date_format("birth", "yyMMdd"), "tail": F.coalesce("_t", F.substring("number", 9, 5)), "entity": F.coalesce("_e", "number")})
    left = n.select("notice_id", "n_same", *[F.col(c).alias(f"n_{c}") for c in ATTRIBUTES])
    right = wanted.select("line", "entity", *[F.col(c).alias(f"s_{c}") for c in ATTRIBUTES])
    judged = evidence(pairs.join(left, "notice_id").join(right, "line"), n_stays)
    edges = cut(judged.where(F.col("own") > FLOOR).select("notice_id", "n_same", "line", "entity", "own"))
    final = propagate(edges)
    w = Window.partitionBy("notice_id").orderBy(F.desc("score"), "entity")
    led = final.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    won = cut(led.where((F.col("_r") == 1) & (F.col("score") >= ACCEPT) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= LEAD))).select("notice_id", "entity", "score", "confidence"))
    named = won.join(n.select("notice_id", "alike"), "notice_id").drop("notice_id").join(every.select("alike", "notice_id"), "alike")
    return named.join(s.select("entity", "stay_id"), "entity").select("notice_id", "stay_id", "score", "confidence").distinct()
