"""Queries p1 and p6 to p9 over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..session import cut, table
from . import content, leakage, linkage, mixture, nearest

P1_TOLERANCE = 48 * 3600 * 1_000_000


# --- p1: nearest record in time ------------------------------------------------------------------------------------------
def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    key = lambda: (fields.birth_day(F.col("nasc")).alias("day"), fields.municipality6(F.col("munic_res")).alias("place"))
    exits = table(spark, d, "transfer_exits").select(F.col("exit_id").alias("left_id"), nearest.micros(F.col("dt_saida")).alias("t"), *key())
    stays = table(spark, d, "stays").select(F.col("stay_id").alias("right_id"), nearest.micros(fields.entry_moment(F.col("dt_inter"))).alias("t"), *key())
    pairs = nearest.nearest_within(exits, stays, ["day", "place"], P1_TOLERANCE)
    return pairs.select(F.col("left_id").alias("exit_id"), F.col("right_id").alias("stay_id"), (F.col("distance") / 1_000_000).alias("distance_s"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_nearest(spark, d).select("exit_id", "stay_id")


# --- p6: notices and stays -----------------------------------------------------------------------------------------------
def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "care_notices"), table(spark, d, "stays"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_links(spark, d).select("stay_id", "notice_id")


# --- p7: held-out passages on pages -----------------------------------------------------------------------------------------
def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, with the pages that hold them."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max("n_words").alias("most_words"))


# --- p8: mixing sources --------------------------------------------------------------------------------------------------
def _p8(spark: SparkSession, d: str, total: str | None = None, size: str = "tokens") -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    if size == "tokens":
        docs = cut(mixture.count_tokens(docs, ["doc_id", "source"]))
    else:
        docs = docs.select("doc_id", "source", F.col(size).alias("n_tokens"))
    amount = docs.agg(F.sum("n_tokens")).first()[0] if total == "corpus" else None
    return mixture.mix(docs, table(spark, d, "mix_targets"), amount)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every page that is used, and how often, at the largest total that meets every target share."""
    return _p8(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached by p8_mix."""
    return _p8(spark, d)[1]


def p8_mix_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    """Every page that is used, and how often, when as many tokens as the corpus has are asked for: small sources stop at their
    cap, and the others take what those lack."""
    return _p8(spark, d, "corpus")[0]


def p8_shares_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached by p8_mix_corpus_size."""
    return _p8(spark, d, "corpus")[1]


def p8_plan_by_length(spark: SparkSession, d: str) -> DataFrame:
    """What the water-filling gives each source at the size of the corpus, sizes in characters, which SQL can follow."""
    return _p8(spark, d, "corpus", "n_chars")[1].select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "planned_tokens")


# --- p9: abusive, hateful and sexual content -----------------------------------------------------------------------------
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return content.score(docs, content.train(docs, table(spark, d, "content_labels")), ["doc_id", "source"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.col(f"is_{c}"), F.lit(c)) for c in content.CATEGORIES]))
    return p9_scores(spark, d).select("doc_id", F.explode(hits).alias("category"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of pages of each category per source."""
    rates = [F.round(F.avg(F.col(f"is_{c}").cast("double")), 6).alias(f"{c}_rate") for c in content.CATEGORIES]
    means = [F.round(F.avg(c), 6).alias(f"{c}_mean") for c in content.CATEGORIES]
    return p9_scores(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *rates, *means)


QUERIES = {f.__name__: f for f in (p1_found, p1_nearest, p6_found, p6_links, p7_found, p7_leaks, p7_items, p8_mix, p8_shares, p8_mix_corpus_size, p8_shares_corpus_size, p8_plan_by_length, p9_found, p9_scores, p9_rates)}
from .sql import SQL  # noqa: E402, F401
