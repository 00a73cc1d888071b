"""Combining sources to target shares of tokens, each page used a capped number of times.

Water-filling: every source asks for its share of the total; sources that would need more than ``max_repeats`` uses of each
page are clamped there and what they lack is handed to the others in proportion to their weights, until nothing is clamped
anew. Without a given total, the largest total is taken at which no source is clamped, so that every share is met.

A source's amount is then drawn as whole repetitions of all its pages plus a seeded choice of pages for the fraction: pages
in the order of a seeded hash, until the fraction is filled. The order needs no sort of a source: token sums per hash bucket
tell which buckets go in whole, and only the one bucket in which the fraction ends is looked at page by page.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Buckets hold about so many pages of all sources together, and there are at least so many of them: one bucket a source is cut
#: page by page, in one task.
PAGES_A_BUCKET, BUCKETS = 100_000, 4096
SEED = 20211231
#: Texts are encoded in pieces of about this many characters, cut where the pattern must cut anyway.
PIECE = 20_000
MAX_SOURCES = 100_000


def _encoder(path: str):
    import tiktoken

    try:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    except ImportError:  # the pattern published with the vocabulary
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> list[str]:
    """The text in pieces; the cuts lie before a single space between two letters, where a token always begins."""
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    cut_at = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
    while len(text) - at > PIECE:
        m = cut_at.search(text, at + PIECE)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds ``n_tokens``, exact over the whole text; null and empty texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in b[text]]
            yield b.drop(columns=[text]).assign(n_tokens=pd.Series(n, index=b.index, dtype="int64"))

    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return docs.select(*[f.name for f in fields], text).mapInPandas(run, schema)


@dataclass(frozen=True)
class Source:
    name: str
    tokens: int
    share: float
    max_repeats: int


def water_fill(sources: list[Source], total: float | None = None) -> dict[str, float]:
    """Tokens each source is to give. Sources without tokens, share or repeats give none."""
    usable = [s for s in sources if s.tokens > 0 and s.share > 0 and s.max_repeats > 0]
    if not usable:
        return {s.name: 0.0 for s in sources}
    weight = sum(s.share for s in usable)
    if total is None:
        total = min(s.tokens * s.max_repeats * weight / s.share for s in usable)
    given = {s.name: 0.0 for s in sources}
    open_, left = list(usable), float(total)
    while open_ and left > 0:
        weight = sum(s.share for s in open_)
        full = [s for s in open_ if left * s.share / weight > s.tokens * s.max_repeats * (1 + 1e-12)]
        if not full:
            given |= {s.name: left * s.share / weight for s in open_}
            break
        for s in full:
            given[s.name] = float(s.tokens * s.max_repeats)
            left -= given[s.name]
        open_ = [s for s in open_ if s not in full]
    return given


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, source, n_tokens), ``targets`` (source_name, target_share, max_repeats).

    Returns the selection (doc_id, source, n_tokens, repeats; pages with 0 repeats left out) and the report per target source.
    Pages of null or unlisted sources are never used. Repeated target rows: the largest share counts. Of targets, at most
    MAX_SOURCES rows reach the driver.
    """
    spark = docs.sparkSession
    named = targets.where(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    buckets, n_docs = BUCKETS, docs.count()
    while buckets * PAGES_A_BUCKET < n_docs:
        buckets *= 2
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(buckets)).cast("int")
    pages = docs.select("doc_id", "source", "n_tokens").join(named.select(F.col("source_name").alias("source")), "source", "left_semi").withColumn("bucket", bucket)
    sums = cut(pages.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
    have = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("n_docs"))
    rows = named.join(have, F.col("source_name") == F.col("source"), "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = water_fill([Source(r.source_name, r.tokens or 0, r.share or 0.0, r.cap or 0) for r in rows], total)
    plan = []
    for r in rows:
        have_tokens, want = r.tokens or 0, wanted[r.source_name]
        whole = min(int(want // have_tokens), r.cap or 0) if have_tokens else 0
        part = want - whole * have_tokens if whole < (r.cap or 0) else 0.0
        plan.append((r.source_name, r.share, r.cap, have_tokens, r.n_docs or 0, whole, float(part), want))
    plan_df = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available_tokens long, n_docs long, whole int, part double, planned_tokens double")

    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    edge = before.join(plan_df.select("source", "part"), "source").select("source", "bucket", "before", "tokens", "part")
    # buckets that end before the fraction does go in whole; the one in which it ends is cut page by page
    edge = edge.withColumn("fate", F.when(F.col("before") + F.col("tokens") <= F.col("part"), 2).when(F.col("before") < F.col("part"), 1).otherwise(0))
    placed = pages.join(edge.select("source", "bucket", "before", "fate"), ["source", "bucket"]).join(plan_df.select("source", "whole", "part"), "source")
    order = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id")
    ends = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut_bucket = placed.where("fate = 1").withColumn("more", F.when(F.col("before") + ends - F.col("n_tokens") / 2 <= F.col("part"), 1).otherwise(0))
    others = placed.where("fate != 1").withColumn("more", F.when(F.col("fate") == 2, 1).otherwise(0))
    chosen = cut_bucket.unionByName(others).withColumn("repeats", F.col("whole") + F.col("more"))
    selection = cut(chosen.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats"))
    reached = selection.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("repeats").alias("most_repeats")
    )
    all_tokens = selection.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] or 0
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = plan_df.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "available_tokens", F.round("planned_tokens").cast("long").alias("planned_tokens"),
        nil("used_docs").alias("used_docs"), nil("used_tokens").alias("used_tokens"), nil("most_repeats").alias("most_repeats"),
        F.round(F.try_divide(nil("used_tokens"), nil("available_tokens")), 6).alias("epochs"),
        F.round(F.try_divide(nil("used_tokens"), F.lit(all_tokens)), 6).alias("reached_share"),
    )
    return selection, report
