"""Scores for abusive, hateful and sexual content, learned from raters' marks.

Training, on a bounded sample of pages: words and word pairs in folded spelling are the features; a chain of linear models
predicts the categories one after the other, each later one also given the earlier categories' probabilities. Those come from
models that haven't seen the page (out-of-fold), so that a later model doesn't trust them too much. Where marks are few, the
sample is filled up with unmarked pages: what the chain takes for a hit among them counts as marked in the next round, which
teaches it the words that go with the marked ones. Thresholds are those of the best F0.5 of the out-of-fold scores of the marked
pages, where most pages beyond the threshold are marked; a category whose scores don't allow that has no hits.

Scoring, on all pages: a few sentences make a page abusive, so a page scores as its worst stretch of ``WINDOW`` words. The
whole text is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import pages

CATEGORIES = ("abusive", "hateful", "sexual")
#: The sample: at most so many pages and characters, marked pages first, each in the order of a hash of their ids.
MAX_PAGES, MAX_CHARS = 8_000, 64_000_000
#: At most so many of them are unmarked, and so often they are labelled anew.
MAX_UNMARKED, ROUNDS = 7_000, 1
WINDOW = 14
LEAST_PAGES, MOST_PAGES = 2, 0.15
FOLDS, STEPS, L2, SCALE = 4, 45, 1.0, 0.3
#: Least part of the marked pages beyond a threshold that must be marked with the category, reckoned with so many more pages of the average.
LEAST_PRECISION, DOUBT = 0.5, 2.0

_SPACED = re.compile(r"(?<!\w)(?:\w ){3,}\w(?!\w)")
_REPEATED = re.compile(r"([^\W\d])\1{2,}")
_WORDS = bytes(b if b != ord("?") else ord(" ") for b in pages._TABLE[:42]) + b"*" + bytes(b if b != ord("?") else ord(" ") for b in pages._TABLE[43:])


def words(text: str | None, edges) -> list[str]:
    """The words of a page in reading order and folded spelling; spaced-out and stretched words are put right."""
    if not text:
        return []
    t = pages.running_text(pages.read_columns(text, None if edges is None else list(edges))).lower()
    t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    t = _REPEATED.sub(r"\1", t)
    t = t.encode("latin-1", "replace").translate(_WORDS).decode("latin-1")
    return t.replace("vv", "w").replace("ii", "b").replace("ru", "m").split()


class Features:
    """Vocabulary of words and pairs with their weights by rarity; pages as flat arrays of feature numbers."""

    def __init__(self, pages_words: list[list[str]]) -> None:
        df: Counter = Counter()
        for w in pages_words:
            df.update({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})
        n = max(len(pages_words), 1)
        kept = sorted(f for f, c in df.items() if LEAST_PAGES <= c <= max(MOST_PAGES * n, LEAST_PAGES))
        self.index = {f: i for i, f in enumerate(kept)}
        self.value = np.array([np.log(n / df[f]) for f in kept]) * SCALE

    def _word(self, w: str) -> str:
        if "*" in w and len(w) > 3:  # a masked vowel
            for v in "aciu":
                if (x := w.replace("*", v)) in self.index:
                    return x
        return w

    def flat(self, pages_words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Page of each word, its feature, and that of the pair it begins (-1: none)."""
        clean = [[self._word(w) for w in p] if any("*" in w for w in p) else p for p in pages_words]
        get = self.index.get
        page = np.repeat(np.arange(len(clean)), [len(p) for p in clean])
        one = np.fromiter((get(w, -1) for p in clean for w in p), dtype=np.int64, count=len(page))
        two = np.fromiter((get(f"{a} {b}", -1) for p in clean for a, b in zip(p, p[1:] + ["\n"])), dtype=np.int64, count=len(page))
        return page, one, two


def worst_windows(n: int, flat: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Per page the largest sum of ``weight`` over WINDOW words in a row; 0 for a page without words."""
    page, one, two = flat
    if not len(page):
        return np.zeros(n)
    w = np.append(weight, 0.0)
    single, pair = np.concatenate([[0.0], np.cumsum(w[one])]), np.concatenate([[0.0], np.cumsum(w[two])])
    end = np.searchsorted(page, np.arange(n), "right")[page]
    at = np.arange(len(page))
    hi = np.minimum(at + WINDOW, end)
    sums = single[hi] - single[at] + pair[hi - 1] - pair[at]
    out = np.full(n, -np.inf)
    np.maximum.at(out, page, sums)
    return np.where(np.isfinite(out), out, 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    weight: np.ndarray
    bias: float
    earlier: np.ndarray  # of the earlier categories' probabilities


class Pages:
    """Which features each page has, by page and by feature, so that sums over either run over neighbours in memory."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, value: np.ndarray, n: int) -> None:
        """``rows`` ascend; ``value`` has one number a feature."""
        self.value, self.n = value, n
        self.cols, self.x = cols, value[cols]
        by = np.argsort(cols, kind="stable")
        self.rows, self.x_by_col = rows[by], value[cols[by]]
        self.row_starts, self.col_starts = self._starts(rows, n), self._starts(cols[by], len(value))

    @staticmethod
    def _starts(sorted_: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(sorted_, np.arange(n + 1))
        some = np.flatnonzero(np.diff(first))
        return some, first[some]

    @staticmethod
    def _sums(v: np.ndarray, starts: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(starts[0]):
            out[starts[0]] = np.add.reduceat(v, starts[1])
        return out

    def per_page(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.cols] * self.x, self.row_starts, self.n)

    def per_feature(self, e: np.ndarray) -> np.ndarray:
        return self._sums(e[self.rows] * self.x_by_col, self.col_starts, len(self.value))


def fit(pages_: Pages, earlier: np.ndarray, y: np.ndarray, use: np.ndarray) -> Linear:
    """Logistic regression with an L2 penalty by adaptive gradient steps, on the pages where ``use`` is 1."""
    nv = len(pages_.value)
    w, v, b = np.zeros(nv), np.zeros(earlier.shape[1]), -2.0
    gw, gv, gb = np.full(nv, 1e-6), np.full(len(v), 1e-6), 1e-6
    for _ in range(STEPS):
        z = pages_.per_page(w) + earlier @ v + b
        e = (_sigmoid(z) - y) * use
        d = pages_.per_feature(e) + L2 * w
        dv, db = earlier.T @ e + L2 * v, e.sum()
        gw, gv, gb = gw + d * d, gv + dv * dv, gb + db * db
        w, v, b = w - 0.3 * d / np.sqrt(gw), v - 0.3 * dv / np.sqrt(gv), b - 0.3 * db / np.sqrt(gb)
    return Linear(w * pages_.value, float(b), v)


class Chain:
    """The fitted chain: features, one model per category, and a threshold each. ``unmarked`` are pages without marks."""

    def __init__(self, marked: list[list[str]], marks: np.ndarray, unmarked: list[list[str]] | None = None) -> None:
        n = len(marked)
        unmarked = unmarked or []
        self._fit(marked, marks.astype(float), n)
        if unmarked and n:
            every = marked + unmarked
            for _ in range(ROUNDS):
                p = self.score(unmarked)
                labels = np.vstack([marks, p >= np.array(self.thresholds)]).astype(float)
                if not labels[n:].any():
                    break
                self._fit(every, labels, n)

    def _fit(self, pages_words: list[list[str]], marks: np.ndarray, n_marked: int) -> None:
        n = len(pages_words)
        self.features = Features(pages_words)
        flat = self.features.flat(pages_words)
        page, one, two = flat
        seen = np.unique(np.concatenate([page[one >= 0] * (len(self.features.value) + 1) + one[one >= 0], page[two >= 0] * (len(self.features.value) + 1) + two[two >= 0]]))
        rows, cols = np.divmod(seen, len(self.features.value) + 1)
        matrix = Pages(rows, cols, self.features.value, n)
        fold = np.arange(n) % FOLDS
        self.models: list[Linear] = []
        self.thresholds: list[float] = []
        out_of_fold = np.zeros((n, marks.shape[1]))
        for c in range(marks.shape[1]):
            y, earlier = marks[:, c], out_of_fold[:, :c]
            z = np.zeros(n)
            for k in range(FOLDS):
                m = fit(matrix, earlier, y, (fold != k).astype(float))
                z = np.where(fold == k, worst_windows(n, flat, m.weight) + earlier @ m.earlier + m.bias, z)
            out_of_fold[:, c] = _sigmoid(z)
            self.models.append(fit(matrix, earlier, y, np.ones(n)))
            self.thresholds.append(best_threshold(out_of_fold[:n_marked, c], y[:n_marked]))
        self.out_of_fold = out_of_fold[:n_marked]

    def score(self, pages_words: list[list[str]]) -> np.ndarray:
        n = len(pages_words)
        flat = self.features.flat(pages_words)
        out = np.zeros((n, len(self.models)))
        for c, m in enumerate(self.models):
            out[:, c] = _sigmoid(worst_windows(n, flat, m.weight) + out[:, :c] @ m.earlier + m.bias)
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The score from which F0.5 is best, midway to the next lower one; above 1 if none has LEAST_PRECISION.

    Wrong marks hide how much is found, not how much of it is right, so precision weighs more. It is reckoned as if DOUBT pages of
    the average were among the hits, so that a lucky first page doesn't make a threshold.
    """
    if not y.sum():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    precision, recall = (hits + DOUBT * y.mean()) / (n + DOUBT), hits / y.sum()
    f_half = np.where(precision >= LEAST_PRECISION, 1.25 * precision * recall / (0.25 * precision + recall + 1e-12), 0.0)
    j = int(f_half.argmax())
    if f_half[j] <= 0:
        return 1.1
    return float((p[order[j]] + (p[order[j + 1]] if j + 1 < len(y) else 0.0)) / 2)


def _edges(edges: str | None):
    return F.transform(F.col(edges), lambda b: b["x0"]) if edges else F.lit(None).cast("array<int>")


def train(docs: DataFrame, marks: DataFrame, text: str = "text", edges: str | None = "line_boxes") -> Chain:
    """``marks`` has doc_id and a 0/1 column per category; several marks of a page are averaged (half counts as 1), null is 0."""
    many = marks.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[(F.avg(F.coalesce(c, F.lit(0))) >= 0.5).cast("int").alias(c) for c in CATEGORIES])
    some = many.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PAGES)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(text).alias("t"), _edges(edges).alias("e"))
    marked = cut(texts.join(some, "doc_id").dropDuplicates(["doc_id"]))
    free = max(0, min(MAX_UNMARKED, MAX_PAGES - marked.count()))
    # a top list of hashes: each task keeps its first ``free`` ids
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(marked.select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(free) if free else many.select("doc_id").limit(0)
    filled = texts.join(others, "doc_id").dropDuplicates(["doc_id"]).select("*", *[F.lit(None).cast("int").alias(c) for c in CATEGORIES])
    rows = cut(marked.unionByName(filled).withColumn("_m", F.col(CATEGORIES[0]).isNull().cast("int")).withColumn("_o", F.xxhash64("doc_id")))
    n, total = 0, 0
    order = ["_m", "_o", "doc_id"]
    for r in rows.select(*order, F.coalesce(F.length("t"), F.lit(0)).alias("n")).orderBy(*order).collect():  # at most MAX_PAGES rows
        total += r.n
        if total > MAX_CHARS:
            break
        n += 1
    taken = rows.orderBy(*order).limit(n).toPandas()
    read = [words(t, e) for t, e in zip(taken["t"], taken["e"])]
    n_marked = int((taken["_m"] == 0).sum())
    marks = taken[list(CATEGORIES)].head(n_marked).to_numpy(dtype=float).reshape(n_marked, len(CATEGORIES))
    return Chain(read[:n_marked], marks, read[n_marked:])


def score(docs: DataFrame, chain: Chain, keep: list[str], text: str = "text", edges: str | None = "line_boxes") -> DataFrame:
    """``keep`` columns, a score per category (0 to 1) and whether it reaches the threshold (is_*). Null and empty texts score low."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Chain = shared.value
        for b in batches:
            p = model.score([words(t, e) for t, e in zip(b["_t"], b["_e"])]) if len(b) else np.zeros((0, len(CATEGORIES)))
            out = b.drop(columns=["_t", "_e"])
            for c, name in enumerate(CATEGORIES):
                out[name] = np.round(p[:, c], 6)
                out[f"is_{name}"] = p[:, c] >= model.thresholds[c]
            yield out

    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} double, is_{c} boolean" for c in CATEGORIES])
    return docs.select(*[f.name for f in fields], F.col(text).alias("_t"), _edges(edges).alias("_e")).mapInPandas(run, schema)
