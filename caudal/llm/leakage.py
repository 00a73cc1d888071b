"""Held-out passages that were printed on pages of a corpus.

1. Seeds: windows of ``SEED`` characters in a spelling without spaces in which look-alike letters are one (pages.fold). Of any
   ``STEP`` windows of an item in a row the one with the least hash is a seed, wherever words begin; pages look up all their
   windows, so every ``SEED + STEP - 1`` intact characters of an item are met.
2. Rarity: a seed strays where it stands on a page outside of any ``LONG`` characters that an item has, too. Phrases of the
   language stray often, the seeds of a passage seldom, even of one printed on a third of all pages. Seeds that stray on more
   than ``RARE`` of all pages (see ``_rare``) aren't used.
3. Seed join: page windows are joined with the rare seeds by their hash. Page and item are a candidate if the bits of their
   seeds that don't overlap add up to ``LEAST_UNIQUE`` times those of a seed that never strays. Bitmaps of the seeds, of
   bounded size, keep back nearly all windows that can't meet one; they only save rows, the join decides.
4. Smith-Waterman alignment of item and page. Stretches that agree in ``ANCHOR`` characters are chained by dynamic programming,
   and only what lies between and beside them is aligned letter by letter. Reading on after an insertion of any length (an
   advert, lines of another column) has one flat price. The item is held by the page if ``least_words`` consecutive words align.

Items and pages are tables throughout; nothing that grows with either is broadcast. Equal items are searched once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import pages

SEED, STEP = 10, 4
#: Stretches that tell a seed inside a passage from a stray one: three windows, each this far behind the one before.
STRIDE = 7
LONG = SEED + 2 * STRIDE
RARE = 1 / 128
#: A candidate's separate seeds must weigh as much as this many that never stray.
LEAST_UNIQUE = 1.5
LEAST_WORDS = 15
#: The bitmap has about this many bits a seed, and at most so many in all (32 MB).
BITS_A_SEED, MOST_BITS = 64, 1 << 28
MATCH, MISMATCH, SKIP, JUMP = 2, -6, -6, -40
#: Parts of a word's, and of a run's, characters that must align.
WORD_PART, RUN_PART = 0.65, 0.85
ANCHOR = 6
#: Between anchors no ``ANCHOR`` characters agree in a row, so less than RUN_PART of them do; wider gaps are left open.
GAP = 64
#: Characters of the item beside the outermost anchors that are still aligned.
REACH = 24
#: There a misread letter costs less, or the first or last word of a passage would be cut off at it.
EDGE_MISMATCH = -1
#: Part of the characters of ``least_words`` words that anchors must cover for an alignment to be worth while.
COVERED = 0.6
#: Chains score at least so much for each of these characters: twice what they cover, less than one for the rest.
WORTH = 0.5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def windows(c: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` characters in a row."""
    if len(c) < k:
        return np.zeros(0, dtype=np.uint64)
    wide = c.astype(np.uint64)
    h = np.zeros(len(c) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(1_000_003) + wide[j : j + len(h)]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIER
    return h ^ (h >> np.uint64(32))


def chosen(h: np.ndarray) -> np.ndarray:
    """The places of the seeds: the least hash of each STEP in a row."""
    if len(h) <= STEP:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, dtype=np.int64)
    n = len(h) - STEP + 1
    least = np.min([h[j : j + n] for j in range(STEP)], axis=0)
    hit = np.zeros(len(h), dtype=bool)
    for j in range(STEP):
        hit[j : j + n] |= h[j : j + n] == least
    return np.flatnonzero(hit)


def long_windows(h: np.ndarray) -> np.ndarray:
    """A hash of each LONG characters in a row, from those of SEED."""
    n = max(len(h) - 2 * STRIDE, 0)
    mixed = (h[:n] * _MULTIPLIER) ^ h[STRIDE : STRIDE + n]
    return (mixed * _MULTIPLIER) ^ h[2 * STRIDE :][:n]


def item_words(text: str) -> tuple[str, list[int]]:
    """The folded characters of an item and where its words end."""
    folded = [w for w in map(pages.fold, text.split()) if w]
    return "".join(folded), np.cumsum([len(w) for w in folded]).tolist()


def page_stream(text: str, edges) -> str:
    return pages.fold("".join(pages.read_columns(text, None if edges is None else list(edges))))


def smith_waterman(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each character of ``a`` the place in ``b`` it is matched with, or -1, by the best local alignment."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), dtype=np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * np.int32(-SKIP)
    for i in range(1, n + 1):
        row, up = h[i], h[i - 1]
        np.maximum(up + SKIP, 0, out=row)
        np.maximum(row[1:], up[:-1] + np.where(b == a[i - 1], MATCH, MISMATCH), out=row[1:])
        top = np.maximum.accumulate(row)
        np.maximum(row, np.maximum.accumulate(row + ramp) - ramp, out=row)
        np.maximum(row, top + JUMP, out=row)
    return _trace(h, a, b, *divmod(int(h.argmax()), m + 1), True)


def _trace(h: np.ndarray, a: np.ndarray, b: np.ndarray, i: int, j: int, local: bool, wrong: int = MISMATCH) -> np.ndarray:
    out = np.full(len(a), -1, dtype=np.int64)
    while i > 0 and j > 0 and (not local or h[i, j] > 0):
        v = h[i, j]
        same = a[i - 1] == b[j - 1]
        if v == h[i - 1, j - 1] + (MATCH if same else wrong):
            if same:
                out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif v == h[i - 1, j] + SKIP:
            i -= 1
        elif v == h[i, j - 1] + SKIP:
            j -= 1
        else:
            j = int(h[i, :j].argmax())
    return out


def _from_start(a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
    """Alignment that begins where both begin; it ends where both end (``whole``) or where it scores best."""
    n, m = len(a), len(b)
    wrong = MISMATCH if whole else EDGE_MISMATCH
    if whole and n == m and (n <= 2 or 2 * (a == b).sum() >= n):  # misread letters only
        return np.where(a == b, np.arange(n), -1)
    ramp = np.arange(m + 1, dtype=np.int32) * np.int32(-SKIP)
    h = np.empty((n + 1, m + 1), dtype=np.int32)
    h[0] = np.maximum(-ramp, JUMP)
    h[0, 0] = 0
    for i in range(1, n + 1):
        row, up = h[i], h[i - 1]
        row[:] = up + SKIP
        np.maximum(row[1:], up[:-1] + np.where(b == a[i - 1], MATCH, wrong), out=row[1:])
        top = np.maximum.accumulate(row)
        np.maximum(row, np.maximum.accumulate(row + ramp) - ramp, out=row)
        np.maximum(row, top + JUMP, out=row)
    return _trace(h, a, b, *((n, m) if whole else divmod(int(h.argmax()), m + 1)), False, wrong)


def sorted_windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all ANCHOR characters in a row, in order, and their places."""
    h = windows(text, ANCHOR)
    order = np.argsort(h, kind="stable")
    return h[order], order


def anchors(ha: np.ndarray, page: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ANCHOR or more equal characters: where they begin in item and page, and their lengths, in page order."""
    hb, order = page
    lo = np.searchsorted(hb, ha, "left")
    n = np.zeros(len(ha), dtype=np.int64)
    if len(hb):
        met = np.flatnonzero(hb[np.minimum(lo, len(hb) - 1)] == ha)
        n[met] = np.searchsorted(hb, ha[met], "right") - lo[met]
    i = np.repeat(np.arange(len(ha)), n)
    j = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(i) else np.zeros(0, dtype=np.int64)
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (np.diff(j - i) != 0) | (np.diff(i) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(i)]])) + ANCHOR - 1
    i, j = i[first], j[first]
    by = np.lexsort((i, j))
    return i[by], j[by], length[by]


def _chain(i: list[int], j: list[int], length: list[int]) -> tuple[list[int], float]:
    """The best chain of anchors, by number, and its score. Those far behind on the page are kept as a front of (end in the item, best value up
    to there), so the work grows with the anchors and not with their pairs."""
    size = len(i)
    score, back = [0.0] * size, [-1] * size
    front_end: list[int] = []
    front: list[tuple[float, int]] = []
    near, best_of_all = 0, 0
    for s in range(size):
        a, b, n = i[s], j[s], length[s]
        while j[near] + length[near] < b - GAP:
            end = i[near] + length[near]
            value = score[near] + end
            k = bisect_right(front_end, end)
            if not k or front[k - 1][0] < value:
                if k and front_end[k - 1] == end:
                    k -= 1
                last = k
                while last < len(front) and front[last][0] <= value:
                    last += 1
                front_end[k:last], front[k:last] = [end], [(value, near)]
            near += 1
        best, at = 0.0, -1
        k = bisect_right(front_end, a)
        if k and front[k - 1][0] - a + JUMP > 0:
            best, at = front[k - 1][0] - a + JUMP, front[k - 1][1]
        for p in range(near, s):
            if i[p] < a and j[p] < b:
                di, dj = a - i[p] - length[p], b - j[p] - length[p]
                over = -min(di, dj, 0)
                if over < n:
                    di, dj = di + over, dj + over
                    price = dj - SKIP * (di - dj) if di > dj else di + min(-SKIP * (dj - di), -JUMP)
                    value = score[p] - price - MATCH * over
                    if value > best:
                        best, at = value, p
        score[s], back[s] = MATCH * n + best, at
        if score[s] > score[best_of_all]:
            best_of_all = s
    out = [best_of_all]
    while back[out[-1]] >= 0:
        out.append(back[out[-1]])
    return out[::-1], score[best_of_all]


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> np.ndarray:
    """For each character of ``a`` the place in ``b`` it is matched with, or -1, along a chain of anchors."""
    out = np.full(len(a), -1, dtype=np.int64)

    def between(i0: int, i1: int, j0: int, j1: int) -> None:
        if not 0 < i1 - i0 <= GAP or j1 <= j0:
            return
        part = i1 - i0 + 16
        places = np.arange(j0, j1) if j1 - j0 <= 2 * part else np.concatenate([np.arange(j0, j0 + part), np.arange(j1 - part, j1)])
        m = _from_start(a[i0:i1], b[places], True)
        out[i0:i1] = np.where(m >= 0, places[m], -1)

    ei = ej = -1
    for i, j, n in chain:
        if ei >= 0:
            over = max(0, ei - i, ej - j)
            i, j, n = i + over, j + over, n - over
            between(ei, i, ej, j)
        out[i : i + n] = np.arange(j, j + n)
        ei, ej = i + n, j + n
    i, j, _ = chain[0]
    lo, page_lo = max(0, i - REACH), max(0, j - REACH - 8)
    if i > lo and j > page_lo:
        m = _from_start(a[lo:i][::-1], b[page_lo:j][::-1], False)[::-1]
        out[lo:i] = np.where(m >= 0, j - 1 - m, -1)
    hi, page_hi = min(len(a), ei + REACH), min(len(b), ej + REACH + 8)
    if hi > ei and page_hi > ej:
        m = _from_start(a[ei:hi], b[ej:page_hi], False)
        out[ei:hi] = np.where(m >= 0, ej + m, -1)
    return out


def longest_run(matched: np.ndarray, ends: np.ndarray) -> int:
    """The longest run of consecutive item words that align.

    A word aligns if most of it does, or all of it but one letter. A single word that doesn't may stand between words that do
    (it was misread) and counts as printed, as long as most characters of the whole run align.
    """
    hit = np.concatenate([[0], np.cumsum(matched >= 0)])
    begins = np.concatenate([[0], ends[:-1]])
    found, size = hit[ends] - hit[begins], ends - begins
    good = np.flatnonzero((found >= WORD_PART * size) | ((found == size - 1) & (size > 1)))
    best = 0
    for run in np.split(good, np.flatnonzero(np.diff(good) > 2) + 1):
        lo, hi = 0, len(run) - 1
        while lo <= hi and run[hi] - run[lo] + 1 > best:
            a, b = begins[run[lo]], ends[run[hi]]
            if hit[b] - hit[a] >= RUN_PART * (b - a):
                best = int(run[hi] - run[lo] + 1)
            elif found[run[lo]] * size[run[hi]] < found[run[hi]] * size[run[lo]]:  # without the worse one of its ends
                lo += 1
            else:
                hi -= 1
    return best


def _covers(i: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bool:
    """Whether anchors cover enough of any stretch of an item."""
    change = np.zeros(int(hi[-1]) + 1, dtype=np.int64)
    np.add.at(change, np.minimum(i, hi[-1]), 1)
    np.add.at(change, np.minimum(i + n, hi[-1]), -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
    return bool((hit[hi] - hit[lo] >= COVERED * (hi - lo)).any())


def printed_words(a: np.ndarray, ha: np.ndarray, ends: np.ndarray, b: np.ndarray, hb: tuple[np.ndarray, np.ndarray], least_words: int) -> int:
    """The longest run of words of an item on a page. Chains are tried from the best on, as long as one of their score can hold
    enough words."""
    if len(ends) < least_words:
        return 0
    i, j, n = anchors(ha, hb)
    lo, hi = np.concatenate([[0], ends[:-1]])[: len(ends) - least_words + 1], ends[least_words - 1 :]
    worth = WORTH * int((hi - lo).min())
    best = 0
    while best < least_words and len(i) and _covers(i, n, lo, hi):
        chain, score = _chain(i.tolist(), j.tolist(), n.tolist())
        if score < worth:
            break
        if _covers(i[chain], n[chain], lo, hi):
            best = max(best, longest_run(align(a, b, [(int(i[s]), int(j[s]), int(n[s])) for s in chain]), ends))
        rest = np.ones(len(i), dtype=bool)
        rest[chain] = False
        i, j, n = i[rest], j[rest], n[rest]
    return best


def _prepared(items: DataFrame) -> DataFrame:
    """(item_id, stream, ends, seeds, offsets, longs) of items with a text, the first text of an id in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item_id"], b["text"]):
                stream, ends = item_words(text)
                h = windows(codes(stream), SEED)
                at = chosen(h)
                out.append((item, stream, ends, h[at].view(np.int64).tolist(), at.tolist(), long_windows(h).view(np.int64).tolist()))
            yield pd.DataFrame(out, columns=["item_id", "stream", "ends", "seeds", "offsets", "longs"])

    one = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    return one.mapInPandas(run, "item_id long, stream string, ends array<int>, seeds array<long>, offsets array<int>, longs array<long>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of a column ``h`` of hashes: at most MOST_BITS / 64 words reach the driver, whatever the number of items."""
    n = hashes.distinct().count()
    size = 1 << 16
    while size < min(BITS_A_SEED * n, MOST_BITS):
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(64 * len(bits) - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _met(docs: DataFrame, seed_bits: np.ndarray, long_bits: np.ndarray) -> DataFrame:
    """(doc_id, seed, stray): the distinct windows of each page that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast((seed_bits, long_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, longs = shared.value
        for b in batches:
            streams = [page_stream(t, e) if t else "" for t, e in zip(b["text"].to_pylist(), b["edges"].to_pylist())]
            ends = np.cumsum([len(s) for s in streams])
            h = windows(codes("".join(streams)), SEED)
            at = np.flatnonzero(_in(bits, h))
            page = np.searchsorted(ends, at, "right")
            at, page = (x[at + SEED <= ends[page]] for x in (at, page))
            # stretches over the end of a page only make a few seeds look less stray
            long = _in(longs, long_windows(h))
            inside = np.concatenate([np.zeros(2 * STRIDE, dtype=bool), long, np.zeros(2 * STRIDE, dtype=bool)])
            within = inside[at + 2 * STRIDE] | inside[at]
            seed = h[at]
            # one key to sort by: page, most of the seed, whether it strays
            by = np.argsort((page.astype(np.uint64) << np.uint64(40)) | ((seed >> np.uint64(25)) << np.uint64(1)) | (~within).astype(np.uint64))
            page, seed, within = page[by], seed[by], within[by]
            new = np.ones(len(page), dtype=bool)
            new[1:] = (np.diff(page) != 0) | (seed[1:] != seed[:-1])
            yield pa.record_batch([b["doc_id"].take(pa.array(page[new])), pa.array(seed[new].view(np.int64)), pa.array(~within[new])], names=["doc_id", "seed", "stray"])

    return docs.mapInArrow(run, "doc_id long, seed long, stray boolean")


def _rare(met: DataFrame, n_docs: int) -> DataFrame:
    """(seed, bits) of the rare seeds. Pages on which a seed strays count by the square of their part of all pages with it, so
    that worn prints of a passage that many pages hold don't make its seeds common."""
    counts = met.groupBy("seed").agg(F.sum(F.col("stray").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    strays = F.col("s") * F.pow(F.col("s") / F.col("n"), 2)
    return counts.where(strays <= RARE * max(n_docs, 1 / RARE)).select("seed", F.log2(F.lit(float(max(n_docs, 2))) / (1 + strays)).alias("bits"))


def _candidates(met: DataFrame, seeds: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, item_id) of pages with separate, rare seeds of an item."""
    rare = cut(seeds.join(_rare(met, n_docs), "seed"))
    hits = met.select("doc_id", "seed").join(rare, "seed").groupBy("doc_id", "item_id")
    # a sum of all seeds is at least that of the separate ones and spares most pairs the list
    least = LEAST_UNIQUE * float(np.log2(max(n_docs, 2)))
    listed = hits.agg(F.sum("bits").alias("all_bits"), F.array_sort(F.collect_list(F.struct("offset", "bits"))).alias("hits")).where(F.col("all_bits") >= least)
    # seeds that overlap count as one, the first of them
    zero = F.struct(F.lit(-SEED).alias("last"), F.lit(0.0).alias("sum"))
    free = lambda acc, x: x["offset"] >= acc["last"] + SEED
    step = lambda acc, x: F.struct(F.when(free(acc, x), x["offset"]).otherwise(acc["last"]).alias("last"), (acc["sum"] + F.when(free(acc, x), x["bits"]).otherwise(0.0)).alias("sum"))
    return listed.where(F.aggregate("hits", zero, step, lambda acc: acc["sum"]) >= least).select("doc_id", "item_id")


def _verified(pairs: DataFrame, least_words: int) -> DataFrame:
    """``pairs``: doc_id, text, edges, item_id, stream, ends; pages of several items come in a row as far as the join leaves them so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple] = {}
        for b in batches:
            out = []
            last = None
            for doc, text, edges, item, stream, ends in zip(b["doc_id"], b["text"], b["edges"], b["item_id"], b["stream"], b["ends"]):
                if last is None or last[0] != doc or last[1] != text:
                    page = codes(page_stream(text, edges))
                    last = (doc, text, page, sorted_windows(page))
                if item not in known:
                    if len(known) >= 1_000:
                        known.clear()
                    c = codes(stream)
                    known[item] = (c, windows(c, ANCHOR), np.asarray(ends, dtype=np.int64))
                best = printed_words(*known[item], *last[2:], least_words)
                if best >= least_words:
                    out.append((doc, item, best))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"]).astype("int64")

    return pairs.mapInPandas(run, "doc_id long, item_id long, n_words long")


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", edges: str | None = "line_boxes", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words) for every page that holds ``least_words`` consecutive words of an item.

    ``n_words``: the longest run in the best place; once that is enough, further places aren't looked at. ``docs`` needs doc_id
    and ``text``; ``edges`` names an array of boxes with x0, one a line, or is None. ``items`` has item_id and text. Null ids and
    null or empty texts hold nothing. Repeated rows of a page give its rows again, repeated pages each get theirs. Items shorter
    than ``least_words`` words are never found.
    """
    edge = F.transform(F.col(edges), lambda b: b["x0"]) if edges else F.lit(None).cast("array<int>")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), edge.alias("edges"))
    every = cut(_prepared(items).withColumn("content", F.sha2("stream", 256)))
    same = every.select("item_id", "content").withColumnRenamed("item_id", "copy")
    first = every.groupBy("content").agg(F.min("item_id").alias("item_id"))
    searched = every.join(first, ["content", "item_id"], "left_semi").where(F.size("ends") >= least_words)
    seeds = searched.select("item_id", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("offsets").alias("offset")))).groupBy("item_id", "seed").agg(F.min("offset").alias("offset"))
    bitmaps = (_bitmap(seeds.select(F.col("seed").alias("h"))), _bitmap(searched.select(F.explode("longs").alias("h"))))
    met = cut(_met(rows, *bitmaps))
    wanted = cut(_candidates(met, seeds, rows.count()))
    suspects = rows.join(wanted.groupBy("doc_id").agg(F.collect_set("item_id").alias("_items")), "doc_id")
    pairs = suspects.select("doc_id", "text", "edges", F.explode("_items").alias("item_id")).join(searched.select("item_id", "stream", "ends"), "item_id")
    held = cut(_verified(pairs.select("doc_id", "text", "edges", "item_id", "stream", "ends"), least_words))
    copies = same.join(first, "content").select("item_id", "copy")
    return held.join(copies, "item_id").select("doc_id", F.col("copy").alias("item_id"), "n_words")
