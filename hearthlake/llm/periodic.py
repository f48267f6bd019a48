"""Runs: stretches of words that repeat with a period, by the runs theorem.

Every maximal repetition with least period p holds a Lyndon word of length p that
is, under an order of the words or its reverse, the longest Lyndon word at its
place. So for both orders:

1. suffixes are sorted (prefix doubling, only what is not yet told apart);
2. the longest Lyndon word at a place ends before the next smaller value of the
   inverse suffix array, found by binary descent over its sparse minimum table;
3. two equal stretches a period apart are extended to the right, and on the
   reversed words to the left, by the minimum of the LCP array between their
   ranks, which a sparse table answers at once.

What is as long as two periods is a run. Many documents are one array: every
document has words of its own and ends in a sign smaller than all words, so no
suffix of one is ever like another's, and the work per document is a few numpy
steps whatever their number. A batch holds ``BATCH_WORDS`` words, or one longer
document: about 200 bytes a word and 8 more for each doubling of its words. Sorting
takes as many rounds as the logarithm of the longest repeat.

Defined results: null and blank texts have no words and no runs; repeated rows
repeat their result; a null id stays; an empty table gives no rows; columns
besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 1 << 18
#: Fewest words of a run, whatever its period.
LEAST = 12


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Inverse suffix array, and the ranks by the first 1, 2, 4, ... symbols on the way to it.

    Ranks of a round are places of the first equal one, so places that are alone in
    theirs are settled and only the others are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    alike = np.r_[False, ordered[1:] == ordered[:-1]]
    open_ = order[alike | np.r_[alike[1:], False]]  # in the order of their ranks
    while open_.size:
        after = open_ + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[open_]
        turn = np.lexsort((second, first))
        open_, first, second = open_[turn], first[turn], second[turn]
        head = np.r_[True, first[1:] != first[:-1]]
        fresh = head | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(open_.size)
        group = np.maximum.accumulate(np.where(head, at, 0))
        own = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[open_] = first + own - group
        levels.append(rank.astype(np.int32))
        alone = fresh & np.r_[fresh[1:], True]
        open_ = open_[~alone]
        step *= 2
    return rank, levels


def neighbour_lcp(rank: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the order, by place in the order."""
    n = len(rank)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(n, dtype=np.int32)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        ok = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        length[ok + 1] += 1 << k
        a[ok] += 1 << k
        b[ok] += 1 << k
    return length


class Minima:
    """Sparse table of minima over stretches of 1, 2, 4, ... places."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int32)]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of the places a..b of each pair, a <= b."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.rows[k][a[i]], self.rows[k][b[i] - (1 << k) + 1])
        return out

    def next_smaller(self) -> np.ndarray:
        """For each place the next one with a smaller value, or the number of places."""
        own = self.rows[0]
        at = np.arange(1, len(own) + 1)
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = np.flatnonzero(at < len(row))
            fits = fits[row[at[fits]] > own[fits]]
            at[fits] += 1 << k
        return at


class Extension:
    """Length of the longest common extension of any two places to the right."""

    def __init__(self, rank: np.ndarray, levels: list[np.ndarray]):
        self.rank, self.least = rank, Minima(neighbour_lcp(rank, levels))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least.between(np.minimum(a, b) + 1, np.maximum(a, b))


def find_runs(words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least ``least`` words, sorted by start and period.

    words: numbers from 1 of the words of all documents, each document followed by a 0;
    starts: where the documents begin. Starts are places in ``words``.
    """
    n = len(words)
    owner = np.zeros(n, dtype=np.int64)
    owner[starts] = 1
    owner = np.cumsum(owner)
    span = int(words.max()) + 2 if n else 2
    found = [np.zeros((0, 3), dtype=np.int64)]
    right = left = None
    for turned in (False, True):
        symbols = owner * span + np.where(words == 0, 0, span - words if turned else words)
        rank, levels = suffix_order(symbols)
        if right is None:
            right = Extension(rank, levels)
            left = Extension(*suffix_order(symbols[::-1].copy()))
        del levels
        at = np.flatnonzero(words > 0)
        period = Minima(rank).next_smaller()[at] - at
        then = at + period
        fits = then < n
        at, period, then = at[fits], period[fits], then[fits]
        fits = owner[at] == owner[then]
        at, period, then = at[fits], period[fits], then[fits]
        after = right(at, then)
        # To the left only where the words before both places are the same.
        before = np.zeros(len(at), dtype=np.int64)
        some = np.flatnonzero((at > 0) & (words[np.maximum(at - 1, 0)] == words[np.maximum(then - 1, 0)]))
        before[some] = left(n - at[some], n - then[some])
        length = before + period + after
        keep = length >= np.maximum(least, 2 * period)
        found.append(np.stack([at - before, length, period], axis=1)[keep])
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _judge(texts: list[list[bytes]], least: int) -> tuple[list[np.ndarray], list[str]]:
    """Runs (start, length, period) and what is left of the words of each document."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(size + 1)[:-1]]
    codes = np.zeros(int((size + 1).sum()), dtype=np.int64)
    inner = np.ones(len(codes), dtype=bool)
    inner[starts + size] = False
    flat = [w for t in texts for w in t]
    if flat:
        codes[inner] = pd.factorize(np.array(flat, dtype=object))[0] + 1
    start, length, period = find_runs(codes, starts, least)
    document = np.searchsorted(starts, start, side="right") - 1
    change = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs, kept = [], []
    edges = np.searchsorted(document, np.arange(len(texts) + 1))
    for d, words in enumerate(texts):
        a, b = edges[d], edges[d + 1]
        runs.append(np.stack([start[a:b] - starts[d], length[a:b], period[a:b]], axis=1))
        if a < b:
            out = gone[starts[d] : starts[d] + size[d]].tolist()
            words = [w for w, x in zip(words, out, strict=True) if not x]
        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return runs, kept


def collapse_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start and period) and kept_text.

    Kept are the words that no run holds after its first period, joined by one blank.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs, kept = _judge(texts, least)
        ends = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
        flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *runs])
        values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(item))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(kept, pa.string())], names=["doc_id", "runs", "kept_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for rows in batches:
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII blanks only
                if ids and n + len(words) > batch_words:
                    yield batch(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(words)
                n += len(words) + 1
        if ids:
            yield batch(ids, texts)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept_text string")
