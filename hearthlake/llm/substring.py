"""Removal of repeated passages with compressed FM-indexes, one per shard of passages.

A window is ``span`` consecutive words. The words of every window that also starts
in a document with a smaller id go.

An index over a shard of documents would have to see every other document. Here
the passages are dealt instead: a document is cut into runs of windows that have
the same minimizer (the smallest hash of ``GRAM`` words in a window), and a run
goes to the shard of its minimizer. Equal windows have equal minimizers, so a
shard's index only has to answer for the runs dealt to it. Where very many runs
share a minimizer (the edges of a passage that many documents quote), its windows
are dealt one by one, by the hash of all their words:

1. a task cuts its documents into runs; of equal runs it ships the one of the
   smallest id, the others are repeats already. What it ships for a shard is one
   compressed block;
2. a shard merges equal runs in the same way. A window has at least ``SIDE`` words
   before or behind its minimizer; runs that share neither side of it with a
   different run hold no repeats. Over the rest it builds an FM-index: the
   Burrows-Wheeler transform of the word sequence in a wavelet matrix of packed
   bits. All windows are then searched backwards, word by word, for as long as
   they match elsewhere; those that match over the whole span get the smallest
   id in their suffix interval;
3. the intervals of a document meet its text, which travels in compressed blocks
   too, and its words are filtered.

Words are compared as text; hashes only deal runs out and pick those to compare.

The numbers of shards and buckets follow the bytes of the texts, so that what one of
them holds in memory stays alike at every size.

Defined results: a null text has no words; a document shorter than a window
keeps all; a null id counts as greater than every other one; rows that repeat an
id do not remove from each other, nor do rows without one. Rows are told apart by id
and a 64-bit hash of the text, those without an id by 128 bits; rows that agree in
id and text have equal results. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.pieces import PieceHash, blank_words
from hearthlake.session import shuffle_partitions

SPAN, GRAM = 13, 3
SIDE = (SPAN - GRAM) // 2
#: Characters that a task cuts into runs at a time.
BLOCK_CHARS = 8_000_000
#: Shards for each shuffle partition at least, and bytes of text for each shard at most on average; a shard is indexed in memory.
SHARDS_PER_PARTITION, SHARD_BYTES = 16, 4_000_000
#: Runs are weighed on this share of the rows; the windows of a minimizer with at least so many bytes of runs in all rows
#: are dealt one by one. The tasks are told at most so many minimizers, the heaviest ones.
WEIGHED, HOT_BYTES, HOT_MINIMIZERS = 1 / 64, 4_000_000, 1 << 18
KEY = ["none", "doc", "tag"]  # of a row: whether it has no id, then the id and a hash of the text, or two hashes


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def grams(hashes: np.ndarray, count: int) -> np.ndarray:
    """Hash of each ``count`` neighbours of a sequence of word hashes."""
    n = max(0, len(hashes) - count + 1)
    g = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(count):
            g = (g ^ hashes[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    return g


def minimizers(hashes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """Minimizer of each window of a sequence of word hashes."""
    return sliding_min(grams(hashes, gram), span - gram + 1)


def cut_runs(hashes: np.ndarray, bounds: np.ndarray, span: int = SPAN, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: document, first word, words, minimizer; bounds: first word of each document, and the end.

    ``hot``: minimizers in ascending order that are not dealt as one; in their windows the hash of all words stands in their place.
    """
    empty = np.zeros(0, dtype=np.int64)
    if len(hashes) < span:
        return empty, empty, empty, empty.astype(np.uint64)
    least = minimizers(hashes, span)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    windows = np.flatnonzero(owner[: len(least)] == owner[span - 1 : span - 1 + len(least)])
    if not windows.size:
        return empty, empty, empty, empty.astype(np.uint64)
    value = least[windows]
    if hot is not None and len(hot):
        split = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value)
        value[split] = grams(hashes, span)[windows[split]]
    fresh = np.r_[True, (value[1:] != value[:-1]) | (windows[1:] != windows[:-1] + 1)]
    first = np.flatnonzero(fresh)
    count = np.diff(np.r_[first, len(windows)])
    start = windows[first]
    return owner[start], start, count + span - 1, value[first]


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def _unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _order(none: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the ids in their order, from 0 on; rows without one share the last place."""
    ids, place = np.unique(doc[~none], return_inverse=True)
    out = np.full(len(doc), len(ids), dtype=np.int64)
    out[~none] = place
    return out


def _smallest(texts: list[bytes], hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The first place among those of equal texts, for each text."""
    least = docs.copy()
    _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[group] > 1)
    found: dict[bytes, int] = {}
    mine = [texts[i] for i in several.tolist()]
    for r, d in zip(mine, docs[several].tolist(), strict=True):
        if d <= found.get(r, d):
            found[r] = d
    least[several] = [found[r] for r in mine]
    return least


def _numbers(texts: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """A number for each distinct text, 0 and on, in no special order."""
    values, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    if all(texts[i] == texts[first[group[i]]] for i in np.flatnonzero(np.bincount(group)[group] > 1).tolist()):
        return group
    number: dict[bytes, int] = {}  # two texts share a hash
    return np.array([number.setdefault(t, len(number)) for t in texts])


def _words(texts: list) -> tuple[np.ndarray, ...]:
    """Bytes of the texts one after the other, first and last byte of each word, and the first word of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    starts, ends = blank_words(flat)
    return flat, starts, ends, np.r_[0, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))]


def _ship(keys: np.ndarray, texts: list, shards: int, span: int, hot: np.ndarray) -> pd.DataFrame:
    """Blocks (shard, block) of the runs of some documents."""
    flat, starts, ends, bounds = _words(texts)
    owner, start, size, value = cut_runs(PieceHash(flat)(starts, ends), bounds, span, hot)
    # The words again, one blank apart.
    length = ends - starts
    begins = np.cumsum(length + 1) - length - 1
    spaced = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
    word = np.ones(len(spaced), dtype=bool)
    word[begins + length] = False
    inside = np.zeros(len(flat) + 1, dtype=np.int8)
    inside[starts], inside[ends] = 1, -1
    spaced[word] = flat[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    joined = spaced.tobytes()
    first, last = begins[start], begins[start + size - 1] + length[start + size - 1]
    runs = [joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    rank = _order(keys[:, 0] > 0, keys[:, 1])[owner]
    at = start - bounds[owner]
    own = _smallest(runs, PieceHash(spaced)(first, last), rank) == rank
    shard = (value % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((rank, ~own, shard))
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = order[a:b]
        n = int(own[mine].sum())
        ship, rest = mine[:n], mine[n:]
        none, doc, tag = keys[owner[ship]].T
        block = {
            "runs": b"\n".join([runs[i] for i in ship.tolist()]), "none": none.astype(bool), "doc": np.diff(doc, prepend=0), "tag": tag, "at": at[ship].astype(np.int32),
            "repeats": (keys[owner[rest]], at[rest].astype(np.int32), size[rest].astype(np.int32)),
        }
        rows.append((int(shard[mine[0]]), _pack(block)))
    return pd.DataFrame(rows, columns=["shard", "block"])


class WaveletMatrix:
    """Counts of a symbol before a position, over packed bits; one level per bit of a symbol."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.bits, self.before, self.zeros = [], [], []
        level = symbols
        for b in range(self.levels - 1, -1, -1):
            bit = (level >> b) & 1
            packed = np.packbits(np.r_[bit.astype(np.uint8), np.zeros(-len(bit) % 64 + 64, dtype=np.uint8)], bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.start = self._walk(np.arange(1 << self.levels), np.zeros(1 << self.levels, dtype=np.int64)) if self.levels <= 24 else None

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word].astype(np.int64) + np.bitwise_count(self.bits[level][word] & mask)

    def _walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, i)
            i = np.where((symbols >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = self.start[symbols] if self.start is not None else self._walk(symbols, np.zeros_like(i))
        return self._walk(symbols, i) - start


class FMIndex:
    """Index of a sequence of word numbers for patterns of up to ``span`` words."""

    def __init__(self, sequence: np.ndarray, span: int):
        self.sequence, self.span = sequence, span
        self.suffixes = self._sorted(sequence, span).astype(np.int32)  # a shard holds far fewer words than 2^31
        self.wavelet = WaveletMatrix(sequence[self.suffixes - 1])  # what stands before each suffix
        self.below = np.r_[0, np.cumsum(np.bincount(sequence))]

    @staticmethod
    def _sorted(sequence: np.ndarray, span: int) -> np.ndarray:
        """Suffixes in the order of their first ``span`` words, by doubling ranks."""
        n = len(sequence)
        rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
        have = 1
        while have < span:
            step = min(have, span - have)
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            have += step
        return np.argsort(rank, kind="stable")

    def match(self, ends: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``span`` words up to each position.

        Returns how many words matched in ``least`` places before the search gave
        up, and the suffix interval of what matched over the whole span.
        """
        length = np.zeros(len(ends), dtype=np.int64)
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), len(self.sequence), dtype=np.int64)
        alive = np.arange(len(ends))
        for step in range(self.span):
            symbol = self.sequence[ends[alive] - step]
            a = self.below[symbol] + self.wavelet.rank(symbol, low[alive])
            b = self.below[symbol] + self.wavelet.rank(symbol, high[alive])
            on = b - a >= least
            alive = alive[on]
            low[alive], high[alive] = a[on], b[on]
            length[alive] = step + 1
            if not alive.size:
                break
        return length, low, high


def repeated_windows(runs: list[bytes], docs: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each run which of its windows also start in a run of a smaller document."""
    number: dict[bytes, int] = {}
    flat: list[int] = []
    sizes = []
    for r in runs:
        w = r.split(b" ")
        flat += [number.setdefault(x, len(number) + 1) for x in w]
        flat.append(0)  # between runs
        sizes.append(len(w))
    sequence = np.array(flat, dtype=np.int64)
    size = np.array(sizes)
    first = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(runs)), size + 1)
    index = FMIndex(sequence, span)
    per_run = size - span + 1
    begin = np.repeat(first - (np.cumsum(per_run) - per_run), per_run) + np.arange(per_run.sum())
    length, low, high = index.match(begin + span - 1)
    whole = np.flatnonzero(length == span)
    removed = np.zeros(len(begin), dtype=bool)
    if whole.size:
        intervals, which = np.unique(low[whole], return_inverse=True)
        upper = np.zeros(len(intervals), dtype=np.int64)
        upper[which] = high[whole]
        ids = np.r_[docs[owner[index.suffixes]], np.iinfo(np.int64).max]
        edges = np.stack([intervals, upper], axis=1).reshape(-1)
        smallest = np.minimum.reduceat(ids, edges)[0::2]
        removed[whole] = smallest[which] < docs[owner[begin[whole]]]
    return np.split(removed, np.cumsum(per_run)[:-1])


def _shared(hashes: np.ndarray, bounds: np.ndarray, span: int) -> np.ndarray:
    """Runs that share with a different one the minimizer and what stands before or behind it."""
    size = np.diff(bounds)
    run_of = np.repeat(np.arange(len(size)), size)
    gram = grams(hashes, GRAM)
    inside = run_of[: len(gram)] == run_of[GRAM - 1 : GRAM - 1 + len(gram)]
    gram = np.where(inside, gram, np.uint64(2**64 - 1))
    # The minimizer of a run's windows is the smallest of all its grams that lie in every window.
    first_window, last_window = bounds[:-1], bounds[1:] - span
    middle = sliding_min(gram, span - GRAM + 1)
    least = middle[first_window]
    spot = np.flatnonzero((gram == least[run_of[: len(gram)]]) & inside)
    side = (span - GRAM) // 2
    wide = grams(hashes, GRAM + side)
    out = np.zeros(len(size), dtype=bool)
    for shift in (0, side):  # behind it, before it
        at = spot - shift
        run = run_of[spot]
        fits = (at >= bounds[run]) & (at + GRAM + side <= bounds[run + 1])
        key, run = wide[at[fits]], run[fits]
        order = np.lexsort((run, key))
        key, run = key[order], run[order]
        twins = np.flatnonzero((key[1:] == key[:-1]) & (run[1:] != run[:-1]))
        out[run[twins]] = out[run[twins + 1]] = True
    return np.flatnonzero(out)


def _answer(blocks: pd.Series, span: int) -> pd.DataFrame:
    """Removed passages (key, first, last) of the runs of a shard; last is exclusive."""
    out, parts, keys, at = [], [], [], []

    def hit(k, a, b) -> None:
        out.append(np.c_[k, a, b].astype(np.int64, copy=False))

    for block in map(_unpack, blocks):
        k, a, n = block["repeats"]
        hit(k, a.astype(np.int64), a.astype(np.int64) + n)
        if len(block["doc"]):
            parts.append(block["runs"])
            keys.append(np.stack([block["none"].astype(np.int64), np.cumsum(block["doc"]), block["tag"]], axis=1))
            at.append(block["at"].astype(np.int64))
    if parts:
        keys, at = np.concatenate(keys), np.concatenate(at)
        doc = _order(keys[:, 0] > 0, keys[:, 1])
        joined = b"\n".join(parts) + b"\n"
        runs = joined[:-1].split(b"\n")
        flat = np.frombuffer(joined, dtype=np.uint8)
        ends_of_run = np.flatnonzero(flat == 10)
        begins_of_run = np.r_[0, ends_of_run[:-1] + 1]
        starts, ends = blank_words(flat)
        bounds = np.r_[0, np.searchsorted(starts, ends_of_run)]
        piece = PieceHash(flat)
        hashes = piece(begins_of_run, ends_of_run)
        own = _smallest(runs, hashes, doc) == doc
        hit(keys[~own], at[~own], at[~own] + np.diff(bounds)[~own])
        # One run of each text stands for all of that text and document.
        kept = np.flatnonzero(own)
        text_of = _numbers([runs[i] for i in kept.tolist()], hashes[kept])
        alone = kept[np.unique(text_of, return_index=True)[1]]
        words = np.concatenate([np.zeros(0, dtype=np.int64), _ranges(bounds[alone], bounds[alone + 1])])
        size = np.diff(bounds)[alone]
        asked = _shared(piece(starts[words], ends[words]), np.r_[0, np.cumsum(size)], span)
        if asked.size:
            removed = repeated_windows([runs[alone[i]] for i in asked.tolist()], doc[alone][asked], span)
            spans: dict[int, np.ndarray] = {}
            for i, mask in zip(asked.tolist(), removed, strict=True):
                if mask.any():
                    step = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
                    spans[i] = np.stack([step[0::2], step[1::2] + span - 1], axis=1)
            for k in np.flatnonzero(np.isin(text_of, list(spans))).tolist():
                s, r = spans[int(text_of[k])], kept[k]
                hit(np.tile(keys[r], (len(s), 1)), s[:, 0] + at[r], s[:, 1] + at[r])
    rows = np.concatenate(out) if out else np.zeros((0, 5), dtype=np.int64)
    return pd.DataFrame(rows, columns=[*KEY, "first", "last"])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, last), one range after the other."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (none, doc, tag, text)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    none, two = F.col("id").isNull(), [F.xxhash64(F.lit(k), "text") for k in (1, 2)]
    return narrow.select(none.cast("long").alias("none"), F.coalesce("id", two[0]).alias("doc"), two[1].alias("tag"), "text")


def _parts(docs: DataFrame, text_col: str) -> int:
    """How many shards, or buckets, the texts are dealt to."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(SHARDS_PER_PARTITION * shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES))


def hot_minimizers(docs: DataFrame, span: int = SPAN, text_col: str = "text", weighed: float = WEIGHED, least: int = HOT_BYTES) -> np.ndarray:
    """Minimizers with so many bytes of runs that they are not dealt as one, in ascending order.

    The share of rows only estimates where a minimizer's windows go; what is found does not depend on it.
    """

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _blocks(batches):
            flat, starts, ends, bounds = _words(some.text.tolist())
            _, start, size, value = cut_runs(PieceHash(flat)(starts, ends), bounds, span)
            values, which = np.unique(value, return_inverse=True)
            weight = np.bincount(which, weights=ends[start + size - 1] - starts[start], minlength=len(values))
            yield pd.DataFrame({"value": values.view(np.int64), "weight": weight.astype(np.int64)})

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = rows.sample(weighed, seed=SPAN) if weighed < 1 else rows
    weights = rows.mapInPandas(weigh, "value long, weight long").groupBy("value").agg(F.sum("weight").alias("weight"))
    heavy = weights.filter(F.col("weight") >= least * weighed).orderBy(F.desc("weight"), "value").limit(HOT_MINIMIZERS)
    return np.sort(heavy.toPandas().value.to_numpy(dtype=np.int64).view(np.uint64))


def repeated_passages(
    docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, weighed: float = WEIGHED, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """Rows (none, doc, tag, first, last): words of a document that windows of smaller documents cover."""
    shards = shards or _parts(docs, text_col)
    hot = hot_minimizers(docs, span, text_col, weighed, hot_bytes)

    def ship(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _blocks(batches):
            yield _ship(some[KEY].to_numpy(dtype=np.int64), some.text.tolist(), shards, span, hot)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        return _answer(group.block, span)

    blocks = _keyed(docs, id_col, text_col).mapInPandas(ship, "shard long, block binary")
    return blocks.groupBy("shard").applyInPandas(answer, "none long, doc long, tag long, first long, last long")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of so many characters at a time as memory is meant to hold."""
    for rows in batches:
        parts = np.cumsum([len(t) if isinstance(t, str) else 0 for t in rows.text]) // BLOCK_CHARS
        for p in np.unique(parts):
            yield rows[parts == p]


def _keep(words: list[bytes], first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The words that no passage covers."""
    if not len(first):
        return words
    cover = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(cover, first, 1)
    np.add.at(cover, last, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", weighed: float = WEIGHED, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_text (kept words joined by one space)."""
    buckets = _parts(docs, text_col)
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _blocks(batches):
            packed = [(b, _pack((g[KEY].to_numpy(dtype=np.int64), g.text.tolist()))) for b, g in some.groupby("bucket")]
            yield pd.DataFrame(packed, columns=["bucket", "block"])

    def cut(texts: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        hits = passages[[*KEY, "first", "last"]].to_numpy(dtype=np.int64)
        hits = hits[np.lexsort(hits[:, :3].T)]
        edge = np.flatnonzero(np.r_[True, (hits[1:, :3] != hits[:-1, :3]).any(axis=1), True]) if len(hits) else np.zeros(1, dtype=np.int64)
        of = {tuple(hits[a, :3].tolist()): (a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}
        out = []
        for key, t in ((k, t) for block in texts.block for k, t in zip(*_unpack(block), strict=True)):
            words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []  # bytes split at the six ASCII blanks only
            a, b = of.get(tuple(key.tolist()), (0, 0))
            kept = _keep(words, hits[a:b, 3], hits[a:b, 4])
            out.append((int(key[0]), int(key[1]), len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["none", "doc", "n_words", "n_removed", "kept_text"])

    texts = _keyed(docs, id_col, text_col).select(*KEY, "text", bucket).mapInPandas(pack, "bucket long, block binary")
    passages = repeated_passages(docs, span, id_col, text_col, buckets, weighed, hot_bytes).select(bucket, *KEY, "first", "last")
    met = texts.groupBy("bucket").cogroup(passages.groupBy("bucket")).applyInPandas(cut, "none long, doc long, n_words long, n_removed long, kept_text string")
    return met.select(F.when(F.col("none") == 0, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_text")
