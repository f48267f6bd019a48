"""N-best SentencePiece segmentation, and decoding.

A text becomes a lattice of pieces: blanks turn into U+2581, one more goes in
front, and every vocabulary piece that matches is an edge with the piece's
score; a character without a piece of its own is spelled in byte pieces that
together score ten below the worst piece (one with a prohibitive score aside). The best path is the segmentation.

No piece crosses the beginning of a run of U+2581 or touches certain control
characters, so a text is a chain of small lattices ("chunks") and most chunks
occur again and again. For the distinct chunks of many texts at once, a forward
Viterbi pass gives the best score of every prefix, and the score of the second
best path; a worker keeps what it found for the next texts. Chunks are told apart
by hashes; the bytes of all pieces found are compared with those of the texts, and
texts that differ, because two chunks share a hash, are segmented again by the
bytes of their chunks. An n-best list can only change the ``n - 1`` chunks of a text whose
second best path costs least. Over the lattice of those chunks a backward A-star
search, with the forward scores as exact heuristic, takes the paths in falling
order of score without ever expanding one that is not needed. Every open path can be
finished at the score it is queued with, so only the first n open ones are kept,
and among equals the one opened last goes first: the search takes n steps a piece
however many paths are equally good. A chunk of over ``LONG_CHUNK`` bytes, such as a
text without blanks, is gone through on its own, in time in proportion to its length.

The model file must be of the BPE or unigram kind with byte fallback and without
a normalisation table; its scores are used as they are. For a BPE model the best
path is the one of the greatest total score, not the result of its merge order.

Defined results: null and empty texts have the empty segmentation with score 0;
texts with fewer than n segmentations have shorter lists; equal scores are taken
with the longer last piece first; decoding gives the text back exactly, but for
U+2581 in it, which comes back as a blank; ids outside the vocabulary raise an
error; repeated rows and further columns stay as they are, but those named like a
column of the result are replaced by it.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearthlake.llm.pieces import PieceHash
from hearthlake.llm.workers import give_back, lean

#: Where the tokenizer files lie on every machine by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
BLOCK_CHARS = 1_000_000
#: Chunks, piece ids in them, and n-best lists that a worker keeps; then it begins anew.
KEPT_CHUNKS, KEPT_IDS, KEPT_PATHS = 600_000, 10_000_000, 10_000
#: Bytes of a chunk beyond which it is gone through on its own, place by place; places at a time.
LONG_CHUNK, LONG_BLOCK = 384, 1 << 16
ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("others", T.ArrayType(T.ArrayType(T.IntegerType())))])


class Chunks:
    """Best segmentations of chunks by their hash."""

    def __init__(self):
        self.hashes, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted, and where the rest lies
        self.score, self.gap, self.count = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)
        self.first, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.row[place], -1)

    def add(self, hashes: np.ndarray, score: np.ndarray, gap: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        row = np.r_[self.row, len(self.score) + np.arange(len(hashes))]
        self.hashes = np.r_[self.hashes, hashes]
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.row = self.hashes[order], row[order]
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(count) - count]
        self.score, self.gap, self.count, self.ids = np.r_[self.score, score], np.r_[self.gap, gap], np.r_[self.count, count], np.r_[self.ids, ids]


class Pieces:
    """The vocabulary of a model file, ready for lookups."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = np.full(256, -1, dtype=np.int32)
        self.edge: dict[bytes, tuple[int, float]] = {}
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = model.id_to_piece(i).encode()
                self.edge[self.bytes_of[i]] = (i, model.get_score(i))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        self.unknown = min(s for _, s in self.edge.values() if s > -1e8) - 10  # runs of blanks have a prohibitive score
        keys = list(self.edge)
        flat = np.frombuffer(b"".join(keys), dtype=np.uint8)
        last = np.cumsum([len(k) for k in keys])
        hashes = PieceHash(flat)(last - [len(k) for k in keys], last)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([self.edge[keys[i]][0] for i in order], dtype=np.int32)
        self.scores = np.array([self.edge[keys[i]][1] for i in order])
        self.lengths = sorted({len(k) for k in keys})
        self.maybe = np.zeros(1 << 21, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(43)).astype(np.int64)] = True
        # Which beginnings pieces have, and how long pieces with such a beginning get: up to five bytes, and beyond.
        self.beginnings = []
        for width, top in ((3, 5), (6, 1 << 15)):
            longest: dict[bytes, int] = {}
            for k in keys:
                if width <= len(k) <= top:
                    longest[k[:width]] = max(longest.get(k[:width], 0), len(k))
            flat = np.frombuffer(b"".join(longest), dtype=np.uint8)
            at = np.arange(len(longest)) * width
            hashed = PieceHash(flat)(at, at + width)
            into = np.argsort(hashed)
            self.beginnings.append((width, hashed[into], np.array(list(longest.values()), dtype=np.int16)[into]))
        self.paths: dict[tuple, list] = {}
        self.chunks = Chunks()
        used = set().union(*keys)
        self.apart = np.zeros(256, dtype=bool)  # single bytes that no piece contains
        self.apart[[b for b in range(128) if b not in used]] = True
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of])
        self.first = np.cumsum(self.size) - self.size

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all pieces, one after the other."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.first[ids] - (end - size), size) + np.arange(int(size.sum()))]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes belong to pieces, and where in the sorted table."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(43)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        ok = self.hashes[place] == hashes[at]
        return at[ok], place[ok]

    def reach(self, piece: PieceHash, size: int) -> list[np.ndarray]:
        """For each place of a buffer, how long pieces that begin there may get: below six bytes, and beyond."""
        out = []
        for width, hashed, longest in self.beginnings:
            far = np.zeros(size, dtype=np.int16)
            at = np.arange(max(0, size - width + 1))
            h = piece(at, at + width)
            place = np.minimum(np.searchsorted(hashed, h), len(hashed) - 1)
            far[at] = np.where(hashed[place] == h, longest[place], 0)
            out.append(far)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def escaped(text: str) -> bytes:
    """The bytes of the lattice of a text."""
    return (" " + text).encode("utf-8", "surrogatepass").replace(b" ", MARK) if text else b""


def _char_sizes(flat: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts at each place; 0 inside a character."""
    return np.where(flat < 0x80, 1, np.where(flat < 0xC0, 0, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4))))


def chunk_starts(flat: np.ndarray, text_starts: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Where chunks begin in the lattices' bytes of some texts, one after the other."""
    cut = np.zeros(len(flat) + 1, dtype=bool)
    mark = np.zeros(len(flat), dtype=bool)
    mark[:-2] = (flat[:-2] == MARK[0]) & (flat[1:-1] == MARK[1]) & (flat[2:] == MARK[2])
    before = np.zeros(len(flat), dtype=bool)
    before[3:] = mark[:-3]
    cut[:-1] = mark & ~before
    alone = np.flatnonzero(apart[flat])
    cut[alone] = cut[alone + 1] = True
    cut[text_starts] = True
    return np.flatnonzero(cut[:-1])


def viterbi(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentation of every chunk by a forward pass over all of them.

    Returns the best score, the gap to the second best path (infinite if there is
    none), all piece ids one chunk after the other, and how many each chunk has.
    """
    order = np.argsort(starts - ends, kind="stable")  # longest first
    start, size = starts[order], (ends - starts)[order]
    piece = PieceHash(flat)
    best, second = np.full(len(flat) + 1, -np.inf), np.full(len(flat) + 1, -np.inf)
    back, via = np.zeros(len(flat) + 1, dtype=np.int16), np.zeros(len(flat) + 1, dtype=np.int32)
    short, long = pieces.reach(piece, len(flat))
    # Bytes of characters that have no piece of their own.
    chars = np.flatnonzero(_char_sizes(flat))
    width = np.diff(np.r_[chars, len(flat)])
    covered = np.zeros(len(chars), dtype=bool)
    covered[pieces.lookup(piece(chars, chars + width))[0]] = True
    spelled = np.repeat(np.where(covered, 0.0, pieces.unknown / width), width)
    # Positions are those of the chunk's bytes, so the end of a chunk is kept apart from the start of the next one.
    finish = {k: np.full(len(start), v) for k, v in (("best", -np.inf), ("second", -np.inf), ("back", 0), ("via", 0))}
    best[start] = 0.0
    shorter = -size
    for o in range(1, int(size[0]) + 1 if len(size) else 0):
        k = int(np.searchsorted(shorter, -o, side="right"))  # chunks at least this long
        e = start[:k] + o
        b1, b2 = np.full(k, -np.inf), np.full(k, -np.inf)
        bl, bi = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)

        def offer(at: np.ndarray, source: np.ndarray, score: np.ndarray, length: int, ids: np.ndarray) -> None:
            x1, x2 = best[source] + score, second[source] + score
            new = x1 > b1[at]
            b2[at] = np.maximum(np.where(new, np.maximum(b1[at], x2), np.maximum(b2[at], x1)), -np.inf)
            win = at[new]
            b1[win], bl[win], bi[win] = x1[new], length, ids[new]

        for length in reversed([x for x in pieces.lengths if x <= o]):
            source = e - length
            may = best[source] > -np.inf
            if length > 2:
                may &= (short if length < 6 else long)[source] >= length
            may = np.flatnonzero(may)
            if not may.size:
                continue
            hit, place = pieces.lookup(piece(source[may], e[may]))
            if hit.size:
                hit = may[hit]
                offer(hit, e[hit] - length, pieces.scores[place], length, pieces.ids[place])
        spell = np.flatnonzero(spelled[e - 1] < 0)
        if spell.size:
            offer(spell, e[spell] - 1, spelled[e[spell] - 1], 1, pieces.byte_id[flat[e[spell] - 1]])
        done = int(np.searchsorted(shorter, -o, side="left"))  # chunks from here to k end at this place
        for name, x in (("best", b1), ("second", b2), ("back", bl), ("via", bi)):
            finish[name][done:k] = x[done:]
        best[e[:done]], second[e[:done]], back[e[:done]], via[e[:done]] = b1[:done], b2[:done], bl[:done], bi[:done]
    # Back along all chunks at once.
    at, last = start + size, np.ones(len(start), dtype=bool)
    owners, ids = [], []
    live = np.arange(len(start))
    while live.size:
        length = np.where(last[live], finish["back"][live], back[at[live]]).astype(np.int64)
        ids.append(np.where(last[live], finish["via"][live], via[at[live]]).astype(np.int32))
        owners.append(live)
        at[live] -= length
        last[live] = False
        live = live[at[live] > start[live]]
    owner = np.concatenate(owners[::-1]) if owners else np.zeros(0, dtype=np.int64)
    flat_ids = np.concatenate(ids[::-1]) if ids else np.zeros(0, dtype=np.int32)
    chunk = order[owner]
    into = np.argsort(chunk, kind="stable")
    score, gap = np.zeros(len(start)), np.zeros(len(start))
    score[order], gap[order] = finish["best"], finish["best"] - finish["second"]
    return score, gap, flat_ids[into], np.bincount(chunk, minlength=len(start))


def long_edges(flat: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All edges of a chunk's lattice by their end, longest first: offsets by end, starts, ids, scores."""
    piece = PieceHash(flat)
    short, long = pieces.reach(piece, len(flat))
    starts, lengths, ids, scores = [], [], [], []
    for length in pieces.lengths:
        at = np.arange(len(flat) - length + 1)
        if length > 2:
            at = at[(short if length < 6 else long)[at] >= length]
        hit, place = pieces.lookup(piece(at, at + length)) if at.size else (at, at)
        starts.append(at[hit])
        lengths.append(np.full(len(hit), length))
        ids.append(pieces.ids[place])
        scores.append(pieces.scores[place])
    # Bytes of characters that have no piece of their own.
    chars = np.flatnonzero(_char_sizes(flat))
    width = np.diff(np.r_[chars, len(flat)])
    covered = np.zeros(len(chars), dtype=bool)
    covered[pieces.lookup(piece(chars, chars + width))[0]] = True
    alone = np.flatnonzero(np.repeat(~covered, width))
    starts.append(alone)
    lengths.append(np.ones(len(alone), dtype=np.int64))
    ids.append(pieces.byte_id[flat[alone]])
    scores.append(pieces.unknown / np.repeat(width, width)[alone])
    start, length = np.concatenate(starts), np.concatenate(lengths)
    end = start + length
    order = np.lexsort((-length, end))  # a spelled byte comes after a piece of its own length, as it was added last
    offsets = np.searchsorted(end[order], np.arange(len(flat) + 2))
    return offsets, start[order], np.concatenate(ids)[order].astype(np.int64), np.concatenate(scores)[order]


def long_viterbi(flat: np.ndarray, pieces: Pieces) -> tuple[float, float, np.ndarray]:
    """Best score of one long chunk, the gap to the second best path, and the ids of the best."""
    offsets, start, ids, scores = long_edges(flat, pieces)
    n, none = len(flat), -np.inf
    best, second = [0.0], [none]
    via = np.zeros(n + 1, dtype=np.int64)
    for a in range(1, n + 1, LONG_BLOCK):
        b = min(a + LONG_BLOCK, n + 1)
        low = int(offsets[a])
        at = (offsets[a : b + 1] - low).tolist()
        source, score = start[low : offsets[b]].tolist(), scores[low : offsets[b]].tolist()
        for e in range(b - a):
            b1, b2, edge = none, none, -1
            for k in range(at[e], at[e + 1]):
                x = best[source[k]] + score[k]
                if x > b1:
                    b2 = max(b1, second[source[k]] + score[k])
                    b1, edge = x, k
                elif x > b2:
                    b2 = x
            best.append(b1)
            second.append(b2)
            via[a + e] = low + edge
    path, e = [], n
    while e:
        path.append(ids[via[e]])
        e = int(start[via[e]])
    return best[n], best[n] - second[n], np.array(path[::-1], dtype=np.int32)


def best_of_chunks(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``viterbi`` over the chunks, of which long ones are gone through one by one."""
    size = ends - starts
    large = size > LONG_CHUNK
    if not large.any():
        return viterbi(flat, starts, ends, pieces)
    few = np.flatnonzero(~large)
    end = np.cumsum(size[few])
    begin = end - size[few]
    own = flat[np.repeat(starts[few] - begin, size[few]) + np.arange(int(size[few].sum()))]
    score, gap, count = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), dtype=np.int64)
    parts: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(size)
    if few.size:
        score[few], gap[few], ids, count[few] = viterbi(own, begin, end, pieces)
        for i, part in zip(few.tolist(), np.split(ids, np.cumsum(count[few])[:-1]), strict=True):
            parts[i] = part
    for i in np.flatnonzero(large).tolist():
        score[i], gap[i], parts[i] = long_viterbi(flat[starts[i] : ends[i]], pieces)
        count[i] = len(parts[i])
    return score, gap, np.concatenate(parts), count


def lattice(chunk: bytes, pieces: Pieces) -> list[list[tuple[int, int, float]]]:
    """Edges (start, id, score) that end at each place of a chunk, longest first."""
    if len(chunk) > LONG_CHUNK:
        offsets, start, ids, scores = long_edges(np.frombuffer(chunk, dtype=np.uint8), pieces)
        flat = list(zip(start.tolist(), ids.tolist(), scores.tolist(), strict=True))
        bounds = offsets.tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    edges: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
    top = pieces.lengths[-1]
    for e in range(1, len(chunk) + 1):
        for s in range(max(0, e - top), e):
            if (found := pieces.edge.get(chunk[s:e])) is not None:
                edges[e].append((s, *found))
    i = 0
    while i < len(chunk):
        w = 1 if chunk[i] < 0x80 else 2 if chunk[i] < 0xE0 else 3 if chunk[i] < 0xF0 else 4
        if chunk[i : i + w] not in pieces.edge:
            for j in range(i, min(i + w, len(chunk))):
                edges[j + 1].append((j, int(pieces.byte_id[chunk[j]]), pieces.unknown / w))
        i += w
    return edges


def nbest_paths(chunks: list[bytes], pieces: Pieces, n: int) -> list[tuple[float, list[list[int]]]]:
    """The n best paths through a chain of chunks: score, and ids by chunk. Chains of short chunks that come again are kept."""
    if any(len(c) > LONG_CHUNK for c in chunks):
        return _nbest_paths(chunks, pieces, n)
    key = (n, *chunks)
    if key not in pieces.paths:
        if len(pieces.paths) > KEPT_PATHS:
            pieces.paths.clear()
        pieces.paths[key] = _nbest_paths(chunks, pieces, n)
    return pieces.paths[key]


def _nbest_paths(chunks: list[bytes], pieces: Pieces, n: int) -> list[tuple[float, list[list[int]]]]:
    # Scores in whole steps of 2**-32, so that sums do not depend on their order and equal paths are equal.
    step = 2.0**32
    edges: list[list[tuple[int, int, int]]] = [[]]
    ends = []
    for c in chunks:
        base = len(edges) - 1
        edges += [[(s + base, i, round(x * step)) for s, i, x in at] for at in lattice(c, pieces)[1:]]
        ends.append(len(edges) - 1)
    forward: list[int | None] = [0] + [None] * (len(edges) - 1)
    for e in range(1, len(edges)):
        forward[e] = max((forward[s] + x for s, _, x in edges[e] if forward[s] is not None), default=None)
    if forward[-1] is None:
        return []
    # Open paths, the best last: (score when finished, order of opening, place, score behind it, last step taken).
    steps_at, steps_id, steps_before = array("q"), array("q"), array("q")
    count = 0
    open_: list[tuple[int, int, int, int, int]] = [(forward[-1], 0, len(edges) - 1, 0, -1)]
    found: list[tuple[float, list[list[int]]]] = []
    while open_ and len(found) < n:
        _, _, at, behind, last = open_.pop()
        if at == 0:
            by_chunk: list[list[int]] = [[] for _ in chunks]
            while last >= 0:
                by_chunk[bisect_left(ends, steps_at[last])].append(steps_id[last])
                last = steps_before[last]
            found.append((behind / step, by_chunk))
            continue
        for s, i, x in reversed(edges[at]):  # the longest is opened last
            if forward[s] is not None:
                count += 1
                steps_at.append(at)
                steps_id.append(i)
                steps_before.append(last)
                open_.append((forward[s] + x + behind, count, s, behind + x, len(steps_at) - 1))
        open_.sort()
        del open_[: max(0, len(open_) - (n - len(found)))]
    return found


def segment(texts: list[str], pieces: Pieces, n: int = 3, exact: bool = False) -> list[tuple[np.ndarray, list[float], list[np.ndarray]]]:
    """Best ids, the scores of the n best segmentations, and the ids of the others, for each text.

    ``exact``: chunks are told apart by their bytes at once, which takes longer.
    """
    raw = [escaped(t) for t in texts]
    joined = b"".join(raw)
    if not joined:
        return [(np.zeros(0, dtype=np.int32), [0.0], []) for _ in texts]
    flat = np.frombuffer(joined, dtype=np.uint8)
    bounds = np.cumsum([0, *map(len, raw)])
    starts = chunk_starts(flat, bounds[:-1][np.diff(bounds) > 0], pieces.apart)
    ends = np.r_[starts[1:], len(flat)]
    if exact:
        number: dict[bytes, int] = {}
        hashes = np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    else:
        hashes = PieceHash(flat)(starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    # The distinct chunks that are new, on their own.
    if len(pieces.chunks.score) > KEPT_CHUNKS or len(pieces.chunks.ids) > KEPT_IDS:
        pieces.chunks = Chunks()
    kept, distinct = Chunks() if exact else pieces.chunks, hashes[first]
    new = np.flatnonzero(kept.find(distinct) < 0)
    if new.size:
        at = first[new]
        size = (ends - starts)[at]
        own_end = np.cumsum(size)
        own = flat[np.repeat(starts[at] - (own_end - size), size) + np.arange(own_end[-1])]
        kept.add(distinct[new], *best_of_chunks(own, own_end - size, own_end, pieces))
    which = kept.find(distinct)[which]
    score, gap, count, ids = kept.score, kept.gap, kept.count, kept.ids
    words = np.searchsorted(starts, bounds)  # chunks of each text
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        mine = which[a:b]
        c = count[mine]
        ends_here = np.cumsum(c)
        best = ids[np.repeat(kept.first[mine] - (ends_here - c), c) + np.arange(int(c.sum()))]
        total = float(score[mine].sum())
        scores, others = [total], []
        if n > 1 and b > a:
            g = gap[mine]
            pick = np.arange(len(g)) if len(g) < n else np.sort(np.argpartition(g, n - 2)[: n - 1])
            pick = pick[np.isfinite(g[pick])]
            if pick.size:
                chosen = [joined[starts[a + i] : ends[a + i]] for i in pick.tolist()]
                found = nbest_paths(chosen, pieces, n)
                base = float(score[mine[pick]].sum())
                first_path = [best[ends_here[i] - c[i] : ends_here[i]].tolist() for i in pick.tolist()]
                for s, by_chunk in [f for f in found if f[1] != first_path][: n - 1]:
                    scores.append(total - base + s)
                    parts, at = [], 0
                    for i, new in zip(pick.tolist(), by_chunk, strict=True):
                        parts += [best[at : ends_here[i] - c[i]], np.array(new, dtype=np.int32)]
                        at = ends_here[i]
                    others.append(np.concatenate([*parts, best[at:]]))
        out.append((best, scores, others))
    if not exact:
        found = pieces.spelled(np.concatenate([ids for ids, _, _ in out]).astype(np.int64))
        if len(found) != len(flat) or not np.array_equal(found, flat):
            for i, (ids, _, _) in enumerate(out):
                if pieces.spelled(ids.astype(np.int64)).tobytes() != raw[i]:
                    out[i] = segment(texts[i : i + 1], pieces, n, exact=True)[0]
    return out


def join_pieces(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of id sequences that lie one after the other."""
    if ids.size and (ids.min() < 0 or ids.max() >= len(pieces.size)):
        raise ValueError("an id is outside the vocabulary")
    flat = pieces.spelled(ids).tobytes()
    cuts = np.r_[0, np.cumsum(pieces.size[ids])][bounds]
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        text = flat[a:b].replace(MARK, b" ").decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *arrays]), type=pa.int32()))


def _model_path(path: str) -> str:
    """The path itself, or the file of that name that was shipped with ``SparkContext.addFile``."""
    return SparkFiles.get(path[len("files:") :]) if path.startswith("files:") else path


def encode(docs: DataFrame, n: int = 3, model: str = MODEL, text_col: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with the columns ids, scores and others: the best segmentation, the n best scores, the ids of those after the best.

    ``check`` adds round_trip: whether the ids, decoded at once, give the text (null as empty) back.

    ``model`` is a path on every machine, or ``files:NAME`` for a file added to the Spark context.
    """
    new_fields = [*ENCODED.fields, *([T.StructField("round_trip", T.BooleanType())] if check else [])]
    stay, at = _kept_columns(docs, {f.name for f in new_fields}, text_col)
    schema = T.StructType([*(docs.schema.fields[i] for i in stay), *new_fields])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage has left
        pieces = load(_model_path(model))
        for batch in batches:
            part = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_CHARS
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                a, b = int(rows[0]), int(rows[-1]) + 1
                texts = [t or "" for t in batch.column(at).slice(a, b - a).to_pylist()]
                found = segment(texts, pieces, n)
                others = _lists([o for f in found for o in f[2]])
                offsets = pa.array(np.cumsum([0, *(len(f[2]) for f in found)]).astype(np.int32))
                new = [_lists([f[0] for f in found]), pa.array([f[1] for f in found], type=pa.list_(pa.float64())), pa.ListArray.from_arrays(offsets, others)]
                if check:
                    back = join_pieces(np.concatenate([f[0] for f in found]).astype(np.int64), np.cumsum([0, *(len(f[0]) for f in found)]), pieces)
                    new.append(pa.array([x == y for x, y in zip(back, texts, strict=True)], type=pa.bool_()))
                own = batch.slice(a, b - a)
                out = pa.RecordBatch.from_arrays([*(own.column(i) for i in stay), *new], names=schema.names)
                del texts, found, others, offsets, new
                yield out
                del out

    return docs.mapInArrow(run, schema)


def _kept_columns(rows: DataFrame, new: set[str], read: str) -> tuple[list[int], int]:
    """Places of the columns that no new one replaces, and of the one that is read."""
    return [i for i, c in enumerate(rows.columns) if c not in new], rows.columns.index(read)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of their ids; null ids have a null text."""
    stay, at = _kept_columns(rows, {out_col}, ids_col)
    schema = T.StructType([*(rows.schema.fields[i] for i in stay), T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(_model_path(model))
        for batch in batches:
            column = batch.column(at)
            sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = join_pieces(ids, np.r_[0, np.cumsum(sizes)], pieces)
            valid = column.is_valid().to_pylist()
            new = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), new], names=schema.names)

    return rows.mapInArrow(run, schema)
