"""Toxicity scores from a bidirectional gated recurrent network in numpy.

A text is lower-cased and cut into runs of letters and digits, repeats included.
Every word enters as the embedding of its whole form plus the scaled sum of those
of its character n-grams of ``GRAMS`` letters, its two ends counted as letters, all
looked up by hash; what occurs in fewer than ``LEAST_DOCS`` documents of the
sample adds nothing. Windows of
``WINDOW`` words that overlap by ``WINDOW - STRIDE`` cover the whole text; each runs
through a gated recurrent layer in both directions and attention pools its
states into one logit. The score of a text is the probability that belongs to the
greatest of its windows' logits, by a logistic curve that documents which the
network was not trained on have shaped: a quarter of the sample where that holds
``CROSS_FIT`` toxic documents, else every labelled document, by networks that were
trained without its fold.

Labels mark documents, not windows. The first round takes as positive those windows
of a toxic document whose words speak most for toxic documents, by the log odds
of their features in standard errors over the other documents, and leaves its other windows out. From then on the
network itself says which windows of toxic documents are positive, and the
negative windows are those of clean documents that it finds hardest, and others
by lot.

Windows run through the network in blocks of one shape and scores are rounded, so
that a text's score does not depend on the texts beside it.

Defined results: null and empty texts have one window without words, whose score
is that of an all-padding input; labels that are null or belong to no document
are not used; documents without a label are scored like all others; several
labels of one document count each, contradicting ones too; a score equal to the
threshold counts as toxic; an empty table gives no rows; with no label
of either kind the score is the share of toxic labels, 0.5 if there is none.
"""

from __future__ import annotations

import itertools
import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.pieces import PieceHash
from hearthlake.llm.workers import lean

WINDOW, STRIDE = 32, 24
SLOTS, EMBED, HIDDEN = 1 << 20, 12, 8
GRAMS, LEAST_DOCS = (3, 5), 3
#: Windows that run through the network at a time.
BLOCK_WINDOWS = 1024
#: Characters that are cut into words at a time, and features whose embeddings are added up at a time.
BLOCK_CHARS, BLOCK_FEATURES = 500_000, 1 << 16
#: Steps of an epoch at least, as a small sample is gone through more often; how fast embeddings move.
LEAST_STEPS, EMBED_RATE = 24, 2
#: Labelled documents of each kind that training reads at most, the characters of their (whole) texts, and windows of a round.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WINDOWS = 1500, 3_500_000, 8_000
#: Toxic documents that a quarter left aside needs to shape the curve; folds of the cross-fit otherwise.
CROSS_FIT, FOLDS = 15, 4
#: Least slope of the curve: the network's logits are log odds already.
LEAST_SLOPE = 0.25
#: Standard errors that a feature's log odds need at least, and the share of a document's greatest ones that marks a window.
EVIDENCE, NEARLY = 2.0, 0.7
#: By how much an embedding starts further along its first axis for each standard error above the first one.
HINT = 0.2
#: Score from which a document is taken for toxic.
THRESHOLD = 0.3


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each of ``first`` on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Words:
    """The words of some texts: ``counts`` of each text, and the distinct word ``of`` each place.

    ``feature`` holds the hashes of the distinct words' features, word by word, from
    ``first`` on, its whole form ahead of its n-grams.
    """

    def __init__(self, texts: list[str]):
        part = np.cumsum([len(t) for t in texts]) // BLOCK_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        found = [_cut(texts[a:b]) for a, b in itertools.pairwise(cuts)]
        counts, whole, of, many, feature = (list(x) for x in zip(*found, strict=True))
        del found
        self.counts = np.concatenate(counts)
        size = [len(w) for w in whole]
        whole, at, place = np.unique(np.concatenate(whole), return_index=True, return_inverse=True)
        self.of = np.concatenate([p[o] for p, o in zip(np.split(place, np.cumsum(size)[:-1]), of, strict=True)])
        many = np.concatenate(many)
        self.many = many[at]
        self.feature = np.concatenate(feature)[_ranges((np.cumsum(many) - many)[at], self.many)]
        self.first = np.cumsum(self.many) - self.many
        self.weight = np.repeat(1 / np.sqrt(np.maximum(1, self.many - 1)), self.many).astype(np.float32)
        self.weight[self.first] = 1


def _cut(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Counts, distinct words, which of them is at each place, and how many features and which ones they have."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer(f" {' '.join(low)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (flat >= 0x80) | ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57))
    step = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = step[0::2], step[1::2] + 2  # with the blank at either end
    counts = np.bincount(np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts, side="right"), minlength=len(texts))
    piece = PieceHash(np.where(letter, flat, np.uint32(32)))
    whole, at, of = np.unique(piece(starts, ends, 1), return_index=True, return_inverse=True)
    size = (ends - starts)[at]
    many = [np.maximum(0, size - n + 1) for n in GRAMS]
    word = np.concatenate([np.arange(len(whole)), *(np.repeat(np.arange(len(whole)), c) for c in many)])
    spots = [(_ranges(starts[at], c), n) for n, c in zip(GRAMS, many, strict=True)]
    feature = np.concatenate([whole, *(piece(x, x + n, n) for x, n in spots)])[np.argsort(word, kind="stable")]
    return counts, whole, of, np.bincount(word, minlength=len(whole)), feature


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of each window (-1 where there is none), and the text of each window."""
    per_text = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(counts)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = number * STRIDE
    at = first[:, None] + np.arange(WINDOW)
    base = np.cumsum(counts) - counts
    return np.where(at < counts[owner][:, None], at + base[owner][:, None], -1), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters by name, all float32, and the table that finds a feature's embedding by its hash."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None
    slots: np.ndarray | None = None
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, vocabulary: np.ndarray, seed: int = 7) -> Network:
        """``vocabulary``: hashes by falling frequency; where two share a slot the first one stays."""
        draw = np.random.default_rng(seed)
        place, first = np.unique((vocabulary % np.uint64(SLOTS)).astype(np.int64), return_index=True)
        hashes, rows = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32)
        hashes[place], rows[place] = vocabulary[first], np.arange(1, len(place) + 1)
        embed = draw.normal(0, 0.1, (len(place) + 1, EMBED))
        embed[0] = 0  # all that is not in the vocabulary
        p = {"embed": embed}
        for d in ("f", "b"):
            p |= {f"w{d}": draw.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)), f"u{d}": draw.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
        p |= {"att": draw.normal(0, 0.3, (2 * HIDDEN,)), "out": draw.normal(0, 0.3, (2 * HIDDEN,)), "bias": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in p.items()}, None, np.rec.fromarrays([hashes, rows], names="hash,row"))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding rows of hashes; 0 for what is not in the vocabulary."""
        found = self.slots[(hashes % np.uint64(SLOTS)).astype(np.int64)]
        return np.where(found["hash"] == hashes, found["row"], 0)

    def inputs(self, words: Words, rows: np.ndarray) -> np.ndarray:
        """Inputs of the distinct words, and at the end one of padding; rows: embedding rows of the features."""
        out = np.zeros((len(words.first) + 1, EMBED), dtype=np.float32)
        part = words.first // BLOCK_FEATURES
        cuts = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(words.first)].tolist()
        bounds = np.r_[words.first, len(rows)][cuts].tolist()
        for (i, j), (a, b) in zip(itertools.pairwise(cuts), itertools.pairwise(bounds), strict=True):
            out[i:j] = np.add.reduceat(self.p["embed"][rows[a:b]] * words.weight[a:b, None], words.first[i:j] - a, axis=0)
        return out

    def logits(self, words: Words, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits of windows, in blocks of one shape (the last one is padded)."""
        x, of = self.inputs(words, rows), np.r_[words.of, len(words.first)]
        out = np.zeros(len(at), dtype=np.float32)
        block = np.full((BLOCK_WINDOWS, WINDOW), -1)
        for i in range(0, len(at), BLOCK_WINDOWS):
            part = at[i : i + BLOCK_WINDOWS]
            block[: len(part)], block[len(part) :] = part, -1
            out[i : i + len(part)] = self.run(x[of[block]], (block >= 0).astype(np.float32))[: len(part)]
        return out

    def run(self, x: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows; x: window x step x EMBED, real: which steps hold a word."""
        n, steps, _ = x.shape
        states, tape = [], {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            u = self.p[f"u{d}"]
            out = np.zeros((n, steps, HIDDEN), dtype=np.float32)
            saved = []
            for t in order:
                hu = h @ u
                zr = _sigmoid(gates[:, t, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(gates[:, t, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                m = real[:, t, None]
                then = h + m * (1 - z) * (new - h)
                if keep:
                    saved.append((t, h, z, r, new, hu[:, 2 * HIDDEN :], m))
                h = then
                out[:, t] = h
            states.append(out)
            tape[d] = saved
        both = np.concatenate(states, axis=2)
        score = np.where(real > 0, both @ self.p["att"], -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True)) * (real > 0)
        weight = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * both).sum(axis=1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, both, weight, pooled, tape) if keep else logit

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, weight_of: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        logit, both, weight, pooled, tape = self.run(x, real, keep=True)
        g: dict[str, np.ndarray] = {}
        dl = ((_sigmoid(logit) - y) * weight_of / len(y)).astype(np.float32)
        g["out"], g["bias"] = dl @ pooled, np.array([dl.sum()], dtype=np.float32)
        dp = dl[:, None] * self.p["out"]
        inner = (both * dp[:, None, :]).sum(axis=2)
        ds = weight * (inner - (weight * inner).sum(axis=1, keepdims=True))
        g["att"] = np.einsum("nt,nth->h", ds, both)
        dboth = weight[:, :, None] * dp[:, None, :] + ds[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        for k, d in enumerate(("f", "b")):
            u, w = self.p[f"u{d}"], self.p[f"w{d}"]
            du, dgates = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * HIDDEN), dtype=np.float32)
            dh = np.zeros((len(x), HIDDEN), dtype=np.float32)
            for t, h, z, r, new, hn, m in reversed(tape[d]):
                dh = dh + dboth[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                dnew = dh * m * (1 - z) * (1 - new**2)
                dz = -dh * m * (new - h) * z * (1 - z)
                dr = dnew * hn * r * (1 - r)
                dgates[:, t] = np.concatenate([dz, dr, dnew], axis=1)
                dhu = np.concatenate([dz, dr, dnew * r], axis=1)
                du += h.T @ dhu
                dh = dh * (1 - m * (1 - z)) + dhu @ u.T
            flat = dgates.reshape(-1, 3 * HIDDEN)
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = du, x.reshape(-1, EMBED).T @ flat, flat.sum(axis=0)
            dx += dgates @ w.T
        return g, dx

    def best(self, texts: list[str]) -> np.ndarray:
        """The greatest window logit of each text."""
        words = Words(texts)
        at, owner = windows(words.counts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, self.logits(words, self.rows(words.feature), at))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return np.round(_sigmoid(self.curve[0] * np.round(self.best(texts), 3) + self.curve[1]), 6) if texts else np.zeros(0)


def _fit_curve(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve.

    Where nearly all clean documents lie below nearly all toxic ones, the middle
    of the gap gets the probability ``THRESHOLD``, and the gap's ends lie two logits
    from it. Else damped Newton steps fit the curve; toxic documents weigh
    ``prior`` in all. The slope is ``LEAST_SLOPE`` at least; where documents that the
    network has not seen call for less, it hardly ranks them, which is warned of.
    """
    low, high = np.quantile(x[y == 0], 0.995), np.quantile(x[y > 0], 0.01)
    if high > low:
        slope = 4 / max(float(high - low), 0.2)
        return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * (low + high) / 2)
    weight = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    middle, scale = float(x.mean()), max(1e-3, float(x.std()))
    z = np.stack([(x - middle) / scale, np.ones(len(x))], axis=1)

    def newton(fixed: float | None) -> np.ndarray:
        w = np.array([0.0 if fixed is None else fixed, 0.0])
        free = slice(0, 2) if fixed is None else slice(1, 2)
        for _ in range(steps):
            p = _sigmoid(z @ w)
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 2e-3 * np.eye(2)
            move = np.linalg.solve(hessian[free, free], (z.T @ (weight * (p - y)) + 2e-3 * w)[free])
            w[free] -= move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        return w

    w = newton(None)
    if w[0] < LEAST_SLOPE * scale:
        warnings.warn("the network hardly tells toxic documents from clean ones", stacklevel=2)
        w = newton(LEAST_SLOPE * scale)
    slope = float(w[0]) / scale
    return slope, float(w[1]) - slope * middle


class Sample:
    """Labelled texts, their words and windows."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.texts, self.y = texts, labels
        self.words = Words(texts)
        self.at, self.owner = windows(self.words.counts)
        self.known, feature = np.unique(self.words.feature, return_inverse=True)
        self.feature = feature.astype(np.int32)
        # The distinct features of each document, document by document to bound the memory.
        has, first = [np.zeros(0, dtype=np.int32)], 0
        for count in self.words.counts.tolist():
            word = np.unique(self.words.of[first : first + count])
            has.append(np.unique(self.feature[_ranges(self.words.first[word], self.words.many[word])]))
            first += count
        self.has, self.in_doc = np.concatenate(has), np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in has[1:]])

    def learn(self, use: np.ndarray, rounds: int, epochs: int, batch: int, rate: float, drop: float, seed: int) -> Network:
        """A network fitted to the documents in ``use``, without a curve."""
        draw = np.random.default_rng(seed)
        words, y = self.words, self.y
        mine = use[self.in_doc]
        docs = np.bincount(self.has[mine], minlength=len(self.known))
        toxic_docs = np.bincount(self.has[mine], y[self.in_doc[mine]], len(self.known))
        clean_docs = docs - toxic_docs
        order = np.argsort(-docs, kind="stable")
        net = Network.fresh(self.known[order][docs[order] >= LEAST_DOCS], seed)
        rows = net.rows(words.feature)
        toxic_all, clean_all = y[use].sum(), (y[use] == 0).sum()

        def odds(toxic_docs: np.ndarray) -> np.ndarray:
            """Log odds of each feature between toxic and clean documents, in standard errors."""
            a, b, c, d = toxic_docs + 0.5, clean_docs + 0.5, toxic_all - toxic_docs + 0.5, clean_all - clean_docs + 0.5
            return np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)

        net.p["embed"][rows, 0] += HINT * np.maximum(0, odds(toxic_docs)[self.feature] - 1)
        net.p["embed"][0] = 0
        # A toxic document is no evidence about itself.
        of_word = np.r_[np.maximum.reduceat(odds(np.maximum(toxic_docs - 1, 0))[self.feature], words.first), -np.inf]
        seen = np.flatnonzero(use[self.owner])
        at, owner = self.at[seen], self.owner[seen]
        speaks = of_word[np.r_[words.of, len(words.first)][at]].max(axis=1)
        most = np.full(len(y), -np.inf)
        np.maximum.at(most, owner, speaks)
        toxic = y[owner] > 0
        positive = toxic & (speaks >= np.maximum(EVIDENCE, NEARLY * most[owner]))
        if not positive.any():
            positive = toxic
        hard = np.zeros(len(at), dtype=bool)
        of = np.r_[words.of, 0]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        step = 0
        for r in range(rounds):
            if r:
                logit = net.logits(words, rows, at)
                best = np.full(len(y), -np.inf)
                np.maximum.at(best, owner, logit)
                positive = toxic & ((logit > 0) | (logit >= best[owner]) & (logit > -1))
                hard = ~toxic & (logit > -2)
            others = np.flatnonzero(~toxic & ~hard)
            chosen = np.r_[np.flatnonzero(positive | hard), draw.permutation(others)[: max(SAMPLE_WINDOWS - int((positive | hard).sum()), SAMPLE_WINDOWS // 3)]]
            target = positive.astype(np.float32)
            share = min(max(float(target[chosen].mean()), 1e-3), 0.999)
            weight = np.where(target > 0, min(10.0, 0.5 / share), 0.5 / (1 - share)).astype(np.float32)
            for _ in range(max(epochs, -(-epochs * LEAST_STEPS * batch // max(1, len(chosen))))):
                turn = draw.permutation(chosen)
                for i in range(0, len(turn), batch):
                    pick = turn[i : i + batch]
                    real = (at[pick] >= 0).astype(np.float32)
                    # Each distinct word of the batch once, some of its features left out.
                    word, place = np.unique(of[at[pick]], return_inverse=True)
                    place = place.reshape(at[pick].shape)
                    count = words.many[word]
                    used = _ranges(words.first[word], count)
                    used, back = used[rows[used] > 0], np.repeat(np.arange(len(word)), count)[rows[used] > 0]
                    stay = draw.random(len(used)) >= drop
                    used, back = used[stay], back[stay]
                    scaled = net.p["embed"][rows[used]] * words.weight[used][:, None]
                    inputs = np.stack([np.bincount(back, scaled[:, k], len(word)) for k in range(EMBED)], axis=1).astype(np.float32)
                    g, dx = net.gradients(inputs[place] * real[:, :, None], real, target[pick], weight[pick])
                    step += 1
                    lr = np.float32(rate * (0.3 if r == rounds - 1 else 1))
                    for k, dv in g.items():
                        _adam(net.p, k, dv, moments, step, lr)
                    flow = (dx * real[:, :, None]).reshape(-1, EMBED)
                    flow = np.stack([np.bincount(place.reshape(-1), flow[:, k], len(word)) for k in range(EMBED)], axis=1)
                    _adam_rows(net.p["embed"], rows[used], flow[back] * words.weight[used][:, None], moments["embed"], lr)
        return net


def train(texts: list[str], labels: np.ndarray, rounds: int = 3, epochs: int = 2, batch: int = 256, rate: float = 0.01, drop: float = 0.15, prior: float | None = None, seed: int = 7) -> Network:
    """Fit a network to document labels of 0 and 1.

    ``prior``: the share of toxic documents that the curve assumes, by default that of the labels.
    """
    first = list(dict.fromkeys(zip(texts, np.asarray(labels).tolist(), strict=True)))  # copies would teach a text by heart
    texts, labels = [t for t, _ in first], np.array([y for _, y in first], dtype=np.float32)
    prior = float(labels.mean()) if prior is None and len(texts) else prior
    if min((labels > 0).sum(), (labels == 0).sum()) < 2:
        return Network(constant=float(labels.mean()) if len(texts) else 0.5)
    sample = Sample(texts, labels)
    how = (rounds, epochs, batch, rate, drop, seed)
    # Folds with equal shares of both labels.
    fold = np.zeros(len(texts), dtype=np.int64)
    draw = np.random.default_rng(seed)
    for y in (0, 1):
        rows = draw.permutation(np.flatnonzero(labels == y))
        fold[rows] = np.arange(len(rows))
    aside = fold % 4 == 3
    if (labels[aside] > 0).sum() >= CROSS_FIT:
        net = sample.learn(~aside, *how)
        net.curve = _fit_curve(_best(net, sample, aside), labels[aside], prior)
        return net
    fold %= min(FOLDS, int((labels > 0).sum()), int((labels == 0).sum()))
    found = np.zeros(len(texts))
    for k in range(fold.max() + 1):
        found[fold == k] = _best(sample.learn(fold != k, *how), sample, fold == k)
    net = sample.learn(np.ones(len(texts), dtype=bool), *how)
    net.curve = _fit_curve(found, labels, prior)
    return net


def _best(net: Network, sample: Sample, which: np.ndarray) -> np.ndarray:
    return net.best([t for t, w in zip(sample.texts, which, strict=True) if w])


def _adam(p: dict, k: str, g: np.ndarray, moments: dict, step: int, lr: np.float32) -> None:
    m, v = moments[k]
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    p[k] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)


def _adam_rows(embed: np.ndarray, rows: np.ndarray, flow: np.ndarray, moments: tuple, lr: np.float32) -> None:
    """One adaptive step for the table rows in use, by the gradients that flow into them."""
    used, at = np.unique(rows, return_inverse=True)
    g = np.stack([np.bincount(at, flow[:, c], len(used)) for c in range(flow.shape[1])], axis=1).astype(np.float32)
    v = moments[1]
    v[used] += g * g
    embed[used] -= EMBED_RATE * lr * g / (np.sqrt(v[used]) + 1e-4) + lr * 0.01 * embed[used]


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> Network:
    """Train on a bounded sample of labelled documents.

    Of each kind, ``sample_docs`` documents at most are drawn in a seeded order; one
    that would take the texts of its kind above ``sample_chars`` characters is passed
    over, the shorter ones after it are not. Texts are read whole.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null").filter(~held_out(F.col("id")))
    order = F.xxhash64(F.lit(11), "id")
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, "id").limit(sample_docs)
        picked = part if picked is None else picked.unionByName(part)
    counts = dict(known.groupBy("y").count().collect())
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = texts.select("id", F.length("text").alias("chars")).join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.max("chars").alias("chars"))
    sizes = sizes.select("id", "y", "chars", order.alias("at")).toPandas().sort_values(["y", "at", "id"])
    room = {0: sample_chars, 1: sample_chars}
    fits = []
    for y, chars in zip(sizes.y, sizes.chars, strict=True):
        fits.append(chars <= room[y])
        room[y] -= chars if fits[-1] else 0
    taken = sizes[np.array(fits, dtype=bool)]
    chosen = docs.sparkSession.createDataFrame(taken[["id", "y"]].drop_duplicates(), "id long, y int")
    longest = F.max(F.struct(F.length("text"), "text"))["text"]  # where rows repeat an id
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(longest.alias("text"))
    prior = min(max(prior, 0.01), 0.99)

    @lean
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([pd.DataFrame({"id": [], "y": [], "text": []}), *batches]).sort_values(["id", "y"])
        net = train(sample["text"].tolist(), sample["y"].to_numpy(dtype=float), prior=prior)
        yield pd.DataFrame({"net": [pickle.dumps(net, protocol=5)]})

    # One task trains on the bounded sample, so that its texts and arrays never weigh on the driver.
    trained = rows.repartition(1).mapInPandas(learn, "net binary").collect()
    return pickle.loads(trained[0]["net"]) if trained else train([], np.zeros(0), prior=prior)


def _in_parts(net: Network, texts: list) -> np.ndarray:
    """Scores of texts, of which so many are taken at a time as memory is meant to hold."""
    out, part, size = [np.zeros(0)], [], 0
    for t in texts:
        part.append(t if isinstance(t, str) else "")
        size += len(part[-1])
        if size > 500_000:
            out.append(net.scores(part))
            part, size = [], 0
    return np.concatenate([*out, net.scores(part)]).astype(float)


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and score."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows.doc_id, "score": _in_parts(model.value, rows.text.tolist())})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_in_parts(model.value, texts.tolist()), dtype=float)

    return docs.filter(score(F.col(text_col).cast("string")) < threshold)
