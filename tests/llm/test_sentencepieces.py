import os

import numpy as np
import pytest
import sentencepiece
from helpers import documents

from hearthlake.llm import sentencepieces as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no tokenizer files")
TEXTS = ["hello world", "a b c", "  two  spaces\n\tx ", "é漢字 ñ 🙂", "the the the", "x", "naïve coöperation", "12345 67", "tail ", "\n", "ab\u0000c", "under_score and-dash"]


def every_path(chunk, pieces, n):
    edges = sp.lattice(chunk, pieces)
    paths = [[(0.0, ())]] + [[] for _ in chunk]
    for e in range(1, len(chunk) + 1):
        paths[e] = sorted(((s + x, (*p, i)) for a, i, x in edges[e] for s, p in paths[a]), reverse=True)[: 4 * n]
    return paths[-1][:n]


def test_n_best_match_exhaustive_search():
    pieces = sp.load(sp.MODEL)
    for t, (ids, scores, others) in zip(TEXTS, sp.segment(TEXTS, pieces, 5), strict=True):
        want = every_path(sp.escaped(t), pieces, 5)
        assert np.allclose(scores, [s for s, _ in want]), t
        total = {i: s for i, s in pieces.edge.values()}
        spelled = lambda found: sum(total.get(int(i), 0) for i in found)
        assert len(others) == len(scores) - 1 and len({tuple(o) for o in [ids, *others]}) == len(scores)
        assert spelled(ids) >= max([spelled(o) for o in others], default=-np.inf) or any(int(i) < 259 for i in ids)


def test_kept_chunks_change_nothing(monkeypatch):
    pieces = sp.Pieces(sp.MODEL)
    plain = lambda found: [(i.tolist(), s, [o.tolist() for o in more]) for i, s, more in found]
    fresh = [plain(sp.segment([t], sp.Pieces(sp.MODEL), 3))[0] for t in TEXTS[:4]]
    kept = [plain(sp.segment([t], pieces, 3))[0] for t in TEXTS[:4] + TEXTS[:4]]
    monkeypatch.setattr(sp, "KEPT_CHUNKS", 2)
    dropped = [plain(sp.segment([t], pieces, 3))[0] for t in TEXTS[:4]]
    assert kept == fresh * 2 and dropped == fresh and len(pieces.chunks.score) < 10


def test_round_trip_and_library_agree_on_decoding(spark):
    rows = [(i, t, "s") for i, t in enumerate([*TEXTS, None, "", "word " * 30_000, "q" * 3000])] + [(0, TEXTS[0], "s")]
    docs = documents(spark, rows)
    out = sp.encode(docs, n=2, check=True)
    assert out.columns == [*docs.columns, "ids", "scores", "others", "round_trip"]
    back = sp.decode(out).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    assert len(back) == len(rows) and all(r.decoded == (r.text or "") and r.round_trip for r in back)
    assert all(model.decode(list(r.ids)) == (r.text or "") for r in back if "\u0000" not in (r.text or ""))
    assert all(sp.join_pieces(np.array(o), np.array([0, len(o)]), sp.load(sp.MODEL)) == [r.text] for r in back for o in r.others)
    assert sp.encode(docs.limit(0)).count() == 0
    clash = sp.encode(docs.withColumnRenamed("rank", "ids").withColumnRenamed("digest", "round_trip"), n=2, check=True)
    assert clash.columns == [*docs.columns[:-2], "ids", "scores", "others", "round_trip"] and all(r.round_trip for r in clash.collect())
    assert sp.decode(clash.withColumnRenamed("lang", "decoded")).columns.count("decoded") == 1


def test_chunks_with_equal_hashes_are_told_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "plain words"]
    assert len({int(sp.PieceHash(np.frombuffer(t.encode(), dtype=np.uint8))(np.array([0]), np.array([2048]))[0]) for t in texts[:2]}) == 1
    out = sp.encode(documents(spark, [(i, t, "s") for i, t in enumerate(texts * 2)]).coalesce(1), n=2, check=True).collect()
    assert all(r.round_trip for r in out) and [r.ids for r in out[:3]] == [r.ids for r in out[3:]] and out[0].ids != out[1].ids
    alone = sp.Pieces(sp.MODEL)
    assert [r.ids for r in out[:2]] == [sp.segment([t], alone, 2, exact=True)[0][0].tolist() for t in texts[:2]]


def independent_paths(text, n):
    """The n best segmentations by walking the pieces of the library's own vocabulary."""
    model = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    known = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    worst = min(x for _, x in known.values() if x > -1e8) - 10
    text = ("\u2581" + text.replace(" ", "\u2581")) if text else ""
    best = [[(0.0, ())]]
    for e in range(1, len(text) + 1):
        found = []
        for s in range(e):
            if (hit := known.get(text[s:e])) is not None:
                found += [(x + hit[1], (*p, hit[0])) for x, p in best[s]]
            elif s == e - 1:
                spelled = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in text[s].encode())
                found += [(x + worst, (*p, *spelled)) for x, p in best[s]]
        best.append(sorted(found, reverse=True)[:n])
    return best[-1]


def test_n_best_match_an_independent_lattice():
    pieces = sp.load(sp.MODEL)
    texts = [*TEXTS[:9], "internationalisation of the token lattice", "a  b   c", "x\u00e9\U0001f642y"]
    for t, (ids, scores, others) in zip(texts, sp.segment(texts, pieces, 4), strict=True):
        want = independent_paths(t, 4)
        assert np.allclose(scores, [s for s, _ in want]), t
        if len(want) > 1 and want[0][0] > want[1][0]:
            assert tuple(ids.tolist()) == want[0][1], t


def test_equal_scores_in_long_chunks():
    pieces = sp.load(sp.MODEL)
    for t in ("q" * 60, "qa" * 30, "\u4e2d\u6587" * 40):
        ids, scores, others = sp.segment([t], pieces, 4)[0]
        want = independent_paths(t, 4)
        assert np.allclose(scores, [s for s, _ in want]) and len({tuple(o) for o in [ids, *others]}) == len(want)
    draw = np.random.default_rng(1)
    for t in ("q" * 1000, "".join(draw.choice(list("abcdet"), 900)), "\u7684\u4e00\u662f\u4e0d" * 120, "\U0001f642" * 150):  # one chunk each, place by place and by offsets
        flat = np.frombuffer(sp.escaped(t), dtype=np.uint8)
        score, gap, ids = sp.long_viterbi(flat, pieces)
        plain = sp.viterbi(flat, np.array([0]), np.array([len(flat)]), pieces)
        assert np.isclose(score, plain[0][0]) and (np.isclose(gap, plain[1][0]) or gap == plain[1][0]) and ids.tolist() == plain[2].tolist()
        small = sp.lattice(flat.tobytes()[:300], pieces)
        assert sp.long_edges(flat[:300], pieces)[0].tolist() == np.cumsum([0, *map(len, small)]).tolist()


def test_texts_without_blanks_take_time_in_proportion():
    import time

    pieces = sp.load(sp.MODEL)
    for t in ("q" * 1_000_000, "\u7684\u4e00\u662f\u4e0d\u4e86\u4eba\u6211\u5728" * 40_000):
        began = time.perf_counter()
        ids, scores, others = sp.segment([t], pieces, 3)[0]
        assert time.perf_counter() - began < 60
        assert all(sp.join_pieces(o.astype(np.int64), np.array([0, len(o)]), pieces) == [t] for o in [ids, *others])
    scores = sp.segment(["q" * 2000], pieces, 3)[0][1]
    assert scores == scores[:1] * 3
