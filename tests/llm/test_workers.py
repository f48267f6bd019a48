"""What Python workers hold at a time, and what they keep."""

import random
import re
import tracemalloc

import numpy as np


def made_texts(chars):
    draw = random.Random(3)
    texts, size = [], 0
    while size < chars:
        texts.append(" ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 10))) for _ in range(400)))
        size += len(texts[-1])
    return texts


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_of_a_sample_are_cut_in_blocks():
    from hearthlake.llm import toxicity

    texts = made_texts(2_000_000)
    words, peak = peak_mb(lambda: toxicity.Words(texts))
    kept = sum(v.nbytes for v in vars(words).values()) / 1e6
    assert peak < 4 * kept, (peak, kept)


def test_blocks_do_not_change_words(monkeypatch):
    from hearthlake.llm import toxicity

    texts = [*made_texts(40_000), "", "  ", "One two; ONE two!", "żółw", ""]
    whole = vars(toxicity.Words(texts))
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 3_000)
    parts = vars(toxicity.Words(texts))
    assert all(np.array_equal(whole[k], parts[k]) and whole[k].dtype == parts[k].dtype for k in whole)
    assert not len(toxicity.Words([]).of) and toxicity.Words(["", ""]).counts.tolist() == [0, 0]


def test_inputs_of_words_are_added_up_in_blocks():
    from hearthlake.llm import toxicity

    words = toxicity.Words(made_texts(2_000_000))
    net = toxicity.Network.fresh(np.unique(words.feature))
    rows = net.rows(words.feature)
    out, peak = peak_mb(lambda: net.inputs(words, rows))
    assert peak < 2 * out.nbytes / 1e6 + 10, (peak, out.nbytes)
    plain = np.add.reduceat(net.p["embed"][rows] * words.weight[:, None], words.first, axis=0)
    assert np.array_equal(out[:-1], plain) and not out[-1].any()
    none = toxicity.Words(["", " "])
    assert np.array_equal(net.inputs(none, net.rows(none.feature)), np.zeros((1, toxicity.EMBED)))


def own_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024


def test_a_worker_that_waits_keeps_nothing_it_freed():
    from hearthlake.llm.workers import give_back, lean

    last = []

    @lean
    def run(batches):
        for _ in batches:
            held = [b"x" * (3000 + i % 2) for i in range(50_000)]  # 150 MB in small pieces
            last.extend(held[::1000])  # lie between them, so that the C library keeps their place
            del held
            yield own_mb()

    give_back()
    before = own_mb()
    inside = next(run(iter([0])))
    assert inside > before + 100
    assert list(run(iter([0, 0]))) and own_mb() < before + 60
