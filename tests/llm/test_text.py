import random
import re

import numpy as np
import pyarrow as pa

from notewarp.llm import textnp as T

rng = random.Random(3)
PARTS = ["the", "The", "é", "中文", " ", "  ", "\n", "\t", "\x0b", " ", "x" * 50, "🙂", "", "a.b"]
TEXTS = [None, "", " ", "a", " a ", *("".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(300))]


def split(x):
    return re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate({i: i + 32 for i in range(65, 91)}))


def test_words_and_sets():
    seen = {}
    for size in (1, 100, 1 << 20):
        for a, b, data, offsets in T.slices(pa.array(TEXTS, pa.string()), size):
            w = T.Words(data, offsets, lower=True)
            hashes, starts, ends = w.hashes(), w.starts, w.ends
            tokens, first = T.shingle_sets(hashes, w.first, 5)
            for i in range(a, b):
                j = range(w.first[i - a], w.first[i - a + 1])
                words = split(TEXTS[i])
                assert [bytes(w.data[starts[k] : ends[k]]).decode() for k in j] == words
                for k, word in zip(j, words):
                    assert seen.setdefault(word, hashes[k]) == hashes[k]
                want = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
                assert first[i - a + 1] - first[i - a] == len(want)
    assert len(set(seen.values())) == len(seen)


def test_equal_runs_have_equal_hashes():
    values = np.array([5, 6, 7, 5, 6, 7, 6], np.uint64)
    h = T.spans(values, np.array([0, 3, 1, 4, 0]), np.array([3, 6, 3, 6, 0]), T.BASE_WORD)
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 3
