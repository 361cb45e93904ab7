"""Near-duplicate join and substring removal against brute force."""

import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from notewarp.llm import ngram_join, substring

rng = random.Random(11)
VOCAB = [f"w{i}" for i in range(4000)]


def words(x, lower=True):
    x = x or ""
    return re.findall(r"[^\x20\x09-\x0D]+", x.translate({i: i + 32 for i in range(65, 91)}) if lower else x)


def texts():
    out = [None, "", "  \n", "one", "One", "a b c", "a b c", "a b c d e", "x " * 300, "x " * 310, "y y y y y y"]
    passage = " ".join(rng.choices(VOCAB, k=70))
    for _ in range(40):
        out.append(" ".join(rng.choices(VOCAB, k=rng.randint(5, 120))) + " " + passage)
    for n in (30, 150, 400):
        base = rng.choices(VOCAB, k=n)
        for _ in range(25):
            near = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                near[rng.randrange(n)] = rng.choice(VOCAB)
            out.append("  ".join(near))
    out += [out[60]] * 15 + [out[12].upper()]
    out.append(" ".join(rng.choices(VOCAB, k=9000)) + " " + passage)
    return out


def brute_components(rows):
    sets, links = {}, {i: i for i in range(len(rows))}
    for i, (_, x) in enumerate(rows):
        w = words(x)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    def find(a):
        while links[a] != a:
            a = links[a]
        return a

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                links[max(a, b)] = min(a, b)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(rows[i][0])
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((repr(rows[i][0]), len(sets[i]), repr(low[find(i)] if sets[i] else rows[i][0])) for i in sets)


@pytest.mark.parametrize("group", [2, 32])
def test_components(docs_of, group, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = list(enumerate(texts(), 100)) + [(None, "one"), (None, "nobody else"), (None, None)]
    got = ngram_join.similarity_components(docs_of(rows)).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == brute_components(rows)


def test_threshold_is_exact(docs_of):
    nine = [f"t{i}" for i in range(13)]  # nine shingles; one changed end leaves eight of ten
    rows = [(1, " ".join(nine)), (2, " ".join(nine[:-1] + ["z"])), (3, " ".join(nine[:-2] + ["y", "z"]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_deduplicate(docs_of):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, "only here"), (7, None), (8, "")]
    docs = docs_of(rows)
    got = ngram_join.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None) == [(3, "A b c d e f"), (7, None), (8, "")]
    assert [r["text"] for r in got.collect() if r["doc_id"] is None] == ["only here"]


def test_empty(docs_of, spark):
    empty = docs_of([(1, "x")]).where("false")
    assert ngram_join.similarity_components(empty).collect() == []
    assert substring.remove_repeats(empty).collect() == []


def brute_removal(rows, k=50):
    low = {}
    for d, x in rows:
        w = words(x, False)
        for j in range(len(w) - k + 1) if d is not None else ():
            g = tuple(w[j : j + k])
            low[g] = min(low.get(g, d), d)
    out = []
    for d, x in rows:
        w = words(x, False)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1) if d is not None else ():
            if low[tuple(w[j : j + k])] < d:
                gone[j : j + k] = [True] * k
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out.append((repr(d), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_removal(docs_of):
    rows = list(enumerate(texts(), 100))
    passage = " ".join(rng.choices(VOCAB, k=60))
    for i in range(30):
        a, b = rng.randint(0, 12), rng.randint(45, 60)
        rows.append((300 + i, " ".join([*rng.choices(VOCAB, k=5), *passage.split()[a:b], *rng.choices(VOCAB, k=5), *passage.split()])))
    rows += [(None, passage), (300, passage), (300, rows[-1][1]), (1, "q " * 120), (2, "q " * 90 + "r " + "q " * 60)]
    got = substring.remove_repeats(docs_of(rows)).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_removal(rows)


def brute_runs(rows, k):
    """The nonbranching paths of the graph of the windows that two documents share, as sets of windows."""
    seen = {}
    for d, x in rows:
        w = words(x, False)
        for j in range(len(w) - k + 1):
            seen.setdefault(tuple(w[j : j + k]), set()).add(d)
    edges = [g for g, d in seen.items() if len(d) > 1]
    out, into = {}, {}
    for g in edges:
        out.setdefault(g[:-1], []).append(g)
        into.setdefault(g[1:], []).append(g)
    return {g: out[g[1:]][0] for g in edges if len(out.get(g[1:], [])) == 1 == len(into[g[1:]])}, set(edges)


def test_paths_are_nonbranching_and_whole(docs_of):
    """Spans that differ around a shared middle: its edges compact to runs, and runs that meet at a node without branch to one path."""
    middle = [f"m{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{i}{j}" for j in range(30)] + middle + [f"z{i}{j}" for j in range(30)])) for i in range(4)]
    rows += [(9, " ".join(middle[:60])), (10, " ".join(["x"] * 5 + middle[15:] + ["y"] * 40))]
    _, found, _, runs, _ = substring.repeated_spans(docs_of(rows), 50)
    follows, edges = brute_runs(rows, 50)
    got = runs.collect()
    text = {d: words(x, False) for d, x in rows}
    of = {}
    for r in got:
        at = [tuple(text[r["doc_id"]][r["first"] + i : r["first"] + i + 50]) for i in range(r["windows"])]
        assert all(follows.get(a) == b for a, b in zip(at, at[1:]))
        of |= {g: r["path"] for g in at}
    assert got and set(of) <= edges and all(of[a] == of[b] for a, b in follows.items() if a in of and b in of)
    assert {r["source"]["doc_id"] for r in found.collect()} <= {d for d, _ in rows}


def test_words_are_compared(docs_of):
    rows = [(1, " ".join(f"w{i}" for i in range(70))), (2, " ".join(f"w{i}" for i in range(60)))]
    _, found, texts_, _, scratch = substring.repeated_spans(docs_of(rows), 50)
    moved = found.withColumn("source", F.struct("source.doc_id", "source.rk", (F.col("source.first") + 1).alias("first")))
    with pytest.raises(RuntimeError):
        substring.cleaned(scratch, moved, texts_, 50)


def test_sliding_minimum():
    import numpy as np

    v = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    for width in range(1, 8):
        low, at = substring.least(v, width)
        want = [(int(v[i : i + width].min()), i + int(v[i : i + width].argmin())) for i in range(len(v) - width + 1)]
        assert list(zip(low.tolist(), at.tolist())) == want
