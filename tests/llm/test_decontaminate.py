import hashlib
import random
import re

from notewarp.llm import bitfilter
from notewarp.llm import decontaminate as D

rng = random.Random(5)
VOCAB = ["the", "of", "and", "a", *(f"v{i}" for i in range(300))]


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, bench, k=10):
    windows = {}
    for i, x in bench:
        w = words(x)
        for j in range(max(1, len(w) - k + 1)) if w else ():
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for d, x in docs:
        w, hit, items = words(x), set(), set()
        for n in {len(g) for g in windows}:
            for j in range(len(w) - n + 1):
                found = windows.get(tuple(w[j : j + n]))
                if found:
                    items |= found
                    hit |= set(range(j, j + n))
        named = sorted(str(i) for i in items if i is not None)
        out.append((repr(d), len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_against_brute_force(docs_of, spark):
    bench = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(1, 40)))) for i in range(30)]
    bench += [(100, None), (101, "..."), (102, "the"), (103, "the of and a the of and a the of and"), (7, bench[3][1]), (200, "Été à 中文")]
    docs = []
    for i in range(120):
        w = rng.choices(VOCAB, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            item = words(rng.choice(bench)[1])
            a = rng.randint(0, max(0, len(item) - 5))
            at = rng.randint(0, len(w))
            w[at:at] = item[a : a + rng.randint(5, 30)]
        docs.append((i, (", " if i % 2 else "-").join(w).upper() if i % 3 else " ".join(w)))
    docs += [(500, None), (501, ""), (None, docs[0][1]), (3, docs[4][1]), (3, docs[4][1]), (502, "x Été à 中文 y"), (503, " ".join(["the of and a"] * 3000))]
    items = spark.createDataFrame([(*r, "z") for r in bench], "item_id long, text string, term string")
    got = D.contamination(docs_of(docs), items).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute(docs, bench)
    clean = D.clean(docs_of(docs), items)
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == [r[0] for r in brute(docs, bench) if not r[5]]


def brute_near(docs, bench, slop, k=10):
    """Places where a window's rarest term stands at its place and all others near theirs, without the phrase."""
    texts = {d: words(x) for d, x in docs}
    count = {}
    for w in texts.values():
        for t in w:
            count[t] = count.get(t, 0) + 1
    out = set()
    for item, x in bench:
        w = words(x)
        for i in range(max(1, len(w) - k + 1)) if w else ():
            g = w[i : i + k]
            r = min(range(len(g)), key=lambda j: (count.get(g[j], 0), j))
            for d, t in texts.items():
                for p in [p for p, y in enumerate(t) if y == g[r]]:
                    s = p - r
                    near = all(any(0 <= s + j + e < len(t) and t[s + j + e] == y for e in range(-slop, slop + 1)) for j, y in enumerate(g))
                    if near and not (s >= 0 and t[s : s + len(g)] == g):
                        out.add((d, item, s))
    return out


def test_proximity(docs_of, spark):
    bench = [(1, "alpha b c d omega f g h i j"), (2, " ".join(VOCAB[:100])), (3, " ".join(VOCAB[5:75] * 2))]
    docs = [(1, bench[0][1]), (2, "alpha b c d x omega f g h i j"), (3, "omega " + "z " * 30 + "alpha"), (4, "b c d f g h i j"), (5, "b alpha c d omega g f h j i")]
    for i in range(6, 40):
        w = list(VOCAB[: rng.randint(20, 90)])
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(len(w) - 1)
            w[a], w[a + 1] = w[a + 1], w[a]
        docs.append((i, " ".join(w)))
    items = spark.createDataFrame(bench, "item_id long, text string")
    keys, found, _ = D.phrase_matches(docs_of(docs), items, slop=2)
    got = found.join(keys, "key").collect()
    assert {(r["doc_id"], int(r["item"]), r["start"]) for r in got if r["kind"] == "proximity"} == brute_near(docs, bench, 2)
    assert {(1, "phrase"), (2, "proximity"), (5, "proximity")} <= {(r["doc_id"], r["kind"]) for r in got}


def test_one_plan_at_any_size(docs_of, spark):
    """Nothing depends on what Spark broadcasts, and no array stands beside exploded words."""
    bench = [(i, " ".join(rng.choices(VOCAB, k=30))) for i in range(20)]
    docs = [(i, " ".join(rng.choices(VOCAB, k=10)) + " " + bench[i % 20][1]) for i in range(60)]
    items, threshold = spark.createDataFrame(bench, "item_id long, text string"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = D.contamination(docs_of(docs), items, slop=1).collect()
    finally:
        spark.conf.set(threshold, before)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute(docs, bench)


def test_empty(docs_of, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(docs_of([(1, "a b"), (2, None)]), items).collect()
    assert [(r["n_hit"], r["contaminated"]) for r in got] == [(0, False)] * 2
    assert D.contamination(docs_of([(1, "a")]).where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_clean_joins_only_what_may_be_contaminated(docs_of, spark):
    passage = " ".join(f"v{i}" for i in range(12))
    rows = [(i, f"{passage} d{i}" if i % 10 == 0 else f"some clean text of number {i}") for i in range(400)] + [(None, passage), (None, None), (7, passage), (3, "some clean text of number 3")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = D.clean(docs_of(rows), spark.createDataFrame([(1, passage)], "item_id long, text string"))
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [r for r in rows if not (r[1] or "").startswith(passage)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(want, key=key)
    # the hash of few clean texts passes for a contaminated one; all others need no join
    assert "Union" in plan.toString()
    hashed = docs_of(rows).selectExpr("xxhash64(text) as h", "text")
    may, clear = bitfilter.parted(hashed, "h", hashed.where(f"text like '{passage}%'").select("h"))
    assert 42 <= may.count() < 60 and may.count() + clear.count() == len(rows)
    assert clear.where(f"text like '{passage}%'").isEmpty()
