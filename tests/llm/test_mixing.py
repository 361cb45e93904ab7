import random

import pytest

from notewarp.llm import mixing as M

rng = random.Random(2)


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), budget * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if target[s] + share * w[s] > cap * sizes[s]}
        for s in open_ - over if over else open_:
            if not over:
                target[s] += share * w[s]
        if not over:
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= over
    return target


@pytest.fixture
def docs(docs_of):
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "Z", "é", None, "empty", "tiny"])
        n = 0 if source == "empty" else 1 if source == "tiny" else rng.randint(1, 60)
        rows.append((i, " ".join(["w"] * n) if n else rng.choice([None, " ", ""]), None, source))
    return docs_of(rows)


def test_targets_and_takes(docs):
    got = M.mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 60
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(docs):
    a, b = (sorted((r["doc_id"], r["taken"]) for r in M.mix(d).collect()) for d in (docs, docs.repartition(7, "source")))
    assert a == b


def test_repeated_rows_and_nulls(docs_of):
    rows = [(1, "a b c", None, "s")] * 50 + [(None, "a b", None, "s")] * 20 + [(2, "x y z q", None, None)] * 3
    docs = docs_of(rows)
    got = M.mix(docs, budget=0.5).collect()
    assert len(got) == 73
    for s in ("s", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4
    out = M.mixed(docs, budget=0.5)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)


def test_empty_and_wordless(docs_of):
    assert M.mix(docs_of([(1, "a", None, "s")]).where("false")).collect() == []
    got = M.mix(docs_of([(1, None, None, "s"), (2, " ", None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_mixed_takes_what_mix_says_and_leaves_texts_in_place(spark, docs):
    more = docs.unionByName(docs.where("doc_id % 7 = 0"))
    taken = {}
    for r in M.mix(more).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copies"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # far less than the copies of all documents
        out = M.mixed(more)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in taken.items() if v}
    assert "SortMergeJoin" not in plan.split("== Initial Plan ==")[0]
