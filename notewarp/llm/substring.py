"""Substring deduplication by compaction of a De Bruijn graph of words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitfilter, graph
from .common import Scratch, by_value, hot_join, process_store, small_batches
from .textnp import BASE_WORD, Words, grams, slices, spans

by_value(__name__)

#: Words of the shorter runs of which each window takes its least as anchor.
ANCHOR = 16
#: A span has fewer windows than this (k - ANCHOR + 1 at most for k up to 79), so that a place in it fits beside its number.
PLACES = 64


def least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` consecutive values and its position, the leftmost of equals, by doubling."""
    v, at, have = values.copy(), np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(v) - step
        if n <= 0:
            return v[:0], at[:0]
        right = v[step:] < v[:n]
        v, at = np.where(right, v[step:], v[:n]), np.where(right, at[step:], at[:n])
        have += step
    return v, at


def word_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    return w.hashes(), spans(w.data, w.starts, w.ends, BASE_WORD)


def cut_at_anchors(w: Words, k: int):
    """The spans of a slice: (text, first window, windows, anchor, two hashes of all words covered).

    A span is a run of windows of k words of one text that share their anchor, the least hash among their runs of ANCHOR
    words, and the last span ends with its text. Equal windows have equal anchors.
    """
    one, two = word_hashes(w)
    n = len(one)
    if n < k:
        return None
    anchors = spans(one, np.arange(n - ANCHOR + 1), np.arange(n - ANCHOR + 1) + ANCHOR, BASE_WORD)
    _, at = least(anchors, k - ANCHOR + 1)
    each = np.maximum(w.count() - k + 1, 0)
    total = np.concatenate([[0], np.cumsum(each)])
    if not total[-1]:
        return None
    windows = np.repeat(w.first[:-1] - total[:-1], each) + np.arange(total[-1])
    at = at[windows]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[total[:-1][each > 0]] = True
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    first = windows[begin]
    text = np.searchsorted(total, begin, "right") - 1
    return text, first - w.first[text], count, anchors[at[begin]], *(spans(h, first, first + count + k - 1, BASE_WORD) for h in (one, two))


def kept_hashes(w: Words, keep: np.ndarray) -> list[str]:
    """SHA-256 of the kept words of each text, joined by one space."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts[keep]] += 1
    inside[w.ends[keep]] -= 1
    take = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    base = np.repeat(before[w.first[:-1]], w.count())
    gaps = w.starts[keep & (before[:-1] > base)] - 1
    data = w.data.copy()
    data[gaps], take[gaps] = 32, True
    return [hashlib.sha256(data[a:b][take[a:b]].tobytes()).hexdigest() for a, b in zip(w.offsets[:-1], w.offsets[1:])]


def spans_of(k: int):
    """Rows (kind d: document, words, SHA-256 of them all; kind e: span with its place in its document)."""
    names = ["kind", "doc_id", "rk", "first", "windows", "anchor", "s1", "s2", "sha"]

    def run(batches):
        process_store("text")
        for batch in batches:
            for a, b, data, offsets in slices(batch["text"]):
                w = Words(data, offsets, lower=False)
                doc, rk = batch["doc_id"].slice(a, b - a), batch["rk"].slice(a, b - a)
                n, none = b - a, pa.nulls(b - a, pa.int64())
                sha = pa.array(kept_hashes(w, np.ones(len(w.starts), bool)))
                yield pa.RecordBatch.from_arrays([const("d", n), doc, rk, pa.array(w.count().astype(np.int32)), pa.nulls(n, pa.int32()), none, none, none, sha], names)
                if found := cut_at_anchors(w, k):
                    text, first, count, *hashes = found
                    at = np.flatnonzero(~np.asarray(doc.is_null())[text])  # a row without doc_id is compared with none
                    text = pa.array(text[at])
                    cols = [pa.array(x[at].astype(np.int32)) for x in (first, count)] + [pa.array(h[at].view(np.int64)) for h in hashes]
                    yield pa.RecordBatch.from_arrays([const("e", len(at)), doc.take(text), rk.take(text), *cols, pa.nulls(len(at), pa.string())], names)

    def const(value, n):
        return pa.array([value]).take(pa.array(np.zeros(n, np.int32)))

    return run


def edges_of(k: int):
    """The k-word edges of spans at their source places: two hashes of the edge, those of its two (k-1)-word nodes, span and place in it, the span's bounds."""

    def run(batches):
        process_store("text")
        for batch in batches:
            for a, b, data, offsets in slices(batch["text"]):
                w = Words(data, offsets, lower=False)
                one, two = word_hashes(w)
                edge, first = grams(one, w.first, k)
                other, _ = grams(two, w.first, k)
                node, node_first = grams(one, w.first, k - 1)
                at, nodes, of, place, bounds = [], [], [], [], []
                for i in range(a, b):
                    for x in batch["cut"][i].as_py():
                        steps = np.arange(x["windows"])
                        at.append(steps + x["first"] + first[i - a])
                        nodes.append(steps + x["first"] + node_first[i - a])
                        of.append(np.full(x["windows"], x["sid"]))
                        place.append(steps)
                        bounds.append(np.repeat([[x["low"]], [x["high"]]], x["windows"], axis=1))
                if at:
                    at, nodes = np.concatenate(at), np.concatenate(nodes)
                    cols = [x.view(np.int64) for x in (edge[at], other[at], node[nodes], node[nodes + 1])]
                    cols += [np.concatenate(of) * PLACES + np.concatenate(place), *np.concatenate(bounds, axis=1)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["h1", "h2", "u", "v", "at", "low", "high"])

    return run


def word_digests(w: Words, i: int, asked: list[dict], k: int, plain: bytes, start: np.ndarray) -> list[bytes]:
    """BLAKE2b of the words, joined by one space, of the asked places of text ``i`` of a slice."""
    out = []
    for x in asked:
        low, high = w.first[i] + x["first"], w.first[i] + x["first"] + x["windows"] + k - 2
        out.append(hashlib.blake2b(plain[start[low] : start[high] + w.ends[high] - w.starts[high]], digest_size=16).digest())
    return out


def plain_words(w: Words) -> tuple[bytes, np.ndarray]:
    """The words of a slice with one space behind each inner one, and where each begins."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    take = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    data = np.where(take, w.data, np.uint8(32))
    take[w.ends[w.ends < len(data)]] = True
    return data[take].tobytes(), (np.cumsum(take) - take)[w.starts]


def remove(k: int):
    """The text of each row without the words of its spans, as count and SHA-256, and the digests of the places that it asks for."""
    names = ["doc_id", "rk", "n_removed", "kept_sha256", "digests"]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("windows", pa.int32()), ("digest", pa.binary())]))

    def run(batches):
        process_store("text")
        for batch in batches:
            for a, b, data, offsets in slices(batch["text"]):
                w = Words(data, offsets, lower=False)
                change = np.zeros(len(w.starts) + 1, np.int64)
                plain, start = plain_words(w)
                found = []
                for i in range(a, b):
                    for x in batch["spans"][i].as_py() or ():
                        change[w.first[i - a] + x["first"]] += 1
                        change[w.first[i - a] + x["first"] + x["windows"] + k - 1] -= 1
                    asked = batch["asked"][i].as_py()
                    found.append([x | {"digest": d} for x, d in zip(asked, word_digests(w, i - a, asked, k, plain, start))])
                gone = np.cumsum(change[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                cols = [pa.array(removed.astype(np.int64)), pa.array(kept_hashes(w, ~gone)), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["rk"].slice(a, b - a), *cols], names)

    return run


def compact(scratch: Scratch, edges: DataFrame, spans_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repeated edges (h1, h2, run, place in it) and the runs they compact to: nonbranching paths of the graph.

    ``edges``: h1, h2, u, v, at, low, high of every edge of ``spans_`` (sid, doc_id, rk, first: where its source is). Edges that two
    documents share, between (k-1)-word nodes, make the graph; a node with one edge in and one edge out does not branch.
    Edges that follow each other in one source across such nodes are a run; runs (run, doc_id, rk, first, windows, u, v) that meet
    at such a node are one path, found by joins on the node (``path``: the least run of it, by ``graph.components``).
    """
    repeated = edges.groupBy("h1", "h2").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min_by("at", "low").alias("at"), F.first("u").alias("u"), F.first("v").alias("v")
    )
    repeated = scratch.table(repeated.where("low < high").drop("high", "low"), "repeated")
    ends = repeated.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(repeated.select(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    through = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 and i = 1").select("node")
    through = scratch.table(through, "through")
    place = spans_.select("sid", "doc_id", "rk", F.col("first").alias("_first"))
    there = repeated.withColumn("sid", F.shiftright("at", PLACES.bit_length() - 1)).join(place, "sid").withColumn("pos", (F.col("_first") + F.col("at").bitwiseAND(F.lit(PLACES - 1))).cast("int"))
    there = there.join(through.withColumn("_through", F.lit(True)), F.col("u") == F.col("node"), "left")
    order = Window.partitionBy("doc_id", "rk").orderBy("pos")
    fresh = F.col("_through").isNull() | F.coalesce(F.lag("pos").over(order) != F.col("pos") - 1, F.lit(True))
    there = there.select("h1", "h2", "u", "v", "doc_id", "rk", "pos", F.sum(fresh.cast("int")).over(order).alias("no"))
    there = scratch.table(there, "steps")
    runs = there.groupBy("doc_id", "rk", "no").agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("windows"), F.min_by("u", "pos").alias("u"), F.max_by("v", "pos").alias("v"))
    runs = scratch.table(runs.withColumn("run", F.monotonically_increasing_id()), "runs")
    met = runs.select("run", F.col("v").alias("node")).join(through, "node").join(runs.select(F.col("run").alias("next"), F.col("u").alias("node")), "node")
    paths = scratch.table(graph.components(scratch, met.select(F.col("run").alias("u"), F.col("next").alias("v")), "paths"), "path")
    steps = there.join(runs.select("doc_id", "rk", "no", "run", F.col("first").alias("_first")), ["doc_id", "rk", "no"])
    steps = scratch.table(steps.select("h1", "h2", "run", (F.col("pos") - F.col("_first")).alias("step")), "graph")
    runs = runs.join(paths.select(F.col("node").alias("run"), F.col("label").alias("path")), "run", "left").withColumn("path", F.coalesce("path", "run"))
    scratch.free("repeated", "through", "steps")
    return steps, scratch.table(runs, "compacted")


def cleaned(scratch: Scratch, found: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, rk, n_removed, kept_sha256) of the texts with repeated spans. The words of each are compared with those at its
    source, by BLAKE2b of both, which one pass over the texts makes; where they differ that is an error."""
    here = found.select("doc_id", "rk", "first", "windows", F.lit(True).alias("own"))
    there = found.select(*[F.col(f"source.{c}").alias(c) for c in ("doc_id", "rk", "first")], "windows", F.lit(False).alias("own"))
    place = F.struct("first", "windows")
    asked = here.unionByName(there).groupBy("doc_id", "rk").agg(F.collect_set(place).alias("asked"), F.collect_set(F.when(F.col("own"), place)).alias("spans"))
    done = texts.join(asked, ["doc_id", "rk"]).select("doc_id", "rk", "text", "spans", "asked")
    schema = "doc_id long, rk long, n_removed long, kept_sha256 string, digests array<struct<first:int,windows:int,digest:binary>>"
    done = scratch.table(done.mapInArrow(remove(k), schema), "done")
    made = done.select("doc_id", "rk", F.explode("digests").alias("d")).select("doc_id", "rk", "d.*")
    keys = ["s_doc", "s_rk", "s_first", "windows"]
    pairs = found.select("doc_id", "rk", "first", "windows", *[F.col(f"source.{c}").alias(n) for c, n in zip(("doc_id", "rk", "first"), keys)])
    # a source of very many places meets few different digests of them
    pairs = pairs.join(made, ["doc_id", "rk", "first", "windows"]).groupBy(*keys, "digest").agg(F.count(F.lit(1)).alias("n"))
    source = made.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "rk", "first"), keys)], "windows", F.col("digest").alias("_digest"))
    n, same = found.count(), pairs.join(source, keys).where("digest = _digest").agg(F.sum("n")).first()[0] or 0
    if same != n:
        raise RuntimeError(f"{n - same} of {n} repeated spans differ from their sources")
    return done.select("doc_id", "rk", "n_removed", "kept_sha256")


def repeated_spans(docs: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Scratch]:
    """The documents with their word counts, the repeated spans, the texts that have any, the compacted runs, and the folder of all.

    ``docs``: doc_id, text. Words are runs without white space, unchanged. A repeated span (doc_id, rk, first, windows, source) is
    ``windows`` consecutive windows of ``k`` words of a row from word ``first`` on, which stand at the place ``source`` of a document
    of a smaller doc_id as well. ``rk`` is a hash that tells rows of one doc_id apart.

    1. Each text is cut into spans at its anchors; a window has one anchor by its content, so equal windows meet by anchor.
       Anchors that one document alone has go.
    2. An anchor with one span for all its documents is a path as it is. The spans of other anchors are cut, once each, into k-word
       edges between (k-1)-word nodes, the De Bruijn graph of what may repeat; ``compact`` finds the repeated ones and their nonbranching runs.
    3. A span gets back the runs that its edges are on. Each occurrence of it in a document larger than a run's source
       is repeated there. ``cleaned`` compares the words at both places.

    Anchors, spans and sources that make up more than a HOT-th of their tables stay where they are (``hot_join``).
    """
    if not ANCHOR < k < ANCHOR + PLACES:
        raise ValueError(f"a window has {ANCHOR + 1} to {ANCHOR + PLACES - 1} words")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring")
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("rk"))
    schema = "kind string, doc_id long, rk long, first int, windows int, anchor long, s1 long, s2 long, sha string"
    scratch.table(docs.mapInArrow(spans_of(k), schema), "rows", by="kind")
    rows = spark.read.schema(schema).parquet(scratch.path("rows"))
    base = rows.where("kind = 'd'").select("doc_id", "rk", F.col("first").cast("long").alias("n_words"), "sha")
    pieces = rows.where("kind = 'e'").select("anchor", "s1", "s2", "doc_id", "rk", "first", "windows")

    some = pieces.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), ((F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))).alias("branches"), F.count(F.lit(1)).alias("n"))
    some = scratch.table(some.where("_low < _high").select("anchor", "branches", "n"), "anchors")
    shared = scratch.table(hot_join(pieces, some, ["anchor"], "n", pieces.count()), "shared")
    # the source is one place in the smallest document
    found = shared.groupBy("anchor", "s1", "s2").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("high"), F.first("windows").alias("windows"), F.first("branches").alias("branches"), F.min(F.struct("doc_id", "rk", "first")).alias("src")
    )
    found = found.select("anchor", "s1", "s2", "n", F.col("src.doc_id").alias("low"), "high", "windows", "branches", "src.rk", "src.first")
    found = scratch.table(found.withColumn("sid", F.monotonically_increasing_id()), "spans")
    scratch.free("anchors", "rows/kind=e")
    origin = found.select("sid", F.col("low").alias("doc_id"), "rk", "first")

    involved = scratch.table(shared.select("doc_id", "rk").distinct(), "involved")
    texts = docs.mapInArrow(bitfilter.rows(bitfilter.build(involved, "rk"), "rk"), docs.schema)
    texts = scratch.buckets(texts.join(involved, ["doc_id", "rk"], "left_semi").dropDuplicates(["doc_id", "rk"]), "texts", "doc_id", "rk")
    scratch.free("involved")
    cut = found.where("branches").groupBy(F.col("low").alias("doc_id"), "rk").agg(F.collect_list(F.struct("sid", "first", "windows", "low", "high")).alias("cut"))
    edges = texts.join(cut, ["doc_id", "rk"]).select("text", "cut").mapInArrow(edges_of(k), "h1 long, h2 long, u long, v long, at long, low long, high long")
    edges = scratch.table(edges, "edges")
    steps, runs = compact(scratch, edges, origin)

    on = edges.select("h1", "h2", "at").join(steps, ["h1", "h2"]).withColumns({"sid": F.shiftright("at", PLACES.bit_length() - 1), "i": F.col("at").bitwiseAND(F.lit(PLACES - 1)).cast("int")})
    # places of a span that go on along a run are one stretch
    on = on.groupBy("sid", "run", (F.col("i") - F.col("step")).alias("off")).agg(F.collect_set("i").alias("is"))
    on = on.select("sid", "run", "off", F.explode(stretches(F.sort_array("is"))).alias("x")).select("sid", "run", "off", "x.i", "x.windows")
    on = on.join(runs.select("run", F.col("doc_id").alias("_doc"), F.col("rk").alias("_rk"), F.col("first").alias("_at")), "run")
    place = F.struct(F.col("_doc").alias("doc_id"), F.col("_rk").alias("rk"), (F.col("_at") + F.col("i") - F.col("off")).cast("int").alias("first"))
    on = on.groupBy("sid").agg(F.collect_list(F.struct("i", "windows", place.alias("source"))).alias("on"))
    own = F.array(F.struct(F.lit(0).alias("i"), "windows", F.struct(F.col("low").alias("doc_id"), "rk", "first").alias("source")))
    along = found.join(on, "sid", "left").withColumn("on", F.when(F.col("branches"), F.col("on")).otherwise(own)).where("on is not null")
    along = scratch.table(along.select("anchor", "s1", "s2", "on", "n"), "along")
    hits = hot_join(shared.select("anchor", "s1", "s2", "doc_id", "rk", "first"), along, ["anchor", "s1", "s2"], "n", shared.count())
    hits = hits.select("doc_id", "rk", "first", F.explode(F.filter("on", lambda x: x["source"]["doc_id"] < F.col("doc_id"))).alias("x"))
    hits = scratch.table(hits.select("doc_id", "rk", (F.col("first") + F.col("x.i")).alias("first"), "x.windows", "x.source"), "found")
    scratch.free("shared", "spans", "edges", "graph", "along")
    return base, hits, texts, runs, scratch


def stretches(places: Column) -> Column:
    """The runs (i, windows) of consecutive numbers in a sorted array of at most PLACES."""
    begins = F.filter(places, lambda i: ~F.array_contains(places, i - 1))
    ends = F.filter(places, lambda i: ~F.array_contains(places, i + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("i"), (b - a + 1).alias("windows")))


def remove_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text; more columns are ignored).

    Each word that a repeated window of ``k`` words covers is removed (see ``repeated_spans``); windows are judged on the
    input. Null and empty texts have no words, texts under ``k`` words no window. Repeated rows, having one doc_id,
    don't make each other repeated, and give repeated rows. A row without doc_id keeps its words and makes none go.
    Empty input: empty result.
    """
    with small_batches(docs.sparkSession):
        base, found, texts, _, scratch = repeated_spans(docs, k)
        out = base.join(cleaned(scratch, found, texts, k), ["doc_id", "rk"], "left")
        out = out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
        out = scratch.table(out, "removed")
    scratch.free("rows", "texts", "found", "done", "runs", "compacted", "path")
    return out


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
