"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, by_value, small_batches

by_value(__name__)

#: Vectors that the tree is fitted on at most (those of the least hashes of vec_id), branches of a node, sample vectors that a
#: leaf has at least before it is split, and leaves that are aimed at.
SAMPLE, BRANCHES, LEAF, LEAVES = 16_384, 8, 24, 128
#: Queries for which all vectors are compared to calibrate the number of leaves, and the recall asked of them.
PROBES, RECALL = 256, 0.93
#: Vectors and queries that meet in one task step at most.
BLOCK, ASKED = 1024, 2048


class Tree:
    """A k-means tree over unit vectors: ``centres[i]`` and ``kids[i]`` of node i; leaves are numbered by ``leaf[i]``."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        self.centres, self.kids, self.leaf = [np.zeros(sample.shape[1])], [[]], [-1]
        self.leaves = 0
        rng, todo, most = np.random.default_rng(seed), [(0, sample)], max(LEAF, len(sample) // LEAVES)
        while todo:
            node, rows = todo.pop()
            groups = split(rows, rng) if len(rows) > most else []
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, members in groups:
                self.kids[node].append(len(self.centres))
                todo.append((len(self.centres), members))
                self.centres.append(centre)
                self.kids.append([])
                self.leaf.append(-1)
        self.fan = [np.stack([self.centres[k] for k in kids]) if kids else None for kids in self.kids]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into, going down to the nearest centre."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.fan[node] is None:
                out[at] = self.leaf[node]
            elif len(at):
                best = nearest(rows[at], self.fan[node])
                todo.extend((kid, at[best == j]) for j, kid in enumerate(self.kids[node]))
        return out

    def visits(self, row: np.ndarray):
        """The leaves in the order in which a priority queue of nodes by the cosine of their centres yields them."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.fan[node] is None:
                yield self.leaf[node]
            else:
                for kid, near in zip(self.kids[node], (self.fan[node] @ row).tolist()):
                    heapq.heappush(queue, (-near, kid))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    # summed in one order for each row, so that equal vectors fall into one leaf
    return np.argmax(np.einsum("ij,kj->ik", rows, centres), axis=1)


def split(rows: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spherical k-means of a few steps."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) < 2:
        return []
    centres = distinct[rng.permutation(len(distinct))[:BRANCHES]]
    for _ in range(8):
        best = nearest(rows, centres)
        sums = np.stack([rows[best == j].sum(axis=0) for j in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where((norm > 0)[:, None], sums / np.where(norm > 0, norm, 1)[:, None], centres)
    best = nearest(rows, centres)
    return [(centres[j], rows[best == j]) for j in range(len(centres)) if (best == j).any()]


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1 if len(column) else 1)


def unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)  # keeps squares finite
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two equally long lists of vectors, in double precision, summed alike for each row."""
    a, b = (np.ascontiguousarray(x, np.float64) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def closest(asked: np.ndarray, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, n: int):
    """(query, place of the row, score) of the n best rows for each query, by (score, smaller id), without those of its own id."""
    near = unit(asked) @ unit(rows).T
    near[own[:, None] == ids[None, :]] = -np.inf
    out = []
    for i in range(len(asked)):
        s = near[i]
        if len(s) > n:
            ok = np.flatnonzero((s >= np.partition(s, len(s) - n)[len(s) - n] - 1e-9) & (s > -np.inf))
        else:
            ok = np.flatnonzero(s > -np.inf)
        if len(ok):
            score = cosine(np.broadcast_to(asked[i], rows[ok].shape), rows[ok])
            best = np.lexsort((ids[ok], -score))[:n]
            out.append((np.full(len(best), own[i]), ok[best], score[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def probe_all(own: np.ndarray, asked: np.ndarray, n: int):
    """For mapInArrow: the best of each batch, and their leaves, for a few given queries, by comparison with every vector."""

    def run(batches):
        for batch in batches:
            if len(batch):
                q, at, s = closest(asked, np.array(batch["vec_id"]), own, vectors(batch["embedding"]), n)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), batch["vec_id"].take(at), pa.array(s, pa.float64()), batch["leaf"].take(at)], ["query_id", "vec_id", "score", "leaf"])

    return run


def put_in_leaves(tree: Tree):
    def run(batches):
        for batch in batches:
            leaf = tree.assign(unit(vectors(batch["embedding"]))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch["vec_id"], batch["embedding"]], ["leaf", "vec_id", "embedding"])

    return run


def ask_leaves(tree: Tree, counts: np.ndarray, width: int, n: int):
    """The leaves that each query visits: ``width`` of them, more if they hold fewer than n + 1 vectors."""

    def run(batches):
        for batch in batches:
            leaves, who = [], []
            for i, row in enumerate(unit(vectors(batch["embedding"])) if len(batch) else []):
                seen = 0
                for k, leaf in enumerate(tree.visits(row)):
                    if k >= width and seen > n:
                        break
                    seen += counts[leaf]
                    if counts[leaf]:
                        leaves.append(leaf)
                        who.append(i)
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), batch["vec_id"].take(who), batch["embedding"].take(who)], ["leaf", "query_id", "embedding"])

    return run


def meet(n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, at, s = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        ids = right["vec_id"].combine_chunks()
        if len(left) and len(right):
            asked, rows = (vectors(x["embedding"].combine_chunks()) for x in (left, right))
            q, at, s = closest(asked, np.array(ids), np.array(left["query_id"].combine_chunks()), rows, n)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": ids.take(pa.array(at, pa.int64())).cast(pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def nearest_neighbours(table: DataFrame, every: int = 50, n: int = 5, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the n nearest rows found for each row whose vec_id is divisible by ``every``.

    ``table``: vec_id, embedding; more columns are ignored. Nearness is the largest cosine in double precision on the
    vectors as they are, ties to the smaller vec_id; a query's own row is no candidate, and there are fewer than n rows
    only if there are fewer candidates. Vectors null, empty, zero or with null or non-finite components take no part, nor
    do rows without vec_id or of another dimension than the most frequent one. Each row that repeats a vec_id is a candidate of
    its own; such an id asks once, by the least of its vectors, and all its rows are its own. Empty input: empty result.

    A k-means tree of a bounded sample puts every vector into a leaf. A query goes through the tree with a priority queue
    of nodes by the cosine of their centres and visits leaves in that order. The number of visits is calibrated: for
    PROBES queries all vectors are compared, and the visits widen until they would have found ``recall`` of the true
    neighbours. Leaves and their queries meet in blocks of bounded size, so a leaf of equal vectors is no hot spot.
    """
    with small_batches(table.sparkSession):
        return _search(table, every, n, recall)


def _search(table: DataFrame, every: int, n: int, recall: float) -> DataFrame:
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "ann")
    rows = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = scratch.table(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "rows")
    kind = rows.schema["embedding"].dataType.simpleString()
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    rows = rows.where(F.size("embedding") == size["d"])
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def some(df: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        got = df.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(k).collect()
        return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64).reshape(len(got), -1 if got else 1)

    own, asked = some(queries, PROBES)
    if not len(own):
        return empty
    tree = Tree(unit(some(rows, SAMPLE)[1]))
    index = scratch.table(rows.mapInArrow(put_in_leaves(tree), f"leaf long, vec_id long, embedding {kind}"), "index")
    counts = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a leaf
        counts[r["leaf"]] = r["n"]

    truth = best(index.mapInArrow(probe_all(own, asked, n), "query_id long, vec_id long, score double, leaf long"), n).select("query_id", "leaf").collect()
    place = {q: {leaf: k for k, leaf in enumerate(tree.visits(row))} for q, row in zip(own.tolist(), unit(asked))}
    needed = sorted(place[r["query_id"]][r["leaf"]] + 1 for r in truth) or [1]
    width = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]

    visits = queries.mapInArrow(ask_leaves(tree, counts, width, n), f"leaf long, query_id long, embedding {kind}")
    visits = scratch.table(visits, "visits")
    asked_of = {r["leaf"]: -(-r["n"] // ASKED) for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = spark.createDataFrame([(i, int(max(1, -(-counts[i] // BLOCK))), int(asked_of.get(i, 0))) for i in range(tree.leaves)], "leaf long, b int, a int")

    def dealt(df: DataFrame, id_: str, own_: str, other: str) -> DataFrame:
        """Each row in its own part of the leaf, once for each part of the other side."""
        df = df.join(F.broadcast(blocks), "leaf").where("a > 0")  # leaves are bounded by the sample
        df = df.withColumn(own_ + "_part", F.pmod(F.xxhash64(id_), F.col(own_)).cast("int"))
        return df.withColumn(other + "_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("a", "b")

    cell = ["leaf", "a_part", "b_part"]
    left, right = dealt(visits, "query_id", "a", "b"), dealt(index.withColumn("_row", F.monotonically_increasing_id()), "_row", "b", "a").drop("_row")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet(n), "query_id long, vec_id long, score double")
    found = scratch.table(best(found, n).select("query_id", "rank", "vec_id", "score"), "found")
    scratch.free("rows", "index", "visits")
    return found


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
