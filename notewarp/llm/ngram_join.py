"""N-gram Jaccard join and its components by a token-group matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitfilter, graph
from .common import Plain, Scratch, by_value, hot_join, process_store, small_batches, thrifty
from .textnp import Words, mix64, shingle_sets, slices

by_value(__name__)

SKETCH_BITS = 18
#: Parts into which the posting list of a frequent token is dealt.
SALT = 32
#: Documents in a group of the matrix.
GROUP = 32


def sets_of(column: pa.Array, k: int):
    """(first row, last row, tokens sorted by row, first token of each row, class id of each row's set)."""
    process_store("text")
    for a, b, data, offsets in slices(column):
        w = Words(data, offsets, lower=True)
        tokens, first = shingle_sets(w.hashes(), w.first, k)
        both = np.zeros((2, len(tokens) + 1), np.uint64)
        np.cumsum(mix64(tokens), out=both[0, 1:])
        n = np.diff(first)
        rid = mix64(both[0, first[1:]] - both[0, first[:-1]] + n.astype(np.uint64)).view(np.int64)
        yield a, b, tokens, first, rid


def sketch_bucket(tokens: np.ndarray) -> np.ndarray:
    return (mix64(tokens ^ np.uint64(0xA5A5A5A5)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def meeting(n):
    """Posted tokens that two linked sets share at least, by the size of the smaller: prefixes are longer for its sake."""
    return 1 + n // 20


def survey(k: int):
    """Rows (kind d: doc_id, hash of the text, class id, set size; kind s: sketch bucket, count)."""

    def run(batches):
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        for batch in batches:
            for a, b, tokens, first, rid in sets_of(batch["text"], k):
                n = np.diff(first)
                fresh = np.zeros(b - a, bool)
                for i, r in enumerate(rid.tolist()):
                    if r not in seen:
                        seen.add(r)
                        fresh[i] = True
                counts += np.bincount(sketch_bucket(tokens[np.repeat(fresh, n)]), minlength=len(counts))
                yield rows("d", batch["doc_id"].slice(a, b - a), batch["_text_hash"].slice(a, b - a), rid, n)
        at = np.flatnonzero(counts)
        yield rows("s", pa.array(at), pa.array(counts[at]), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))

    def rows(kind, a, b, c, n):
        kinds = pa.array([kind]).take(pa.array(np.zeros(len(n), np.int32)))
        return pa.RecordBatch.from_arrays([kinds, a.cast(pa.int64()), b, pa.array(c), pa.array(n.astype(np.int64))], ["kind", "a", "b", "c", "n"])

    return run


def postings(k: int, level: np.ndarray, percent: int):
    """Rows (token, class id, set size): the prefix of each set, its rarest tokens, of which a similar set has one at least."""

    def run(batches):
        seen = set()
        for batch in batches:
            for a, b, tokens, first, rid in sets_of(batch["text"], k):
                # the token in the global order: level of frequency, then hash
                tokens = (tokens >> np.uint64(3)) | (level[sketch_bucket(tokens)].astype(np.uint64) << np.uint64(61))
                out, who = [], []
                for i, r in enumerate(rid.tolist()):
                    n = int(first[i + 1] - first[i])
                    if not n or r in seen:
                        continue
                    seen.add(r)
                    p = min(n, n - -(-n * percent // 100) + meeting(n))
                    x = tokens[first[i] : first[i + 1]]
                    out.append(np.partition(x, p - 1)[:p] if p < n else x)
                    who.append(i)
                if out:
                    each = [len(x) for x in out]
                    at = np.repeat(who, each)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out).view(np.int64)), pa.array(rid[at]), pa.array(np.diff(first)[at].astype(np.int32))],
                        ["token", "rid", "n"],
                    )

    return run


def class_bits(k: int):
    """Rows (class id, set size, bits, odd), one for each class in a task.

    The token space is cut into at least four times as many ranges as the set has tokens. ``bits`` tells which ranges have
    tokens, ``odd`` which have an odd number.
    """

    def run(batches):
        seen = set()
        for batch in batches:
            for _, _, tokens, first, rid in sets_of(batch["text"], k):
                out = []
                for i, r in enumerate(rid.tolist()):
                    if first[i + 1] > first[i] and r not in seen:
                        seen.add(r)
                        out.append((r, int(first[i + 1] - first[i]), *row_bits(tokens[first[i] : first[i + 1]])))
                schema = pa.schema([("rid", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("odd", pa.binary())])
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

    return run


def row_bits(tokens: np.ndarray) -> tuple[bytes, bytes]:
    width = max(6, int(4 * len(tokens) - 1).bit_length())
    count = np.bincount((mix64(tokens) >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width)
    return np.packbits(count > 0).tobytes(), np.packbits(count % 2 == 1).tobytes()


def unpacked(row: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row, np.uint8))


def fold(row: np.ndarray, m: int, how=np.bitwise_or) -> np.ndarray:
    """Rows of the matrix over the m ranges of a shorter one: ranges of tokens join, counts of odd ones add up."""
    return row if row.shape[-1] == m else how.reduce(row.reshape(*row.shape[:-1], m, -1), axis=-1)


def bound_pairs(percent: int):
    """Of rows (u, v, n_u, n_v, odd_u, odd_v) those that may link.

    A range of which one set has an odd and the other an even number of tokens holds a token that only one has, so such
    ranges are at most as many as the tokens in which the sets differ.
    """

    def run(batches):
        for batch in batches:
            u, v = batch["n_u"].to_pylist(), batch["n_v"].to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch["odd_u"].to_pylist(), batch["odd_v"].to_pylist())):
                if 100 * min(u[i], v[i]) < percent * max(u[i], v[i]):
                    continue
                x, y = unpacked(x), unpacked(y)
                m = min(len(x), len(y))
                apart = int((fold(x, m, np.bitwise_xor) ^ fold(y, m, np.bitwise_xor)).sum())
                if (100 + percent) * apart <= (100 - percent) * (u[i] + v[i]):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["u"].take(keep), batch["v"].take(keep)], ["u", "v"])

    return run


def matrix(key, table):
    """A group of some ``GROUP`` classes at most: its members, their odd ranges and the union of their tokens' ranges."""
    bits, odd = ([unpacked(x) for x in table[c].to_pylist()] for c in ("bits", "odd"))
    m = min(map(len, bits))
    union = np.packbits(np.bitwise_or.reduce([fold(x, m) for x in bits])).tobytes()
    rows = [np.packbits(fold(x, m, np.bitwise_xor)).tobytes() for x in odd]
    one = {"gid": [key[0].as_py()], "rids": [table["rid"].to_pylist()], "ns": [table["n"].to_pylist()], "rows": [rows], "union": [union]}
    return pa.table(one, pa.schema([("gid", pa.int64()), ("rids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32())), ("rows", pa.list_(pa.binary())), ("union", pa.binary())]))


def open_groups(percent: int):
    """Of rows (u, n, odd, gid, twice, rids, ns, rows, union) the pairs (u, member) that may link.

    A group is opened if the overlap of the query with its union can reach the threshold. Where two queries
    ask each other's groups (``twice``), only the smaller finds the other.
    """

    def run(batches):
        last, group = None, None
        for batch in batches:
            left, right = [], []
            cols = {c: batch[c] for c in ("u", "n", "odd", "gid", "twice")}
            for i in range(len(batch)):
                u, n, odd, gid, twice = (cols[c][i].as_py() for c in ("u", "n", "odd", "gid", "twice"))
                if gid != last:
                    rids, ns = (np.array(batch[c][i].as_py(), np.int64) for c in ("rids", "ns"))
                    last, group = gid, (rids, ns, np.stack([unpacked(x) for x in batch["rows"][i].as_py()]), unpacked(batch["union"][i].as_py()))
                rids, ns, rows, union = group
                x = unpacked(odd)
                m = min(len(x), len(union))
                if 100 * (n - int((fold(x, m) & ~fold(union, m) & 1).sum())) < percent * n:
                    continue
                apart = (fold(x, m, np.bitwise_xor) ^ fold(rows, m, np.bitwise_xor)).sum(axis=1)
                ok = ((100 + percent) * apart <= (100 - percent) * (n + ns)) & (100 * np.minimum(n, ns) >= percent * np.maximum(n, ns))
                if twice:
                    ok &= rids > u
                right.extend(rids[ok].tolist())
                left.extend([u] * int(ok.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return run


def class_texts(k: int, wanted: np.ndarray):
    """Rows (class id, text), one for each class in a task, of those that the filter ``wanted`` lets pass."""

    def run(batches):
        seen = set()
        for batch in batches:
            for a, b, _, first, rid in sets_of(batch["text"], k):
                keep = []
                for i in np.flatnonzero(bitfilter.hit(wanted, rid) & (np.diff(first) > 0)).tolist():
                    if rid[i] not in seen:
                        seen.add(rid[i])
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(rid[keep]), batch["text"].slice(a, b - a).take(pa.array(keep, pa.int64()))], ["rid", "text"])

    return run


def compare(k: int, percent: int):
    """Of rows (u, v, text_u, text_v) those that link, as (u, v)."""

    def run(batches):
        for batch in batches:
            for a, b, left, lf, _ in sets_of(batch["text_u"], k):
                at = a
                for c, d, right, rf, _ in sets_of(batch["text_v"].slice(a, b - a), k):
                    keep = []
                    for i in range(c, d):
                        x, y = left[lf[i] : lf[i + 1]], right[rf[i - c] : rf[i - c + 1]]
                        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                            continue
                        both = common(x, y)
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            keep.append(at + i)
                    yield pa.RecordBatch.from_arrays([batch[c_].take(pa.array(keep, pa.int64())) for c_ in ("u", "v")], ["u", "v"])

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for every row of ``docs`` (doc_id, text; more columns are ignored).

    Documents whose sets of ``k``-word shingles have 100 * intersection >= ``percent`` * union are linked; component_id
    is the smallest doc_id reachable. The method is a token-group matrix:

    1. Documents of equal sets are one class. A count sketch over all shingles orders the tokens, rare before frequent.
    2. Each class posts its prefix, the rarest tokens, of which two similar sets share some at least (prefix filter).
       A token that one class alone posts goes. Of each token's classes the most central leads, the one whose tokens are
       shared the most; a class joins the cluster of the leader that it meets most often and is compared with it. The
       linked ones are components.
    3. Clusters are cut into groups of some ``GROUP`` classes, of one component or without links so far. A group stores the
       union of its tokens and the parities of its members' tokens as rows of a bit matrix over ranges of the token space. A class
       asks the groups of its cluster and those with which it shares as many posted tokens as a link would, if their members
       are of other components. The overlap with the union bounds that with any member; only groups that qualify are opened, their
       members bounded by their own rows, and what is left is compared.

    All comparisons are exact counts over the shingles of whole texts, each shingle known by a 64-bit hash. Null or empty texts, and texts without words, have
    an empty set and no link. Repeated rows give repeated rows. A null doc_id never names a component unless its class
    has no other. Empty input: empty result. Memory: one slice of texts, or the longest text, at a time.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    with small_batches(docs.sparkSession):
        return _components(scratch, docs, k, percent)


def _components(scratch: Scratch, docs: DataFrame, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_text_hash"))
    scratch.table(docs.mapInArrow(thrifty(survey(k)), "kind string, a long, b long, c long, n long"), "survey", by="kind")
    rows = scratch.spark.read.schema("a long, b long, c long, n long, kind string").parquet(scratch.path("survey"))
    table = rows.where("kind = 'd'").select(F.col("a").alias("doc_id"), F.col("b").alias("text_hash"), F.col("c").alias("rid"), "n")

    # the sketch has a fixed number of buckets
    sketch = rows.where("kind = 's'").groupBy("a").agg(F.sum("b").alias("b")).toPandas()
    counts = np.zeros(1 << SKETCH_BITS)
    counts[sketch["a"].to_numpy(np.int64)] = sketch["b"]
    usual = np.median(counts)
    over = counts - usual - 6 * np.sqrt(usual + 1)
    level = np.zeros(len(counts), np.uint8)
    for step in (1, 4, 16):
        level += over > 0 if step == 1 else over > step * 6 * np.sqrt(usual + 1)

    text = docs.select("text")
    posted = text.mapInArrow(thrifty(postings(k, level, percent)), "token long, rid long, n int")
    frequent = F.shiftrightunsigned("token", 61) > 0
    # what a frequent token has is dealt over SALT parts, so that none holds all of it
    posted = posted.withColumn("salt", F.when(frequent, F.pmod("rid", F.lit(SALT))).otherwise(0).cast("int"))
    part = Window.partitionBy("token", "salt")
    posted = posted.withColumns({"_a": F.min("rid").over(part), "_b": F.max("rid").over(part), "size": F.count(F.lit(1)).over(part)})
    posted = posted.where(frequent | (F.col("_a") != F.col("_b")))
    posted = scratch.table(posted.select("token", "rid", "n", "size"), "postings")
    # the class whose tokens most others post too leads
    central = posted.groupBy("rid").agg((F.sum("size") / F.max("n")).alias("central"))
    tops = posted.join(central, "rid").groupBy("token")
    tops = tops.agg(F.max(F.struct("central", "rid"))["rid"].alias("leader"), F.min("rid").alias("_a"), F.max("rid").alias("_b"))
    tops = scratch.table(tops.where("_a != _b").select("token", "leader"), "tops")
    meets = posted.join(tops, "token").groupBy("rid", "leader").agg(F.count(F.lit(1)).alias("_n"))
    meets = meets.groupBy("rid").agg(
        F.max(F.struct("_n", "leader"))["leader"].alias("cluster"),
        F.max(F.when(F.col("rid") != F.col("leader"), F.struct("_n", "leader")))["leader"].alias("v"),
    )
    meets = scratch.table(meets, "meets")
    best = meets.where("v is not null").select(F.col("rid").alias("u"), "v")

    involved = meets.select("rid")
    bits = text.mapInArrow(thrifty(class_bits(k)), "rid long, n int, bits binary, odd binary").join(involved, "rid", "left_semi").dropDuplicates(["rid"])
    bits = scratch.table(bits, "bits")

    def bounded(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bits.select(F.col("rid").alias("u"), F.col("n").alias("n_u"), F.col("odd").alias("odd_u")), "u")
        both = both.join(bits.select(F.col("rid").alias("v"), F.col("n").alias("n_v"), F.col("odd").alias("odd_v")), "v")
        return both.select("u", "v", "n_u", "n_v", "odd_u", "odd_v").mapInArrow(thrifty(bound_pairs(percent)), "u long, v long")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, by their texts."""
        both = scratch.table(pairs, f"bound_{name}")
        want = scratch.table(both.select(F.explode(F.array("u", "v")).alias("rid")).distinct(), f"want_{name}")
        texts = text.mapInArrow(thrifty(class_texts(k, bitfilter.build(want, "rid"))), "rid long, text string").join(want, "rid", "left_semi").dropDuplicates(["rid"])
        texts = scratch.table(texts, f"texts_{name}")
        both = both.join(texts.select(F.col("rid").alias("u"), F.col("text").alias("text_u")), "u")
        both = both.join(texts.select(F.col("rid").alias("v"), F.col("text").alias("text_v")), "v")
        both = both.select("u", "v", "text_u", "text_v").mapInArrow(thrifty(compare(k, percent)), "u long, v long")
        return scratch.table(both, f"links_{name}")

    first = linked(bounded(best), "leaders")
    comps = scratch.table(graph.components(scratch, first, "cc_a"), "components1")

    # groups: of one cluster, and of one component or of classes that have no link yet
    info = bits.select("rid", "n").join(meets.select("rid", "cluster"), "rid").join(comps.withColumnRenamed("node", "rid"), "rid", "left")
    sizes = info.groupBy("cluster", "label").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_parts"))
    on = (F.col("cluster") == F.col("_c")) & F.col("label").eqNullSafe(F.col("_l"))
    info = info.join(sizes.select(F.col("cluster").alias("_c"), F.col("label").alias("_l"), "_parts"), on)
    info = info.withColumn("gid", F.xxhash64("cluster", "label", F.pmod(F.xxhash64("rid"), "_parts")))
    info = scratch.table(info.select("rid", "n", "cluster", "label", "gid"), "members")
    # a class without a link asks all groups, one of a component those of the components after its own
    rule = F.col("_from").isNull() | (F.col("_from") < F.col("label"))
    rule = rule & (100 * F.col("n") >= percent * F.col("_low")) & (percent * F.col("n") <= 100 * F.col("_high"))
    bounds = [F.min("n").alias("_low"), F.max("n").alias("_high")]
    asks = info.select(F.col("rid").alias("u"), "n", F.col("label").alias("_from"), F.col("cluster").alias("_own"))
    inner = info.groupBy("cluster", "gid", "label").agg(*bounds)
    near = asks.join(inner, F.col("_own") == F.col("cluster")).where(rule).select("u", "gid", F.col("label").isNull().alias("twice"))
    posts = posted.select("token", "rid").distinct().join(tops.select("token"), "token").join(info, "rid")
    posts = scratch.table(posts, "posts")
    scratch.free("postings", "tops")
    meet = posts.groupBy("token").agg(F.min("cluster").alias("_a"), F.max("cluster").alias("_b")).where("_a != _b").select("token")
    posts = posts.join(meet, "token")
    cells = posts.groupBy("token", "gid", "label", "cluster").agg(*bounds)
    asks = posts.select("token", F.col("rid").alias("u"), "n", F.col("label").alias("_from"), F.col("cluster").alias("_own"))
    # of two classes without links one asks, that of the smaller cluster
    once = F.col("_from").isNotNull() | F.col("label").isNotNull() | (F.col("_own") < F.col("cluster"))
    across = asks.join(cells, "token").where(rule & once & (F.col("_own") != F.col("cluster"))).groupBy("u", "gid")
    across = across.agg(F.count(F.lit(1)).alias("_met"), F.max("n").alias("_n"), F.min("_low").alias("_low"))
    least = F.floor(F.least("_n", "_low") / 20) + 1
    near = scratch.table(near.unionByName(across.where(F.col("_met") >= least).select("u", "gid", F.lit(False).alias("twice"))), "near")
    opened = info.join(near.select("gid").distinct(), "gid", "left_semi").select("rid", "gid").join(bits, "rid")
    schema = "gid long, rids array<long>, ns array<int>, rows array<binary>, union binary"
    stored = scratch.table(opened.select("gid", "rid", "n", "bits", "odd").groupBy("gid").applyInArrow(matrix, schema), "matrix")
    asked = near.join(bits.select(F.col("rid").alias("u"), "n", "odd"), "u").join(stored, "gid")
    asked = asked.select("u", "n", "odd", "gid", "twice", "rids", "ns", "rows", "union")
    second = linked(asked.mapInArrow(thrifty(open_groups(percent)), "u long, v long"), "groups")
    labels = scratch.table(graph.components(scratch, first.unionByName(second), "cc_b"), "components2")

    # by class first, then by component; classes of many documents and components of many classes stay where they are
    classes = table.where("n > 0").groupBy("rid").agg(F.min("doc_id").alias("_low"), F.count(F.lit(1)).alias("_docs"))
    classes = classes.join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    classes = scratch.table(classes, "classes")
    lows = scratch.table(classes.groupBy("label").agg(F.min("_low").alias("component_id"), F.count(F.lit(1)).alias("_classes")), "lows")
    named = scratch.table(hot_join(classes.drop("_low"), lows, ["label"], "_classes", classes.count()), "named")
    full = hot_join(table.where("n > 0"), named, ["rid"], "_docs", table.count())
    full = full.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("label").alias("class_id"))
    empty = table.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("class_id"))
    out = scratch.table(full.unionByName(empty), "components")
    scratch.free("survey", "meets", "bits", "members", "posts", "near", "matrix", "components1", "components2", "classes", "lows", "named")
    for name in ("leaders", "groups"):
        scratch.free(*[f"{part}_{name}" for part in ("bound", "want", "texts", "links")])
    return out


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row of the smallest doc_id, and every row without words.

    A null doc_id comes last in its component. Of rows repeated with their doc_id and text one stays. Null and empty texts
    have no words. Empty input: empty result.
    """
    found = similarity_components(docs, k, percent)
    empty = found.where("n_shingles = 0").select("doc_id", "text_hash")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_first")
    first = found.where("n_shingles > 0").groupBy("class_id").agg(first).select("_first.doc_id", "_first.text_hash")
    keep = first.unionByName(empty).distinct().select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"))
    plain = Plain(docs)
    hashed = plain.df.withColumns({"_doc": plain["doc_id"], "_text_hash": F.xxhash64(plain["text"])})
    on = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h"))
    kept = hashed.join(keep, on, "left_semi")
    again = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1")
    again = again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"))
    if again.isEmpty():
        return plain.back(kept)
    repeated = kept.join(again, on, "left_semi").dropDuplicates(["_doc", "_text_hash"])
    return plain.back(kept.join(again, on, "left_anti").unionByName(repeated))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similarity_components(docs).select("doc_id", "n_shingles", "component_id")
