"""Semantic, lexical and hybrid search over chunks.

Chunks have chunk_id, file_path, file_type and text, and an embedding where vectors are searched.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.terms import case_variants

#: Queries that are sent to all tasks at once.
QUERY_BLOCK = 1024


def of_type(chunks: DataFrame, file_type: str | None) -> DataFrame:
    return chunks.where(F.col("file_type") == file_type) if file_type else chunks


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """``rank`` from 1; the rows are few, after a limit."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def shown(cosine: str) -> Column:
    return F.round(cosine, 4).alias("score")


def semantic(chunks: DataFrame, vector: list[float], n: int = 10, file_type: str | None = None, chars: int = 300) -> DataFrame:
    """The n chunks of the largest cosine, exact, ties by chunk_id. Zero vectors come last. A scan and a top-k, no shuffle.

    The order is that of the cosine itself; only the reported score is rounded.
    """
    found = of_type(chunks, file_type).withColumn("_near", V.cosine(F.col("embedding"), V.literal(vector)))
    order = [F.col("_near").desc_nulls_last(), F.col("chunk_id")]
    found = found.select("file_path", "chunk_id", "file_type", shown("_near"), X.snippet(F.col("text"), chars).alias("snippet"), "_near")
    return ranked(found.orderBy(*order).limit(n), *order).drop("_near")


def semantic_batch(chunks: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """``semantic`` for a table of queries (query_id, vector): the n best of each by a ranked window with its partial limit.

    The queries are stated ones that go to all tasks, in blocks of QUERY_BLOCK rows by a count of them: each block is an
    array that every chunk is compared with, and what leaves a task is n rows for each query at most.
    """
    numbered = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = -(-numbered.count() // QUERY_BLOCK)
    found = None
    for i in range(max(1, blocks)):
        block = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == i)
        block = block.agg(F.collect_list(F.struct("query_id", "vector")).alias("_asked"))
        pairs = chunks.select("chunk_id", "embedding").join(F.broadcast(block)).select("chunk_id", "embedding", F.explode("_asked").alias("_q"))
        pairs = pairs.select("_q.query_id", "chunk_id", V.cosine(F.col("embedding"), F.col("_q.vector")).alias("_near"))
        found = pairs if found is None else found.unionByName(pairs)
    order = Window.partitionBy("query_id").orderBy(F.col("_near").desc_nulls_last(), "chunk_id")
    found = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
    return found.select("query_id", "rank", "chunk_id", shown("_near"))


def matches(term: str, text: Column, match: str = "variants") -> Column:
    """Whether a text has a term in one of its case variants, or (``ci``) in any case."""
    if match == "ci":
        return F.lower(text).contains(term.lower())
    return reduce(or_, [text.contains(v) for v in case_variants(term)])


def lexical(chunks: DataFrame, terms: list[str], n: int = 10, file_type: str | None = None, chars: int = 300, match: str = "variants") -> DataFrame:
    """The n chunks with the most matching terms, then the largest sum of 1 / (1 + place of the term), then by chunk_id.

    The reported score tells the number of terms only. The predicate reaches the Parquet scan; no shuffle but the top-k.
    """
    if not terms:
        return ranked(lexical(chunks, [""], n, file_type, chars).where("false").drop("rank"), F.lit(1))
    hit = [matches(t, F.col("text"), match) for t in terms]
    found = of_type(chunks, file_type).where(reduce(or_, hit))
    count = reduce(add, [h.cast("int") for h in hit])
    weight = reduce(add, [F.when(h, F.lit(1.0 / (1.0 + i))).otherwise(F.lit(0.0)) for i, h in enumerate(hit)])
    found = found.withColumns({"match_terms": count.cast("long"), "_weight": weight})
    score = F.round(F.least(F.lit(0.99), F.lit(0.80) + F.lit(0.05) * (F.col("match_terms") - 1)), 4)
    order = [F.col("match_terms").desc(), F.col("_weight").desc(), F.col("chunk_id")]
    found = found.select("file_path", "chunk_id", "file_type", score.alias("score"), X.snippet(F.col("text"), chars).alias("snippet"), "match_terms", "_weight")
    return ranked(found.orderBy(*order).limit(n), *order).drop("_weight")


def hybrid(chunks: DataFrame, vector: list[float], terms: list[str], n: int = 10, file_type: str | None = None, chars: int = 300) -> DataFrame:
    """Lexical hits first, then those semantic ones (of 3 n) that are not among them; n in all."""
    by_word = lexical(chunks, terms, n, file_type, chars).withColumns({"source": F.lit("lexical"), "_first": F.lit(0)})
    near = semantic(chunks, vector, 3 * n, file_type, chars).join(by_word.select("chunk_id"), "chunk_id", "left_anti")
    near = near.withColumns({"source": F.lit("semantic"), "_first": F.lit(1)})
    order = [F.col("_first"), F.col("rank")]
    both = by_word.unionByName(near, allowMissingColumns=True).orderBy(*order).limit(n)
    return both.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("_first")
