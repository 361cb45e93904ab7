"""Semantic, lexical and hybrid search; query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as Q
from ..functions import text as X
from ..operators import search
from ..operators.embed import prefixed
from . import tables as t

COSINE = "list_cosine_similarity(v.embedding, q.embedding)"


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.semantic(t.vectors(spark, sf_dir), t.vector(spark, sf_dir, 7)).select("rank", "chunk_id", "file_type", "score")


def semantic_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.semantic(t.vectors(spark, sf_dir), t.vector(spark, sf_dir, 7), 5, "3").select("rank", "chunk_id", "file_type", "score")


def semantic_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.vectors(spark, sf_dir)
    queries = v.where(F.col("vec_id") < 4).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.semantic_batch(v, queries, 10)


def _lexical(spark: SparkSession, sf_dir: str, query: str, **options) -> DataFrame:
    found = search.lexical(t.chunks(spark, sf_dir), Q.extract_terms(query), **options)
    return found.select("rank", "chunk_id", "file_type", "score", "match_terms", "snippet")


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, "License, token then reer erthly", n=20)


def lexical_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, "license reer", n=15, file_type="en", chars=50)


def lexical_repeat_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, "token token", n=10)


def lexical_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, "LiCense", n=25, match="ci")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("_t"))
    chunks = t.vectors(spark, sf_dir).join(text, "vec_id").withColumn("text", F.col("_t")).drop("_t")
    return search.hybrid(chunks, t.vector(spark, sf_dir, 7), ["License"], 12).select("rank", "chunk_id", "score", "source", "match_terms")


def term_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t.table(spark, sf_dir, "benchmark").select("item_id", Q.terms(F.col("text")).alias("terms"))
    return items.select("item_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "part").select("p_partkey", F.array_join(Q.ascii_variants(F.col("p_type")), "|").alias("variants"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chunks(spark, sf_dir).select("chunk_id", X.snippet(F.col("text"), 120).alias("snippet"))


def prefix_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [prefixed(F.col("text"), task).alias(task) for task in ("document", "query")]
    return t.table(spark, sf_dir, "benchmark").select("item_id", *both)


QUERIES = {
    f.__name__: f
    for f in (
        semantic_topk, semantic_topk_filtered, semantic_batch_topk, lexical_topk, lexical_filtered, lexical_repeat_term, lexical_ci,
        hybrid_search, term_extract, case_variants, snippets, prefix_format,
    )
}


def _semantic_sql(n: int, where: str = "true") -> str:
    return f"""
WITH {t.VECTORS_SQL}, q AS (SELECT embedding FROM vectors WHERE vec_id = 7),
s AS (SELECT v.chunk_id, v.file_type, {COSINE} AS near FROM vectors v, q WHERE {where})
SELECT row_number() OVER (ORDER BY near DESC, chunk_id) AS rank, chunk_id, file_type, round(near, 4) AS score FROM s ORDER BY near DESC, chunk_id LIMIT {n}"""


def _lexical_sql(terms: list[str], n: int, where: str = "true", chars: int = 300, ci: bool = False) -> str:
    def hit(term: str) -> str:
        if ci:
            return f"contains(lower(text), '{term.lower()}')"
        return "(" + " OR ".join(f"contains(text, '{v}')" for v in Q.case_variants(term)) + ")"

    rows = ", ".join(f"({i}, {1.0 / (1 + i)!r})" for i in range(len(terms)))
    cases = " ".join(f"WHEN {i} THEN {hit(x)}" for i, x in enumerate(terms))
    return f"""
WITH {t.CHUNKS_SQL}, terms(i, w) AS (VALUES {rows}),
hits AS (SELECT chunk_id, i, w FROM chunks, terms WHERE {where} AND CASE i {cases} END),
s AS (SELECT chunk_id, count(*) AS match_terms, sum(w ORDER BY i) AS weight FROM hits GROUP BY chunk_id)
SELECT row_number() OVER (ORDER BY match_terms DESC, weight DESC, chunk_id) AS rank, chunk_id, file_type,
  round(least(0.99, CAST(0.8 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (match_terms - 1)), 4) AS score, match_terms, left(text, {chars}) AS snippet
FROM s JOIN chunks USING (chunk_id) ORDER BY match_terms DESC, weight DESC, chunk_id LIMIT {n}"""


_STOP = ", ".join(f"'{w}'" for w in sorted(Q.STOP_WORDS))
SQL = {
    "semantic_topk": _semantic_sql(10),
    "semantic_topk_filtered": _semantic_sql(5, "v.file_type = '3'"),
    "semantic_batch_topk": f"""
WITH {t.VECTORS_SQL}, s AS (SELECT q.vec_id AS query_id, v.chunk_id, {COSINE} AS near FROM vectors v, vectors q WHERE q.vec_id < 4)
SELECT query_id, rank, chunk_id, round(near, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "lexical_topk": _lexical_sql(["License", "token", "reer", "erthly"], 20),
    "lexical_filtered": _lexical_sql(["license", "reer"], 15, "file_type = 'en'", 50),
    "lexical_repeat_term": _lexical_sql(["token", "token"], 10),
    "lexical_ci": _lexical_sql(["license"], 25, ci=True),
    "hybrid_search": f"""
WITH {t.VECTORS_SQL}, c AS (SELECT v.*, d.text FROM vectors v JOIN documents d ON d.doc_id = v.vec_id), q AS (SELECT embedding FROM vectors WHERE vec_id = 7),
lex AS (SELECT chunk_id, CAST(0.8 AS DOUBLE) AS near, 1 AS match_terms FROM c
  WHERE contains(text, 'License') OR contains(text, 'license') OR contains(text, 'LICENSE') ORDER BY chunk_id LIMIT 12),
sem AS (SELECT v.chunk_id, {COSINE} AS near FROM c v, q ORDER BY near DESC, chunk_id LIMIT 36),
both_ AS (SELECT 0 AS part, chunk_id, near, 'lexical' AS source, CAST(match_terms AS BIGINT) AS match_terms FROM lex
  UNION ALL SELECT 1, chunk_id, near, 'semantic', NULL FROM sem WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.chunk_id = sem.chunk_id)),
o AS (SELECT row_number() OVER (ORDER BY part, CASE WHEN part = 0 THEN 0 ELSE -near END, chunk_id) AS rank, * FROM both_)
SELECT rank, chunk_id, round(near, 4) AS score, source, match_terms FROM o WHERE rank <= 12""",
    "term_extract": f"""
WITH w AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: rtrim(w, '.,;:!?')),
  lambda w: w <> '' AND (regexp_matches(w, '[一-鿿぀-ヿ]') OR (length(w) >= 2 AND NOT list_contains([{_STOP}], lower(w))))) AS terms FROM benchmark)
SELECT item_id, len(terms) AS n_terms, array_to_string(terms, ' ') AS terms FROM w""",
    "case_variants": """
WITH w AS (SELECT p_partkey, p_type, array_to_string(list_transform(regexp_extract_all(lower(p_type), '[a-z]+|[^a-z]+'),
  lambda x: upper(x[1:1]) || x[2:]), '') AS title FROM part)
SELECT p_partkey, p_type || CASE WHEN lower(p_type) <> p_type THEN '|' || lower(p_type) ELSE '' END
  || CASE WHEN upper(p_type) NOT IN (p_type, lower(p_type)) THEN '|' || upper(p_type) ELSE '' END
  || CASE WHEN title NOT IN (p_type, lower(p_type), upper(p_type)) THEN '|' || title ELSE '' END AS variants FROM w""",
    "snippets": f"WITH {t.CHUNKS_SQL} SELECT chunk_id, left(coalesce(text, ''), 120) AS snippet FROM chunks",
    "prefix_format": "SELECT item_id, 'title: none | text: ' || text AS document, 'task: search result | query: ' || text AS query FROM benchmark",
}
