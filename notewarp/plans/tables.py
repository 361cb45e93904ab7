"""The engine's tables out of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: documents as chunks, one each: the language is the type.
CHUNKS_SQL = (
    "chunks AS (SELECT source || '/' || doc_id || '.md' AS file_path, source || '/' || doc_id || '.md::chunk_0' AS chunk_id, "
    "lang AS file_type, text, n_chars FROM documents)"
)
#: embeddings as vectors of chunks.
VECTORS_SQL = "vectors AS (SELECT vec_id, 'v/' || vec_id AS chunk_id, 'v/' || vec_id || '.md' AS file_path, CAST(label AS VARCHAR) AS file_type, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
#: conversations as notes with a heading for each turn.
NOTES_SQL = (
    "notes AS (SELECT conv_id, 'chat/' || conv_id || '.md' AS file_path, "
    "string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, taken as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = table(spark, sf_dir, "documents").withColumn("file_path", path)
    return docs.select("file_path", X.chunk_id(F.col("file_path"), F.lit(0)).alias("chunk_id"), F.col("lang").alias("file_type"), "text", "n_chars")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.concat(F.lit("v/"), F.col("vec_id").cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", id_.alias("chunk_id"), F.concat(id_, F.lit(".md")).alias("file_path"), F.col("label").cast("string").alias("file_type"), F.lit("").alias("text"), "embedding"
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]), "\n\n")
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined.alias("body"))
    return out.withColumn("file_path", F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".md")))


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector as the query; the oracle finds it by the same id."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"])
