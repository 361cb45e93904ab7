"""The catalogue of files and chunks, and what changes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources.vault import listed
from . import tables as t


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: paths of several kinds, some hidden, some of no supported type."""
    ends = F.array(*[F.lit(x) for x in (".md", ".MD", ".pdf", ".txt", ".png", "/.x.md", ".canvas")])
    path = F.concat(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.element_at(ends, (F.col("page_id") % 7 + 1).cast("int")))
    path = F.concat(F.when(F.col("page_id") % 11 == 0, F.lit(".trash/")).when(F.col("page_id") % 5 == 0, F.lit("_draft/")).otherwise(F.lit("")), path)
    return t.table(spark, sf_dir, "pages").select(path.alias("rel_path"), path.alias("path"), "page_id").dropDuplicates(["rel_path"])


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.chunks(spark, sf_dir)
    return C.status(rows.withColumn("file_type", F.when(F.col("n_chars") > 100, F.col("file_type"))))


def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents")
    return C.indexed_files(rows.select(F.when(F.col("n_chars") > 100, F.col("source")).otherwise("").alias("file_path")))


def tracker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    return C.tracker_stats(docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("doc_id").cast("double").alias("indexed_at")))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents are known, some with an older or newer time than now."""
    docs = t.table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 != 0)
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("file_path"), (F.col("n_chars") + F.col("doc_id") % 5 - 2).cast("double").alias("mtime"), F.col("doc_id").cast("double").alias("indexed_at"))


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 != 0)
    return docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("double").alias("mtime"))


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stale(_now(spark, sf_dir), _state(spark, sf_dir)).select("path", "mtime")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.orphans(_state(spark, sf_dir), _now(spark, sf_dir)).select("file_path")


def mark_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _now(spark, sf_dir).select(F.col("path").alias("file_path"), "mtime", F.lit(1e9).alias("indexed_at"))
    return C.mark(_state(spark, sf_dir), new)


def _old_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t.table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("c/"), F.col("conv_id").cast("string"))
    return turns.select("conv_id", path.alias("file_path"), F.concat(path, F.lit("::chunk_"), F.col("turn").cast("string")).alias("chunk_id"), "text")


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second conversation is indexed again, with its first two turns, reversed."""
    old = _old_chunks(spark, sf_dir)
    new = old.where((F.col("conv_id") % 2 == 0) & F.col("chunk_id").rlike("::chunk_[01]$")).withColumn("text", F.reverse("text"))
    return C.upsert(old, new).select("chunk_id", F.md5("text").alias("text_md5"))


def delete_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _old_chunks(spark, sf_dir)
    return C.without(old, old.where(F.col("conv_id") % 4 == 1).select("file_path")).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_chunks"))


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_files(spark, sf_dir)).select("rel_path", "file_type")


def list_files_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(listed(_files(spark, sf_dir), "text-only"), 25, 10).select("rel_path")


def change_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").otherwise("modified")
    events = events.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("event_type"), t.micros(F.col("ts")).alias("ts"), "event_id")
    return C.last_changes(events)


QUERIES = {
    f.__name__: f
    for f in (
        index_status, indexed_files, tracker_stats, incremental_diff, orphans, mark_indexed, upsert_chunks, delete_file_chunks, list_files, list_files_page, change_compaction,
    )
}

_STATE = "state AS (SELECT 'd/' || doc_id AS file_path, CAST(n_chars + doc_id % 5 - 2 AS DOUBLE) AS mtime, CAST(doc_id AS DOUBLE) AS indexed_at FROM documents WHERE doc_id % 3 <> 0)"
_NOW = "now_ AS (SELECT 'd/' || doc_id AS path, CAST(n_chars AS DOUBLE) AS mtime FROM documents WHERE doc_id % 7 <> 0)"
_OLD = "old_ AS (SELECT conv_id, 'c/' || conv_id AS file_path, turn, 'c/' || conv_id || '::chunk_' || turn AS chunk_id, text FROM conversations)"
_LIST = """
f AS (SELECT DISTINCT CASE WHEN page_id % 11 = 0 THEN '.trash/' WHEN page_id % 5 = 0 THEN '_draft/' ELSE '' END || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)
  || ['.md', '.MD', '.pdf', '.txt', '.png', '/.x.md', '.canvas'][page_id % 7 + 1] AS rel_path FROM pages),
g AS (SELECT rel_path, lower(regexp_extract(string_split(rel_path, '/')[-1], '.(\\.[^.]+)$', 1)) AS ext FROM f),
h AS (SELECT rel_path, CASE WHEN ext IN ('.md', '.canvas') THEN 'text' WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.png' THEN 'image' END AS file_type FROM g
  WHERE NOT starts_with(rel_path, '.') AND NOT contains(rel_path, '/.'))"""
SQL = {
    "index_status": "SELECT CASE WHEN n_chars > 100 THEN lang ELSE 'unknown' END AS file_type, count(*) AS n_chunks FROM documents GROUP BY 1",
    "indexed_files": "SELECT DISTINCT source AS file_path FROM documents WHERE n_chars > 100 ORDER BY 1",
    "tracker_stats": "SELECT count(*) AS tracked_files, max(CAST(doc_id AS DOUBLE)) AS last_indexed_at FROM documents",
    "incremental_diff": f"WITH {_STATE}, {_NOW} SELECT path, mtime FROM now_ n WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.file_path = n.path AND s.mtime >= n.mtime)",
    "orphans": f"WITH {_STATE}, {_NOW} SELECT file_path FROM state EXCEPT SELECT path FROM now_",
    "mark_indexed": f"WITH {_STATE}, {_NOW} SELECT path AS file_path, mtime, CAST(1e9 AS DOUBLE) AS indexed_at FROM now_ UNION ALL SELECT * FROM state WHERE file_path NOT IN (SELECT path FROM now_)",
    "upsert_chunks": f"""WITH {_OLD} SELECT chunk_id, md5(CASE WHEN conv_id % 2 = 0 THEN reverse(text) ELSE text END) AS text_md5 FROM old_
WHERE conv_id % 2 = 1 OR turn <= 1 OR conv_id NOT IN (SELECT conv_id FROM old_ WHERE turn <= 1)""",
    "delete_file_chunks": f"WITH {_OLD} SELECT file_path, count(*) AS n_chunks FROM old_ WHERE conv_id % 4 <> 1 GROUP BY file_path",
    "list_files": f"WITH {_LIST} SELECT rel_path, file_type FROM h WHERE file_type IS NOT NULL",
    "list_files_page": f"WITH {_LIST} SELECT rel_path FROM (SELECT rel_path FROM h WHERE file_type IN ('text', 'pdf') ORDER BY string_split(rel_path, '/') LIMIT 25 OFFSET 10)",
    "change_compaction": """
SELECT 'u/' || user_id AS path, arg_max(CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created' ELSE 'modified' END, struct_pack(a := epoch_us(ts), b := event_id)) AS event_type,
  max(epoch_us(ts)) AS ts, count(*) AS n_events FROM events GROUP BY user_id""",
}
