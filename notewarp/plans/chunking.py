"""Chunks of notes, canvases, pages and media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text as X
from ..operators import catalog
from ..sources import readers as R
from . import tables as t


def _digest(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "chunk_index", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a paragraph; paragraphs are packed."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", X.pack(X.paragraphs(X.strip(F.replace("text", F.lit("\n"), F.lit("\n\n"))))).alias("c"))
    docs = docs.select("doc_id", F.posexplode("c").alias("i", "text")).withColumn("chunk_index", F.col("i").cast("long"))
    return _digest(docs, "doc_id")


def _section(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    found = R.numbered(t.notes(spark, sf_dir), X.section_chunks(F.col("body"), most))
    return found.withColumn("chunk_id", X.chunk_id(F.col("file_path"), F.col("chunk_index")))


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_section(spark, sf_dir, 2000), "chunk_id", "heading")


def chunk_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections over 200 characters, their lines being paragraphs."""
    notes = t.notes(spark, sf_dir).withColumn("body", F.regexp_replace("body", r"\n+", "\n\n"))
    return _digest(R.numbered(notes, X.section_chunks(F.col("body"), 200)), "file_path", "heading")


def canvas_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvases of conversations: a text node a turn, links, groups and edges from the other columns."""
    turns = t.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 4 == 3, "group").when(F.col("role") == "system", "link").otherwise("text")
    field = lambda k, v: F.when(kind == k, v)
    node = F.struct(
        "turn", F.struct(
            F.concat(F.lit("n"), F.col("turn").cast("string")).alias("id"), kind.alias("type"), field("text", F.col("text")).alias("text"),
            field("link", F.concat(F.lit("http://x/"), F.col("turn").cast("string"))).alias("url"), field("group", F.left("text", F.lit(20))).alias("label"),
        ).alias("n"),
    )
    edge = F.when(F.col("turn") % 2 == 1, F.struct("turn", F.struct(F.concat(F.lit("e"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("label")).alias("n")))
    both = [F.transform(F.array_sort(F.collect_list(x)), lambda s: s["n"]) for x in (node, edge)]
    canvas = turns.groupBy("conv_id").agg(F.to_json(F.struct(both[0].alias("nodes"), both[1].alias("edges"))).alias("json"))
    canvas = canvas.select(F.col("conv_id").cast("string").alias("file_path"), F.from_json("json", R.CANVAS).alias("data"))
    return _digest(R.numbered(canvas, R.canvas_chunks(F.col("data"))), "file_path", "node_type", "node_id")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged files, every third page blank."""
    turn = F.struct("turn", F.when(F.col("turn") % 3 == 1, F.lit(" \n")).otherwise(F.col("text")).alias("t"))
    pages = t.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("file_path"))
    pages = pages.agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]).alias("pages"))
    return _digest(R.numbered(pages, R.page_chunks(F.col("pages"))), "file_path", "page_number", "total_pages")


def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("page_number"), "text")
    return catalog.joined_pages(pages).select("file_path", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("n_chars") * 37
    rows = t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.segments(ms)).alias("i", "s"))
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.round(F.col("s.start") / 1000, 1).alias("start_s"), F.round(F.col("s.end") / 1000, 1).alias("end_s"))


def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of at most 20 MiB with their MIME type, and what would be done to images of these sizes."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".mov", ".webp", ".png", ".heic", ".avi")]), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = t.table(spark, sf_dir, "documents").select("doc_id", ext.alias("ext"), (F.col("n_chars") * 8192).alias("length"), F.col("n_chars").alias("width"))
    rows = rows.where(F.col("length") <= R.VIDEO_BYTES)
    return rows.select("doc_id", "length", X.mime_type(F.col("ext")).alias("mime_type"), R.image_plan(F.col("ext"), F.col("length"), F.col("width"), F.lit(1)).alias("plan"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.chunks(spark, sf_dir).groupBy("file_type").agg(F.sum(F.length("text")).alias("n"))
    return rows.select("file_type", L.token_estimate(F.col("n")).alias("est_tokens"))


def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of 100 that the chunks of each type are embedded in."""
    rows = t.chunks(spark, sf_dir).select("file_type", "chunk_id", F.length("text").alias("n_chars"))
    rows = L.placed(rows, "file_type", "chunk_id", ties=("n_chars",)).withColumn("batch", F.floor(F.col("place") / 100).cast("long"))
    return rows.groupBy("file_type", "batch").agg(F.count(F.lit(1)).alias("n"), L.token_estimate(F.sum("n_chars")).alias("est_tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_paragraphs, chunk_sections, chunk_oversize, canvas_chunks, page_chunks, page_concat, audio_segments, media_filter, token_estimate, embed_batches,
    )
}

#: Greedy packing as a recursion over numbered paragraphs: p(id, i, para), i from 1; gives packed(id, chunk_index, text).
_PACK = """
r(id, i, c, len, txt) AS (
  SELECT id, 1, 0, length(para), para FROM p WHERE i = 1
  UNION ALL
  SELECT p.id, p.i, CASE WHEN r.len + 2 + length(p.para) > {most} THEN r.c + 1 ELSE r.c END,
    CASE WHEN r.len + 2 + length(p.para) > {most} THEN length(p.para) ELSE r.len + 2 + length(p.para) END,
    CASE WHEN r.len + 2 + length(p.para) > {most} THEN p.para ELSE r.txt || chr(10) || chr(10) || p.para END
  FROM r JOIN p ON p.id = r.id AND p.i = r.i + 1),
packed AS (SELECT id, c AS chunk_index, arg_max(txt, i) AS text FROM r GROUP BY id, c)"""
_DIGEST = "length(text) AS n_chars, md5(text) AS text_md5"
SQL = {
    "chunk_paragraphs": f"""
WITH RECURSIVE l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS i, trim(para, ' ' || chr(9) || chr(13)) AS para FROM l WHERE trim(para, ' ' || chr(9) || chr(13)) <> ''),
{_PACK.format(most=2000)}
SELECT id AS doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, {_DIGEST} FROM packed""",
    "chunk_sections": f"""
WITH s AS (SELECT 'chat/' || conv_id || '.md::chunk_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS chunk_id, role AS heading,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, regexp_replace('## ' || role || chr(10) || text, '\\s+$', '') AS text FROM conversations)
SELECT chunk_id, heading, chunk_index, {_DIGEST} FROM s""",
    "chunk_oversize": f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, '## ' || role AS line, trim(regexp_replace(text, '\\n+', chr(10), 'g'), ' ' || chr(10)) AS body FROM conversations),
l AS (SELECT conv_id * 1000 + turn AS id, unnest(string_split(body, chr(10))) AS para, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM t
  WHERE length(line) + 2 + length(replace(body, chr(10), chr(10) || chr(10))) > 200),
p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS i, trim(para) AS para FROM l WHERE trim(para) <> ''),
{_PACK.format(most=200)},
c AS (SELECT conv_id, turn, role, CAST(0 AS BIGINT) AS j, line || chr(10) || chr(10) || replace(body, chr(10), chr(10) || chr(10)) AS text FROM t
    WHERE length(line) + 2 + length(replace(body, chr(10), chr(10) || chr(10))) <= 200
  UNION ALL SELECT t.conv_id, t.turn, t.role, chunk_index, CASE WHEN chunk_index = 0 THEN t.line || chr(10) || packed.text ELSE packed.text END
    FROM packed JOIN t ON t.conv_id * 1000 + t.turn = packed.id)
SELECT 'chat/' || conv_id || '.md' AS file_path, role AS heading, row_number() OVER (PARTITION BY conv_id ORDER BY turn, j) - 1 AS chunk_index, {_DIGEST} FROM c""",
    "canvas_chunks": f"""
WITH k AS (SELECT *, CASE WHEN turn % 4 = 3 THEN 'group' WHEN role = 'system' THEN 'link' ELSE 'text' END AS kind FROM conversations),
u AS (SELECT conv_id, 0 AS part, turn, kind AS node_type, 'n' || turn AS node_id, CASE kind WHEN 'text' THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')
    WHEN 'link' THEN 'URL: http://x/' || turn ELSE 'Group: ' || regexp_replace(regexp_replace(left(text, 20), '^\\s+', ''), '\\s+$', '') END AS text FROM k
  UNION ALL SELECT conv_id, 1, turn, 'edge', 'e' || turn, 'Connection: ' || role FROM k WHERE turn % 2 = 1)
SELECT CAST(conv_id AS VARCHAR) AS file_path, node_type, node_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1 AS chunk_index, {_DIGEST} FROM u WHERE text <> '' AND text <> 'Group: '""",
    "page_chunks": f"""
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_number, count(*) OVER (PARTITION BY conv_id) AS total_pages,
  regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS file_path, page_number, total_pages, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, {_DIGEST} FROM p WHERE turn % 3 <> 1 AND text <> ''""",
    "page_concat": f"""
WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS file_path, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT file_path, {_DIGEST} FROM p""",
    "audio_segments": """
WITH d AS (SELECT doc_id, n_chars * 37 AS ms FROM documents), s AS (SELECT doc_id, ms, unnest(range(0, greatest(ms, 1), 80000)) AS a FROM d)
SELECT doc_id, a // 80000 AS chunk_index, round(a / 1000, 1) AS start_s, round(least(a + 80000, ms) / 1000, 1) AS end_s FROM s""",
    "media_filter": """
WITH d AS (SELECT doc_id, n_chars * 8192 AS length, n_chars AS width, ['.mp4', '.mov', '.webp', '.png', '.heic', '.avi'][doc_id % 6 + 1] AS ext FROM documents)
SELECT doc_id, length, CASE ext WHEN '.mp4' THEN 'video/mp4' WHEN '.mov' THEN 'video/quicktime' WHEN '.webp' THEN 'image/jpeg' WHEN '.heic' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' END AS mime_type,
  CASE WHEN ext IN ('.heic', '.webp') THEN 'jpeg' WHEN length > 10485760 OR width > 4096 THEN 'shrink' ELSE 'keep' END AS plan FROM d WHERE length <= 20971520""",
    "token_estimate": "SELECT lang AS file_type, CAST(sum(length(text)) AS BIGINT) // 4 AS est_tokens FROM documents GROUP BY lang",
    "embed_batches": f"""
WITH {t.CHUNKS_SQL}, b AS (SELECT file_type, (row_number() OVER (PARTITION BY file_type ORDER BY chunk_id) - 1) // 100 AS batch, length(text) AS n FROM chunks)
SELECT file_type, batch, count(*) AS n, CAST(sum(n) AS BIGINT) // 4 AS est_tokens FROM b GROUP BY file_type, batch""",
}
