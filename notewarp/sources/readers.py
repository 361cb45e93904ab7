"""Readers of file contents: notes, canvases, PDF pages, images, audio and video, each into chunks.

All take rows (file_path, content) and return CHUNKS rows with ``error`` set where a file could not be read. Decoders of
media that this environment lacks are passed in as functions of bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..settings import AUDIO_MS, IMAGE_BYTES, IMAGE_SIDE, VIDEO_BYTES

FENCE = re.compile(r"^-{3,}\s*$", re.M)
CANVAS = (
    "struct<nodes:array<struct<id:string,type:string,text:string,file:string,url:string,label:string>>,"
    "edges:array<struct<id:string,label:string>>>"
)
CHUNKS = (
    "file_path string, chunk_index bigint, file_type string, text string, content binary, mime_type string, heading string, "
    "frontmatter_tags string, node_type string, node_id string, page_number bigint, total_pages bigint, segment_start_s double, "
    "segment_end_s double, error string"
)


def as_chunks(df: DataFrame) -> DataFrame:
    """With all columns of CHUNKS, null where a reader has none."""
    fields = [x.strip().split(" ") for x in CHUNKS.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def numbered(df: DataFrame, chunks: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each element of an array of chunks, counted from 0."""
    return df.select("file_path", *keep, F.posexplode(chunks).alias("chunk_index", "_c")).select("file_path", *keep, F.col("chunk_index").cast("long"), "_c.*")


def with_errors(df: DataFrame, chunks: Column, file_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of each row without ``error``, and one row for each with: a single pass over what was read."""
    rows = df.select("file_path", *keep, "error", F.posexplode_outer(F.when(F.col("error").isNull(), chunks)).alias("chunk_index", "_c"))
    rows = rows.where("chunk_index is not null or error is not null")
    type_ = F.when(F.col("error").isNull(), F.lit(file_type)).alias("file_type")
    return as_chunks(rows.select("file_path", *keep, "error", F.col("chunk_index").cast("long"), type_, "_c.*"))


def front_matter(text: str) -> tuple[str | None, str | None, str, str | None]:
    """(fenced text, tags, body, error) of a note. Without a YAML mapping at the start all is body."""
    import yaml

    first = text.lstrip("﻿").split("\n", 1)[0]
    cut = FENCE.split(text, maxsplit=2) if FENCE.match(first) else []
    if len(cut) < 3:
        return None, None, text, None
    try:
        data = yaml.safe_load(cut[1])
    except yaml.YAMLError as e:
        return None, None, "", str(e)[:300]
    if not isinstance(data, dict) or not data:
        return None, None, cut[2].strip(), None

    def shown(v) -> str:
        if isinstance(v, list):
            return f"[{', '.join(map(str, v))}]"
        return json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, dict) else str(v)

    tags = data.get("tags")
    tags = json.dumps(tags, ensure_ascii=False, default=str) if isinstance(tags, (list, dict)) else None if tags is None else str(tags)
    return "\n".join(["---", *[f"{k}: {shown(v)}" for k, v in data.items()], "---"]), tags, cut[2].strip(), None


def read_notes(files: DataFrame) -> DataFrame:
    """Markdown: the front matter as first chunk, then the body's sections."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["file_path"], b["content"]):
                try:
                    rows.append((path, *front_matter(bytes(raw).decode("utf-8").replace("\r\n", "\n"))))
                except UnicodeDecodeError as e:
                    rows.append((path, None, None, "", str(e)[:300]))
            yield pd.DataFrame(rows, columns=["file_path", "front", "tags", "body", "error"])

    notes = files.select("file_path", "content").mapInPandas(parse, "file_path string, front string, tags string, body string, error string")
    front = F.when(F.col("front").isNotNull(), F.array(F.struct(F.col("front").alias("text"), F.lit(None).cast("string").alias("heading"))))
    chunks = F.concat(F.coalesce(front, F.array().cast("array<struct<text:string,heading:string>>")), X.section_chunks(F.col("body")))
    return with_errors(notes.withColumnRenamed("tags", "frontmatter_tags"), chunks, "text", ("frontmatter_tags",))


def canvas_chunks(data: Column) -> Column:
    """Chunks (text, node_type, node_id) of a parsed canvas: its nodes, then the labels of its edges; null counts as empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))

    def node(n: Column) -> Column:
        label = X.strip(blank(n["label"]))
        text = (
            F.when(n["type"] == "text", X.strip(blank(n["text"])))
            .when(n["type"] == "file", F.concat(F.lit("File link: "), blank(n["file"])))
            .when(n["type"] == "link", F.concat(F.lit("URL: "), blank(n["url"])))
            .when((n["type"] == "group") & (label != ""), F.concat(F.lit("Group: "), label))
            .otherwise("")
        )
        return F.struct(text.alias("text"), blank(n["type"]).alias("node_type"), blank(n["id"]).alias("node_id"))

    def edge(e: Column) -> Column:
        label = X.strip(blank(e["label"]))
        text = F.when(label != "", F.concat(F.lit("Connection: "), label)).otherwise("")
        return F.struct(text.alias("text"), F.lit("edge").alias("node_type"), blank(e["id"]).alias("node_id"))

    empty = F.array().cast("array<struct<text:string,node_type:string,node_id:string>>")
    both = F.concat(F.coalesce(F.transform(data["nodes"], node), empty), F.coalesce(F.transform(data["edges"], edge), empty))
    return F.filter(both, lambda c: c["text"] != "")


def read_canvases(files: DataFrame) -> DataFrame:
    text = F.decode("content", "UTF-8")
    bad = F.when(F.get_json_object(text, "$").isNull(), F.lit("not a JSON canvas")).alias("error")
    files = files.select("file_path", F.from_json(text, CANVAS, {"mode": "PERMISSIVE"}).alias("data"), bad)
    return with_errors(files, canvas_chunks(F.col("data")), "text")


def page_chunks(pages: Column) -> Column:
    """Chunks of the pages of a file that have text; blank ones count in page numbers, not in chunks."""
    made = F.transform(pages, lambda p, i: F.struct(X.strip(p).alias("text"), (i + 1).cast("long").alias("page_number"), F.size(pages).cast("long").alias("total_pages")))
    return F.filter(made, lambda c: c["text"] != "")


def decoded(files: DataFrame, decode: Callable[[bytes], list], out: str) -> DataFrame:
    """(file_path, found, error): what ``decode`` makes of each content; any error discards the whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["file_path"], b["content"]):
                try:
                    rows.append((path, decode(bytes(raw)), None))
                except Exception as e:  # what decoders raise is theirs to choose; it becomes the file's error
                    rows.append((path, None, str(e)[:300] or type(e).__name__))
            yield pd.DataFrame(rows, columns=["file_path", "found", "error"])

    return files.select("file_path", "content").mapInPandas(run, f"file_path string, found {out}, error string")


def read_pdfs(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    return with_errors(decoded(files, extract, "array<string>"), page_chunks(F.col("found")), "pdf")


def segments(ms: Column) -> Column:
    """The bounds (start, end) in milliseconds of an audio's pieces of at most 80 seconds; the whole up to that length."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), ms.cast("long").alias("end")))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(ms.cast("long") - 1, F.lit(0)), F.lit(AUDIO_MS).cast("long"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + AUDIO_MS, ms.cast("long")).alias("end")))
    return F.when(ms <= AUDIO_MS, whole).otherwise(cut)


def media_rows(files: DataFrame, file_type: str) -> DataFrame:
    mime = X.mime_type(X.extension(F.col("file_path")))
    return files.withColumns({"chunk_index": F.lit(0).cast("long"), "file_type": F.lit(file_type), "text": F.lit(""), "mime_type": mime})


def read_videos(files: DataFrame) -> DataFrame:
    """Whole videos up to 20 MiB; larger ones have no chunk."""
    size = F.col("length") if "length" in files.columns else F.length("content")
    return as_chunks(media_rows(files.where(size <= VIDEO_BYTES), "video"))


def read_audio(files: DataFrame, duration: Callable[[bytes], int], cut: Callable[[bytes, int, int], bytes]) -> DataFrame:
    """Short audio as it is; longer in pieces of 80 seconds. A piece that cannot be cut is left out and keeps its number."""

    def run(raw: bytes) -> list[dict]:
        ms = duration(raw)
        if ms <= AUDIO_MS:
            return [{"i": 0, "start": 0.0, "end": round(ms / 1000, 1), "bytes": raw, "mime": None}]
        out = []
        for i, at in enumerate(range(0, ms, AUDIO_MS)):
            end = min(at + AUDIO_MS, ms)
            try:
                out.append({"i": i, "start": round(at / 1000, 1), "end": round(end / 1000, 1), "bytes": cut(raw, at, end), "mime": "audio/mp3"})
            except Exception:  # see above
                continue
        return out

    found = decoded(files, run, "array<struct<i:bigint,start:double,end:double,bytes:binary,mime:string>>")
    whole = X.mime_type(X.extension(F.col("file_path")))
    pieces = F.transform("found", lambda s: F.struct(s["i"].alias("i"), F.lit("").alias("text"), s["bytes"].alias("content"), F.coalesce(s["mime"], whole).alias("mime_type"), s["start"].alias("segment_start_s"), s["end"].alias("segment_end_s")))
    rows = found.select("file_path", "error", F.explode_outer(F.when(F.col("error").isNull(), pieces)).alias("s")).where("s is not null or error is not null")
    kind = F.when(F.col("error").isNull(), F.lit("audio")).alias("file_type")
    return as_chunks(rows.select("file_path", "error", kind, "s.*").withColumnRenamed("i", "chunk_index"))


def image_plan(ext: Column, length: Column, width: Column, height: Column) -> Column:
    """What to do with an image: ``jpeg`` for formats to convert, ``shrink`` for large ones, else ``keep``."""
    big = (length > IMAGE_BYTES) | (width > IMAGE_SIDE) | (height > IMAGE_SIDE)
    return F.when(ext.isin(".heic", ".webp"), "jpeg").when(big, "shrink").otherwise("keep")


def read_images(files: DataFrame, prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """One chunk an image; ``prepare`` converts or shrinks its bytes."""
    if prepare is None:
        return as_chunks(media_rows(files, "image"))
    done = decoded(files, lambda raw: [prepare(raw)], "array<binary>")
    mime = X.mime_type(X.extension(F.col("file_path")))
    return with_errors(done, F.transform("found", lambda x: F.struct(F.lit("").alias("text"), x.alias("content"), mime.alias("mime_type"))), "image")
