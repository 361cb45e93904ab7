"""From files to the index."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import FILE_TYPES, Settings
from ..sources import readers as R
from ..sources.vault import scan
from . import catalog
from .embed import Embedder, Opened, embed_chunks, write_log
from .store import Store, as_index

logger = logging.getLogger(__name__)


@dataclass
class Decoders:
    """Functions of bytes for media; files of a kind without its decoder become errors."""

    pdf: Callable[[bytes], list[str]] | None = None
    audio_ms: Callable[[bytes], int] | None = None
    audio_cut: Callable[[bytes, int, int], bytes] | None = None
    image: Callable[[bytes], bytes] | None = None


def with_content(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file_path, length, ext, content): read on the executors, by path."""

    def read(batches):
        for b in batches:
            content = []
            for path in b["path"]:
                with open(path, "rb") as f:
                    content.append(f.read())
            yield b.assign(content=content)

    rows = files.select("path", "length", "ext").repartition("path")
    return rows.mapInPandas(read, "path string, length bigint, ext string, content binary").withColumnRenamed("path", "file_path")


def chunk_files(spark: SparkSession, files: DataFrame, decoders: Decoders | None = None) -> DataFrame:
    """The chunks of all files (path, ext, length), with ``error`` for what could not be read. Each file is read once, by the reader of its kind."""
    d = decoders or Decoders()

    def of(kind: str, *exts: str) -> DataFrame:
        return with_content(spark, files.where(F.col("ext").isin(*(exts or FILE_TYPES[kind]))))

    def missing(kind: str) -> DataFrame:
        rows = files.where(F.col("ext").isin(*FILE_TYPES[kind]))
        return R.as_chunks(rows.select(F.col("path").alias("file_path"), F.lit(f"no decoder for {kind}").alias("error")))

    parts = [
        R.read_notes(of("text", ".md")),
        R.read_canvases(of("text", ".canvas")),
        R.read_pdfs(of("pdf"), d.pdf) if d.pdf else missing("pdf"),
        R.read_images(of("image"), d.image),
        R.read_audio(of("audio"), d.audio_ms, d.audio_cut) if d.audio_ms and d.audio_cut else missing("audio"),
        R.read_videos(of("video")),
    ]
    return reduce(DataFrame.unionByName, parts)


def ingest(
    spark: SparkSession, root: str, store: Store, embedder: Embedder | Opened, mode: str = "full", paths: list[str] | DataFrame | None = None, purge: bool = False,
    decoders: Decoders | None = None, rebuild: bool = False, now: float | None = None, settings: Settings | None = None, report: Callable[[str], None] = logger.info,
) -> dict[str, int]:
    """Indexes the files below ``root`` that are new or newer than the index, or just ``paths`` (a table has them in ``path``); returns counts.

    A file with an error keeps its old chunks and is tried again next time. One that has become empty loses its chunks.
    ``purge`` drops files that are gone. One commit for the whole run. ``settings`` pace the calls of the embedder and name the
    folder of their log; without, calls are not paced. ``report`` is told how far the run is and at what rate it went.
    """
    began = time.time()
    now = began if now is None else now
    if settings and settings.diagnostics:
        write_log(spark, settings.diagnostics, settings)
    listing = scan(spark, root, mode=mode)
    everything = listing
    if isinstance(paths, DataFrame):
        listing = listing.join(paths.select("path").distinct(), "path", "left_semi")
    elif paths is not None:
        listing = listing.where(F.col("path").isin(*paths))
    elif not rebuild:
        listing = catalog.stale(listing, store.state())
    todo = listing.cache()
    counts = {"files": todo.count()}
    report(f"{counts['files']} files to index")
    chunks = embed_chunks(chunk_files(spark, todo, decoders), embedder, settings).cache()
    failed = chunks.where("error is not null").select("file_path").distinct()
    good = chunks.join(failed, "file_path", "left_anti")
    done = todo.select(F.col("path").alias("file_path"), "mtime", F.lit(now).alias("indexed_at")).join(failed, "file_path", "left_anti")
    gone = catalog.orphans(store.state(), everything).select("file_path") if purge else None
    counts |= {"chunks": good.count(), "errors": failed.count()}
    spent = max(time.time() - began, 1e-9)
    report(f"{counts['chunks']} chunks of {counts['files']} files, {counts['errors']} with errors, in {spent:.1f} s: {60 * counts['files'] / spent:.0f} files a minute")
    if settings and settings.diagnostics:
        write_log(spark, settings.diagnostics, settings, chunks)
    if rebuild:
        store.rebuild(as_index(good), done, counts["errors"], counts["files"])
    else:
        store.apply(as_index(good), done, gone)
    todo.unpersist()
    chunks.unpersist()
    return counts
