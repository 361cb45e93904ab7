"""Queries about the index, the files and what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(chunks: DataFrame) -> DataFrame:
    """Chunks by file type; without one: unknown."""
    return chunks.groupBy(F.coalesce("file_type", F.lit("unknown")).alias("file_type")).agg(F.count(F.lit(1)).alias("n_chunks"))


def indexed_files(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("file_path") != "").select("file_path").distinct().orderBy("file_path")


def tracker_stats(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("tracked_files"), F.max("indexed_at").alias("last_indexed_at"))


def page(files: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of files in the order of their path's parts."""
    return files.orderBy(F.split("rel_path", "/")).offset(max(0, offset)).limit(min(max(1, limit), 1000))


def stale(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are unknown to the state or newer than it."""
    known = state.select(F.col("file_path").alias("_path"), F.col("mtime").alias("_mtime"))
    both = files.join(known, F.col("path") == F.col("_path"), "left")
    return both.where(F.col("_path").isNull() | (F.col("mtime") > F.col("_mtime"))).drop("_path", "_mtime")


def orphans(state: DataFrame, files: DataFrame) -> DataFrame:
    """Tracked files that are no longer there."""
    return state.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def mark(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state with the rows of ``done`` (file_path, mtime, indexed_at) in place of older ones."""
    last = F.max_by(F.struct("mtime", "indexed_at"), F.struct("indexed_at", "mtime")).alias("_s")
    return state.unionByName(done).groupBy("file_path").agg(last).select("file_path", "_s.mtime", "_s.indexed_at")


def upsert(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """``chunks`` with those of the files in ``new`` replaced: no chunk of an old version of a file stays."""
    return chunks.join(new.select("file_path").distinct(), "file_path", "left_anti").unionByName(new)


def without(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def last_changes(events: DataFrame) -> DataFrame:
    """The last event of each path, by time, then by event_id."""
    last = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("_e")
    return events.groupBy("path").agg(last, F.count(F.lit(1)).alias("n_events")).select("path", "_e.event_type", "_e.ts", "n_events")


def joined_pages(pages: DataFrame) -> DataFrame:
    """The pages (file_path, page_number, text) of each file as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    text = F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n---\n\n")
    return pages.groupBy("file_path").agg(text.alias("text"))
