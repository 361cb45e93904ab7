"""Embedding of chunks: an interface, a local stand-in, batches with pacing, retries and adaptation."""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.limits import HEADER_TAGS
from ..settings import Settings

# What goes before a text by its task.
PREFIX = {"document": "title: none | text: ", "query": "task: search result | query: "}


def prefixed(text: Column, task: str) -> Column:
    return F.concat(F.lit(PREFIX.get(task, "")), text)


class Embedder(Protocol):
    """Makes one vector for each text; ``embed_media`` one for bytes of a MIME type."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_media(self, content: bytes, mime_type: str) -> list[float]: ...


class HashEmbedder:
    """Deterministic vectors without a model: hashed words with signs, of unit length; zero for a text without words."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def one(self, words: list[bytes]) -> list[float]:
        v = np.zeros(self.dim)
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            v[(h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        norm = np.linalg.norm(v)
        return (v / norm if norm else v).astype(np.float32).tolist()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t.lower().encode().split()) for t in texts]

    def embed_media(self, content: bytes, mime_type: str) -> list[float]:
        return self.one([mime_type.encode(), hashlib.sha256(content).digest()])


def retryable(message: str) -> bool:
    return "429" in message or "RESOURCE_EXHAUSTED" in message


def retry_after(headers: dict[str, str], now: float | None = None) -> float | None:
    """Seconds by the first header named retry-after that can be read, as a number or an HTTP date."""
    for name, value in headers.items():
        if "retry-after" in name.lower():
            try:
                return float(value)
            except (TypeError, ValueError):
                pass
            try:
                at = parsedate_to_datetime(value).timestamp()
                return max(0.0, at - (time.time() if now is None else now))
            except (TypeError, ValueError):
                continue
    return None


def limit_headers(headers: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in headers.items() if any(t in k.lower() for t in HEADER_TAGS)}


@dataclass
class Limiter:
    """Pace and batch size of one worker. ``share`` divides the pace among as many workers as run at once."""

    settings: Settings = field(default_factory=Settings)
    share: int = 1
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    batch: int = 0
    failures: int = 0
    successes: int = 0
    last: float = 0.0

    def __post_init__(self):
        self.batch = self.batch or self.settings.batch

    def wait(self, n: int = 1) -> None:
        pause = self.last + n * 60.0 * self.share / max(self.settings.rpm, 0.001) - self.clock()
        if pause > 0:
            self.sleep(pause)
        self.last = self.clock()

    def limited(self) -> None:
        s = self.settings
        self.failures, self.successes, self.batch = self.failures + 1, 0, max(s.min_batch, int(self.batch * s.factor))

    def succeeded(self) -> None:
        self.successes += 1
        if self.settings.recovery > 0 and self.successes >= self.settings.recovery:
            self.batch, self.failures, self.successes = self.settings.batch, 0, 0

    def delay(self, attempt: int, least: float = 0.0) -> float:
        s = self.settings
        return max(min(s.base_delay * 2**attempt, s.max_delay), least) * random.uniform(0.8, 1.2)

    def call(self, fn: Callable[[], list], kind: str, size: int, tokens: int, log: Callable[[dict], None] | None = None) -> list:
        """``fn()``, tried again after calls that were limited; a record of each try goes to ``log``."""
        began = self.clock()
        for attempt in range(self.settings.retries + 1):
            error: Exception | None = None
            try:
                out = fn()
            except Exception as e:  # the model's client decides what it raises
                error = e
            if error is None:
                self.succeeded()
            hit = error is not None and retryable(str(error))
            if hit:
                self.limited()
            headers = limit_headers(dict(getattr(getattr(error, "response", None), "headers", None) or {}))
            again = hit and attempt < self.settings.retries
            wait = retry_after(headers) if hit else None
            if log:
                entry = {
                    "ts": datetime.now(timezone.utc).isoformat(), "kind": kind, "batch_size": size, "adaptive_batch_size": self.batch,
                    "consecutive_429s": self.failures, "est_tokens": tokens, "duration_ms": round((self.clock() - began) * 1000),
                    "retry_count": attempt + again, "http_status": 200 if error is None else 429 if hit else int(getattr(error, "code", 0) or 0), "success": error is None,
                }
                entry |= {"phase": "retry", "retry_after_s": wait} if again else {}
                entry |= {"error_msg": str(error)[:300]} if error else {}
                log(entry | ({"429_headers": headers} if headers else {}))
            if error is None:
                return out
            if not again:
                raise error
            self.sleep(self.delay(attempt, wait or 0.0))
        raise AssertionError


#: What a worker keeps of the clients it has opened.
CLIENTS: dict[str, Embedder] = {}


@dataclass(frozen=True)
class Opened:
    """A client that each Python worker opens once, by ``make``; tasks carry the function, not the client."""

    make: Callable[[], Embedder]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def client(self) -> Embedder:
        if self.name not in CLIENTS:
            CLIENTS[self.name] = self.make()
        return CLIENTS[self.name]


def client_of(embedder: Embedder | Opened) -> Embedder:
    return embedder.client() if isinstance(embedder, Opened) else embedder


def embed_chunks(chunks: DataFrame, embedder: Embedder | Opened, settings: Settings | None = None, share: int | None = None) -> DataFrame:
    """``chunks`` with ``embedding`` and, where that failed, ``error``; ``calls`` has the records of calls as JSON lines where ``settings`` ask for diagnostics.

    A chunk with content is embedded by itself, texts in batches of the size that the worker's limiter has when the
    batch begins. A failed batch marks its own rows only. ``share`` tasks are taken to run at once (by default all cores).
    """
    settings, share, opened = settings or Settings(rpm=1e9), share or chunks.sparkSession.sparkContext.defaultParallelism, embedder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter, embedder = Limiter(settings, share), client_of(opened)
        for b in batches:
            out: list[list[float] | None] = [None] * len(b)
            calls: list[list[str]] = [[] for _ in range(len(b))]
            errors = b["error"].tolist()
            todo = [i for i, e in enumerate(errors) if e is None]
            media = {i for i in todo if "content" in b and b["content"].iloc[i] is not None}
            texts, groups = [i for i in todo if i not in media], [[i] for i in media]
            while texts:
                groups.append(texts[: limiter.batch])
                texts = texts[limiter.batch :]
            for group in groups:
                rows = [b.iloc[i] for i in group]
                one = group[0] in media
                size = sum(len(r["content"] if one else r["text"]) for r in rows)

                def fn(rows=rows, one=one):
                    if one:
                        return [embedder.embed_media(bytes(rows[0]["content"]), rows[0]["mime_type"] or "")]
                    return embedder.embed([PREFIX["document"] + r["text"] for r in rows])

                log = (lambda entry, own=calls[group[0]]: own.append(json.dumps(entry, ensure_ascii=False, default=str))) if settings.diagnostics else None
                try:
                    limiter.wait(len(group))
                    made = limiter.call(fn, "media" if one else "text", len(group), size // 4, log)
                    if any(len(v) != embedder.dim for v in made) or len(made) != len(group):
                        raise ValueError(f"vectors must be {len(group)} of {embedder.dim} numbers")
                    for i, v in zip(group, made):
                        out[i] = v
                except Exception as e:  # see Limiter.call; the rows keep the error
                    for i in group:
                        errors[i] = str(e)[:300] or type(e).__name__
            yield b.assign(embedding=out, error=errors, calls=calls)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{fields}, embedding array<float>, calls array<string>")


def snapshot(settings: Settings) -> str:
    """The settings as one JSON line, to begin a log with."""
    return json.dumps({"ts": datetime.now(timezone.utc).isoformat(), "kind": "config"} | asdict(settings), ensure_ascii=False)


def write_log(spark: SparkSession, path: str, settings: Settings, embedded: DataFrame | None = None) -> None:
    """Appends a snapshot of the settings, or the records of calls, as JSON lines to the folder ``path`` of any file system."""
    lines = spark.createDataFrame([(snapshot(settings),)], "value string") if embedded is None else embedded.select(F.explode("calls").alias("value"))
    lines.write.mode("append").text(path)
