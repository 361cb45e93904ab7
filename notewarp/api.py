"""The tools as functions that return JSON, and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import extract_terms
from .operators import catalog, search
from .operators.embed import PREFIX, Embedder, HashEmbedder, Opened, client_of, write_log
from .operators.ingest import Decoders, ingest
from .operators.store import Store
from .settings import FILE_TYPES, MODES, Settings
from .sources.vault import scan


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


class Vault:
    """An indexed directory. Each tool returns JSON text; what goes wrong is ``{"error": ...}``."""

    def __init__(self, spark: SparkSession, root: str, store: str, embedder: Embedder | Opened | None = None, decoders: Decoders | None = None, settings: Settings | None = None):
        if not root:
            raise ValueError("the directory is not set")
        self.spark, self.root = spark, os.path.realpath(os.path.expanduser(root))
        self.store, self.decoders, self.settings = Store(spark, store), decoders, settings
        self.embedder = embedder or HashEmbedder()

    def vector(self, query: str) -> list[float]:
        return client_of(self.embedder).embed([PREFIX["query"] + query])[0]

    def inside(self, path: str) -> str:
        """The real path, as given or below the directory; it must lie in the directory."""
        real = os.path.realpath(path if os.path.isabs(path) else os.path.join(self.root, path))
        if real != self.root and not real.startswith(self.root + os.sep):
            raise ValueError(f"not in the directory: {path}")
        return real

    def _search(self, how, file_type: str | None, n_results: int, snippet_length: int) -> str:
        if file_type is not None and file_type not in FILE_TYPES:
            return as_json({"error": f"Invalid file_type '{file_type}'. Must be one of: {sorted(FILE_TYPES)}"})
        try:
            hits: DataFrame = how(min(max(1, n_results), 50), min(max(50, snippet_length), 2000))
            rows = [r.asDict() for r in hits.orderBy("rank").collect()]
        except Exception as e:  # the edge of the engine: an error becomes a result
            return as_json({"error": str(e)})
        return as_json([{k: v for k, v in r.items() if k != "rank" and v is not None} for r in rows])

    def semantic_search(self, query: str, n_results: int = 10, file_type: str | None = None, snippet_length: int = 300) -> str:
        return self._search(lambda n, c: search.semantic(self.store.index(), self.vector(query), n, file_type, c), file_type, n_results, snippet_length)

    def lexical_search(self, query: str, n_results: int = 10, file_type: str | None = None, snippet_length: int = 300) -> str:
        return self._search(lambda n, c: search.lexical(self.store.index(), extract_terms(query), n, file_type, c), file_type, n_results, snippet_length)

    def hybrid_search(self, query: str, n_results: int = 10, file_type: str | None = None, snippet_length: int = 300) -> str:
        def how(n: int, c: int) -> DataFrame:
            return search.hybrid(self.store.index(), self.vector(query), extract_terms(query), n, file_type, c)

        return self._search(how, file_type, n_results, snippet_length)

    def index_status(self) -> str:
        types = {r["file_type"]: r["n_chunks"] for r in catalog.status(self.store.index()).collect()}
        stats = catalog.tracker_stats(self.store.state()).first().asDict()
        return as_json({"total_chunks": sum(types.values()), "by_file_type": types} | stats)

    def reindex(self, file_path: str) -> str:
        try:
            path = self.inside(file_path)
            if not os.path.isfile(path):
                raise FileNotFoundError(f"File not found: {file_path}")
            counts = ingest(self.spark, self.root, self.store, self.embedder, paths=[path], decoders=self.decoders, settings=self.settings)
        except (OSError, ValueError) as e:
            return as_json({"error": str(e)})
        return as_json({"file_path": path, "chunks_indexed": counts["chunks"], "errors": counts["errors"]})

    def get_file(self, file_path: str) -> str:
        try:
            path = Path(self.inside(file_path))
            ext = path.suffix.lower()
            if ext in FILE_TYPES["text"]:
                return path.read_text(encoding="utf-8")
            if ext in FILE_TYPES["pdf"] and self.decoders and self.decoders.pdf:
                pages = self.decoders.pdf(path.read_bytes())
                rows = self.spark.createDataFrame([(str(path), i, p) for i, p in enumerate(pages)], "file_path string, page_number int, text string")
                found = catalog.joined_pages(rows).first()
                return found["text"] if found else ""
            at = path.stat()
            return as_json({"file_path": str(path), "file_type": ext, "size_bytes": at.st_size, "modified": at.st_mtime})
        except (OSError, ValueError) as e:
            return as_json({"error": str(e)})

    def list_files(self, directory: str | None = None, file_type: str | None = None, limit: int = 200, offset: int = 0) -> str:
        if file_type is not None and file_type not in FILE_TYPES:
            return as_json({"error": f"Invalid file_type '{file_type}'. Must be one of: {sorted(FILE_TYPES)}"})
        try:
            base = self.inside(directory or "")
            if not os.path.isdir(base):
                raise FileNotFoundError(f"Directory not found: {base}")
        except (OSError, ValueError) as e:
            return as_json({"error": str(e)})
        files = scan(self.spark, self.root, file_type=file_type, directory=os.path.relpath(base, self.root) if base != self.root else None)
        limit, offset, total = min(max(1, limit), 1000), max(0, offset), files.count()
        more = offset + limit < total
        page = [r["rel_path"] for r in catalog.page(files, limit, offset).collect()]
        return as_json({"files": page, "total": total, "offset": offset, "limit": limit, "has_more": more, "next_offset": offset + limit if more else None})


#: The tools that ``serve`` offers.
TOOLS = ("semantic_search", "lexical_search", "hybrid_search", "index_status", "reindex", "get_file", "list_files")


def serve(vault: Vault, lines: Iterable[str], out: Callable[[str], None]) -> None:
    """Answers one JSON line {"tool", "arguments"} after the other with a JSON line {"tool", "result"}; a bad line gets an error."""
    if vault.settings and vault.settings.diagnostics:
        write_log(vault.spark, vault.settings.diagnostics, vault.settings)
    for line in lines:
        try:
            asked = json.loads(line)
            name = asked["tool"]
            if name not in TOOLS:
                raise ValueError(f"Unknown tool '{name}'. Must be one of: {list(TOOLS)}")
            answer = {"tool": name, "result": getattr(vault, name)(**asked.get("arguments", {}))}
        except (ValueError, KeyError, TypeError) as e:
            answer = {"error": f"{type(e).__name__}: {e}"}
        out(json.dumps(answer, ensure_ascii=False))


def loaded(place: str | None):
    """The object named by ``module:name``."""
    if not place:
        return None
    module, _, name = place.partition(":")
    return getattr(import_module(module), name)


def main(argv: list[str] | None = None) -> int:
    """notewarp ingest | status | search | serve --vault DIR --store DIR; settings come from NOTEWARP_ variables and .env"""
    parser = argparse.ArgumentParser(prog="notewarp", description=main.__doc__)
    parser.add_argument("command", choices=["ingest", "status", "search", "serve"])
    settings = Settings.read(dict(os.environ), ".env")
    parser.add_argument("--vault", default=settings.vault)
    parser.add_argument("--store", default=settings.store)
    parser.add_argument("--file")
    parser.add_argument("--decoders", help="module:name of a Decoders object for PDF, audio and images")
    parser.add_argument("--embedder", help="module:name of an embedder, or of an Opened one")
    parser.add_argument("--query", default="")
    parser.add_argument("--force-rebuild", action="store_true")
    parser.add_argument("--purge", action="store_true")
    modes = parser.add_mutually_exclusive_group()
    for mode in MODES:
        modes.add_argument(f"--{mode}", dest="mode", action="store_const", const=mode)
    args = parser.parse_args(argv)
    if not args.vault or not args.store:
        parser.error("--vault and --store must be set")
    vault = Vault(SparkSession.builder.appName("notewarp").getOrCreate(), args.vault, args.store, loaded(args.embedder), loaded(args.decoders), settings)
    if args.command == "serve":
        serve(vault, sys.stdin, lambda x: print(x, flush=True))
    elif args.command == "search":
        print(vault.hybrid_search(args.query))
    elif args.command == "status":
        print(vault.index_status())
    elif args.file:
        print(vault.reindex(args.file))
    else:
        print(as_json(ingest(vault.spark, vault.root, vault.store, vault.embedder, args.mode or "full", purge=args.purge, decoders=vault.decoders, rebuild=args.force_rebuild, settings=settings, report=print)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
