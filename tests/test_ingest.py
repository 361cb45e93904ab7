import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle

from notewarp import api
from notewarp.operators import catalog, embed, ingest
from notewarp.operators.store import Store
from notewarp.settings import Settings
from notewarp.sources.vault import scan
from notewarp.streaming import watch


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    for name, text in {"a.md": "# A\nautophagy", "a/b.MD": "bee text", ".hid/x.md": "no", "_d/y.md": "draft", "sub/.x.md": "no", "n.txt": "no", "c.canvas": json.dumps({"nodes": [{"type": "text", "text": "card"}]}), "v.mp4": "vvv", "p.pdf": "one|two"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


cloudpickle.register_pickle_by_value(sys.modules[__name__])
DECODERS = ingest.Decoders(pdf=lambda raw: raw.decode().split("|"))


def run(spark, vault, store, **options):
    return ingest.ingest(spark, str(vault), store, embed.HashEmbedder(16), decoders=DECODERS, **options)


def test_scan(spark, vault):
    names = [r["rel_path"] for r in catalog.page(scan(spark, str(vault))).collect()]
    assert names == ["_d/y.md", "a/b.MD", "a.md", "c.canvas", "p.pdf", "v.mp4"]
    assert scan(spark, str(vault), mode="md-only").count() == 3
    assert scan(spark, str(vault), directory="a").count() == 1


def test_ingest_again_changes_nothing_and_edits_do(spark, vault, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert run(spark, vault, store) == {"files": 6, "chunks": 7, "errors": 0}
    assert run(spark, vault, store)["files"] == 0
    assert store.index().count() == 7 and store.state().count() == 6
    later = time.time() + 10
    (vault / "a.md").write_text("")
    (vault / "a/b.MD").write_text("# x\n1\n# y\n2")
    for f in ("a.md", "a/b.MD"):
        os.utime(vault / f, (later, later))
    assert run(spark, vault, store)["files"] == 2
    by = {r["file_path"]: r["count"] for r in store.index().groupBy("file_path").count().collect()}
    assert str(vault / "a.md") not in by and by[str(vault / "a/b.MD")] == 2
    os.remove(vault / "v.mp4")
    run(spark, vault, store)
    assert store.index().where("file_type = 'video'").count() == 1
    run(spark, vault, store, purge=True)
    assert store.index().where("file_type = 'video'").count() == 0
    assert catalog.indexed_files(store.index()).count() == 4


class Fails(embed.HashEmbedder):
    def embed(self, texts):
        raise RuntimeError("down")


def test_failures_keep_what_was_there(spark, vault, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run(spark, vault, store)
    later = time.time() + 10
    os.utime(vault / "a.md", (later, later))
    counts = ingest.ingest(spark, str(vault), store, Fails(16), decoders=DECODERS)
    assert counts["errors"] == 1 and store.index().count() == 7
    assert catalog.stale(scan(spark, str(vault)), store.state()).count() == 1
    live = store.version()
    with pytest.raises(RuntimeError):
        ingest.ingest(spark, str(vault), store, Fails(16), decoders=DECODERS, rebuild=True)
    assert store.version() == live
    assert run(spark, vault, store, rebuild=True)["files"] == 6


def test_missing_decoder_is_an_error_of_the_file(spark, vault, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert ingest.ingest(spark, str(vault), store, embed.HashEmbedder(16))["errors"] == 1


def test_tools(spark, vault, tmp_path):
    v = api.Vault(spark, str(vault), str(tmp_path / "store"), embed.HashEmbedder(16), DECODERS)
    assert json.loads(v.index_status())["total_chunks"] == 0
    run(spark, vault, v.store)
    status = json.loads(v.index_status())
    assert status["by_file_type"] == {"text": 4, "pdf": 2, "video": 1} and status["tracked_files"] == 6
    hits = json.loads(v.lexical_search("Autophagy", n_results=0))
    assert len(hits) == 1 and hits[0]["match_terms"] == 1 and hits[0]["chunk_id"].endswith("a.md::chunk_0")
    assert json.loads(v.lexical_search("the of")) == []
    assert "error" in json.loads(v.semantic_search("x", file_type="word"))
    assert json.loads(v.semantic_search("bee text"))[0]["file_path"].endswith("b.MD")
    assert json.loads(v.hybrid_search("autophagy"))[0]["source"] == "lexical"
    page = json.loads(v.list_files(limit=2, offset=4))
    assert page["total"] == 6 and not page["has_more"] and page["next_offset"] is None and len(page["files"]) == 2
    assert json.loads(v.list_files(limit=4))["next_offset"] == 4
    assert json.loads(v.list_files(directory="a", file_type="text"))["files"] == ["a/b.MD"]
    assert "error" in json.loads(v.list_files(directory="../")) and "error" in json.loads(v.list_files(directory="nowhere"))
    assert v.get_file("a.md") == "# A\nautophagy" and v.get_file("p.pdf") == "one\n\n---\n\ntwo"
    assert json.loads(v.get_file("v.mp4"))["file_type"] == ".mp4"
    assert "error" in json.loads(v.get_file("/etc/passwd")) and "error" in json.loads(v.reindex("gone.md"))
    assert json.loads(v.reindex("a.md"))["chunks_indexed"] == 1


def test_serve_paces_and_logs(spark, vault, tmp_path):
    settings = Settings(rpm=600, batch=2, diagnostics=str(tmp_path / "log"))
    opened = embed.Opened(lambda: embed.HashEmbedder(16))
    v = api.Vault(spark, str(vault), str(tmp_path / "store"), opened, DECODERS, settings)
    told, began = [], time.time()
    counts = ingest.ingest(spark, str(vault), v.store, opened, decoders=DECODERS, settings=settings, report=told.append)
    assert counts == {"files": 6, "chunks": 7, "errors": 0} and time.time() - began > 0.1 and "6 files" in told[0] and "a minute" in told[-1]
    log = [json.loads(r["value"]) for r in spark.read.text(settings.diagnostics).collect()]
    assert sum(x["kind"] == "config" for x in log) == 1 and sum(x.get("batch_size", 0) for x in log) == 7 and all(x["success"] for x in log if x["kind"] != "config")
    out = []
    api.serve(v, [json.dumps({"tool": "lexical_search", "arguments": {"query": "autophagy"}}), '{"tool": "drop"}', "oops", '{"tool": "index_status"}'], out.append)
    got = [json.loads(x) for x in out]
    assert json.loads(got[0]["result"])[0]["match_terms"] == 1 and "error" in got[1] and "error" in got[2] and json.loads(got[3]["result"])["total_chunks"] == 7
    assert api.loaded(None) is None and api.loaded("json:dumps") is json.dumps


def test_each_file_is_read_once(spark, vault, tmp_path, capsys):
    chunks = ingest.chunk_files(spark, scan(spark, str(vault)), ingest.Decoders(pdf=DECODERS.pdf, image=bytes, audio_ms=len, audio_cut=lambda raw, a, b: raw))
    chunks.explain()
    assert capsys.readouterr().out.count("path#") and chunks._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas read(") == 6  # one for each kind


def test_commits_touch_few_parts_and_vectors_have_one_width(spark, vault, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run(spark, vault, store)
    before = store.parts(store.version())
    run(spark, vault, store, paths=[str(vault / "a.md")])
    after = store.parts(store.version())
    assert sum(n == store.version() for n in after["index"].values()) == 1 < len(after["index"]) and after["index"].keys() == before["index"].keys()
    with pytest.raises(ValueError):
        ingest.ingest(spark, str(vault), store, embed.HashEmbedder(8), decoders=DECODERS, paths=[str(vault / "a.md")])
    assert store.parts(store.version()) == after and store.index().count() == 7


def test_watch(spark, vault, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def step():
        query = watch(spark, str(vault), store, embed.HashEmbedder(16), str(tmp_path / "check"), DECODERS, once=True)
        assert query.awaitTermination(120)
        return {os.path.basename(r["file_path"]) for r in store.index().select("file_path").distinct().collect()}

    assert step() == {"a.md", "b.MD", "y.md", "c.canvas", "p.pdf", "v.mp4"}
    os.rename(vault / "a.md", vault / "moved.md")
    (vault / "c.canvas").write_text(json.dumps({"nodes": []}))
    os.utime(vault / "c.canvas", (time.time() + 5,) * 2)
    assert step() == {"moved.md", "b.MD", "y.md", "p.pdf", "v.mp4"}


def test_events_and_marks(spark):
    events = spark.createDataFrame([("a", "created", 1, 1), ("a", "deleted", 2, 2), ("b", "modified", 5, 3), ("a", "created", 2, 1)], "path string, event_type string, ts long, event_id long")
    assert {r["path"]: r["event_type"] for r in catalog.last_changes(events).collect()} == {"a": "deleted", "b": "modified"}
    rows = spark.createDataFrame([("x.md", "text"), ("", "text"), (None, "pdf"), ("x.md", None)], "file_path string, file_type string")
    assert [r["file_path"] for r in catalog.indexed_files(rows).collect()] == ["x.md"]
    assert {r["file_type"]: r["n_chunks"] for r in catalog.status(rows).collect()} == {"text": 2, "pdf": 1, "unknown": 1}
    empty = spark.createDataFrame([], "file_path string, mtime double, indexed_at double")
    assert tuple(catalog.tracker_stats(empty).first()) == (0, None)
