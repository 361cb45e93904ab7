import json
import random

import pytest
from pyspark.sql import functions as F

from notewarp.functions import text as X
from notewarp.sources import readers as R


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items()))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("sizes, want", [([1000, 998, 1], [2000, 1]), ([2500, 10], [2500, 10]), ([10, 2500], [10, 2500]), ([2500], [2500]), ([], [])])
def test_packing(spark, sizes, want):
    assert [len(x) for x in value(spark, X.pack(F.col("p")), p=["x" * n for n in sizes])] == want


def chunks(spark, body, most=2000):
    return [(c["text"], c["heading"]) for c in value(spark, X.section_chunks(F.col("b"), most), b=body)]


def test_sections(spark):
    body = "pre\n\n# One \ntext\n#### not\n```\n## Code\n```\n### 三\n"
    assert chunks(spark, body) == [("pre", None), ("# One \ntext\n#### not\n```", "One"), ("## Code\n```", "Code"), ("### 三", "三")]
    assert chunks(spark, "  \n") == [] and chunks(spark, "") == []
    assert chunks(spark, "# \n# foo") == [("# \n# foo", "# foo")]
    assert chunks(spark, "a\u0001b\u0002c\n# h\u0001") == [("a\u0001b\u0002c", None), ("# h\u0001", "h\u0001")]


def test_oversize_sections(spark):
    assert chunks(spark, "# H\n" + "\n\n".join(["a" * 8, "b" * 8, "c" * 8]), 20) == [("# H\naaaaaaaa\n\nbbbbbbbb", "H"), ("cccccccc", "H")]
    assert chunks(spark, "# " + "H" * 30, 20) == [("# " + "H" * 30, "H" * 30)]
    assert chunks(spark, "a" * 15 + "\n\n" + "b" * 15, 20) == [("a" * 15, None), ("b" * 15, None)]


def test_random_notes_lose_nothing(spark):
    rng = random.Random(7)
    for _ in range(10):
        body = "\n".join(rng.choice(["# head", "## h2 x", "para " * rng.randint(1, 30), "", ""]) for _ in range(40))
        got = chunks(spark, body, 120)
        assert "".join("".join(t for t, _ in got).split()) == "".join(body.split())


def test_front_matter():
    text = "---\ntags: [a, 自]\nd: {x: 1}\ndate: 2024-01-02\nn: null\n---\n\nbody\n"
    front, tags, body, error = R.front_matter(text)
    assert front == '---\ntags: [a, 自]\nd: {"x": 1}\ndate: 2024-01-02\nn: None\n---'
    assert (json.loads(tags), body, error) == (["a", "自"], "body", None)
    assert R.front_matter("---\ntags: one\n---\n")[1] == "one"
    assert R.front_matter("---\n: [\n---\nx")[3] is not None
    assert R.front_matter("no front")[2] == "no front"


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "file_path string, content binary")


def test_notes_and_canvases(spark):
    got = R.read_notes(files(spark, ("a.md", b"---\ntags: [x]\n---\n# T\nhi"), ("b.md", b"---\n: [\n---\n"), ("c.md", b""), ("d.md", b"\xff"), ("e.md", b"x\r\n\r\ny"))).collect()
    by = {(r["file_path"], r["chunk_index"]): r for r in got}
    assert by["a.md", 0]["text"] == "---\ntags: [x]\n---" and by["a.md", 1]["heading"] == "T" and by["a.md", 1]["frontmatter_tags"] == '["x"]'
    assert by["b.md", None]["error"] and by["d.md", None]["error"] and by["e.md", 0]["text"] == "x\n\ny"
    assert not any(r["file_path"] == "c.md" for r in got)
    nodes = [{"id": "1", "type": "text", "text": " hi "}, {"id": "2", "type": "file"}, {"id": "3", "type": "link", "url": "u"}, {"id": "4", "type": "group", "label": None}, {"id": "5", "type": "odd"}, {"id": "6", "type": "text", "text": None}]
    canvas = {"nodes": nodes, "edges": [{"id": "e", "label": "l"}, {"id": "f"}]}
    got = R.read_canvases(files(spark, ("a.canvas", json.dumps(canvas).encode()), ("b.canvas", b"{oops"), ("c.canvas", b"{}"))).orderBy("file_path", "chunk_index").collect()
    assert [(r["text"], r["node_type"], r["node_id"]) for r in got if r["file_path"] == "a.canvas"] == [
        ("hi", "text", "1"), ("File link: ", "file", "2"), ("URL: u", "link", "3"), ("Connection: l", "edge", "e"),
    ]
    assert [r["error"] for r in got if r["file_path"] == "b.canvas"] == ["not a JSON canvas"]


def test_pages(spark):
    def extract(raw):
        if raw == b"bad":
            raise ValueError("broken")
        return raw.decode().split("|")

    got = R.read_pdfs(files(spark, ("a.pdf", b"one| \n|three"), ("b.pdf", b"bad")), extract).orderBy("file_path", "chunk_index").collect()
    assert [(r["text"], r["chunk_index"], r["page_number"], r["total_pages"]) for r in got[:2]] == [("one", 0, 1, 3), ("three", 1, 3, 3)]
    assert got[2]["error"] == "broken"


def test_audio(spark):
    ms = spark.createDataFrame([(0,), (79_999,), (80_000,), (80_001,), (240_000,)], "ms long")
    got = [[tuple(x) for x in r["s"]] for r in ms.select(R.segments(F.col("ms")).alias("s")).collect()]
    assert got == [[(0, 0)], [(0, 79_999)], [(0, 80_000)], [(0, 80_000), (80_000, 80_001)], [(0, 80_000), (80_000, 160_000), (160_000, 240_000)]]

    def cut(raw, a, b):
        if a == 80_000:
            raise ValueError
        return raw[:1]

    rows = R.read_audio(files(spark, ("a.wav", b"200000"), ("b.mp3", b"80000")), lambda raw: int(raw), cut).orderBy("file_path", "chunk_index").collect()
    assert [(r["file_path"], r["chunk_index"], r["segment_start_s"], r["segment_end_s"], r["mime_type"]) for r in rows] == [
        ("a.wav", 0, 0.0, 80.0, "audio/mp3"), ("a.wav", 2, 160.0, 200.0, "audio/mp3"), ("b.mp3", 0, 0.0, 80.0, "audio/mp3"),
    ]


def test_media(spark):
    video = spark.createDataFrame([("a.mp4", bytearray(b"x"), 20 * 2**20), ("b.mov", bytearray(b"x"), 20 * 2**20 + 1)], "file_path string, content binary, length long")
    assert [(r["file_path"], r["mime_type"]) for r in R.read_videos(video).collect()] == [("a.mp4", "video/mp4")]
    plan = spark.createDataFrame([(".webp", 1, 1), (".png", 1, 4096), (".png", 1, 4097), (".jpg", 10 * 2**20 + 1, 1)], "e string, l long, w int")
    assert [r["p"] for r in plan.select(R.image_plan(F.col("e"), F.col("l"), F.col("w"), F.lit(1)).alias("p")).collect()] == ["jpeg", "keep", "shrink", "shrink"]

    def prepare(raw):
        if raw == b"bad":
            raise OSError("cannot read")
        return raw + b"!"

    rows = {r["file_path"]: r for r in R.read_images(files(spark, ("a.png", b"x"), ("b.heic", b"bad")), prepare).collect()}
    assert bytes(rows["a.png"]["content"]) == b"x!" and rows["b.heic"]["error"] == "cannot read"


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.MD",), (".h/x.md",), ("_d/y.md",), ("s/.x.md",), ("noext",), ("ü/ñ.Canvas",)], "p string")
    got = [(r["e"], r["h"], r["t"]) for r in rows.select(X.extension(F.col("p")).alias("e"), X.hidden(F.col("p")).alias("h"), X.file_type(X.extension(F.col("p"))).alias("t")).collect()]
    assert got == [(".md", False, "text"), (".md", True, "text"), (".md", False, "text"), (".md", True, "text"), ("", False, None), (".canvas", False, "text")]
