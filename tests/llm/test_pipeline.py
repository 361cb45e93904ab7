import os

import duckdb
import pytest

import corpus_pipeline
from notewarp.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con, path = duckdb.connect(), "/root/testdata/sf0.001"
    for t in os.listdir(path):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path}/{t}'")
    cursor = con.execute(queries.SQL[name])
    cols = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr(list(r)) for r in cursor.fetchall())


def test_stages_and_run(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert 0.5 * before < docs.count() <= before
    want = sorted(map(tuple, docs.collect()))
    assert want == sorted(map(tuple, corpus_pipeline.run(spark, path).collect()))


def test_names():
    names = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert names == list(range(1, 11))


def test_components_of_a_chain(spark):
    from notewarp.llm import graph
    from notewarp.llm.common import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (100, 100), (7, 8)], "u long, v long")
    got = {r["node"]: r["label"] for r in graph.components(Scratch(spark, "g"), edges, "c").collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
    assert graph.components(Scratch(spark, "g"), edges.where("false"), "c").collect() == []
