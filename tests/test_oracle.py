"""Every query of the engine against its SQL on DuckDB."""

import os

import duckdb
import pytest

from notewarp import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def norm(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf_dir, name):
    assert name in plans.SQL
    got = plans.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(plans.SQL[name])
    want = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(want)
    rows = cursor.fetchall()
    assert rows
    assert norm([tuple(r[c] for c in want) for r in got.collect()]) == norm(rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_use_a_top_k(spark, sf_dir, capsys):
    plans.QUERIES["lexical_topk"](spark, sf_dir).explain("formatted")
    text = capsys.readouterr().out
    assert "StringContains(text,License)" in text
    assert "TakeOrderedAndProject" in text
    plans.QUERIES["semantic_topk"](spark, sf_dir).explain("formatted")
    text = capsys.readouterr().out
    assert "TakeOrderedAndProject" in text and "SortMergeJoin" not in text


def most_read(spark, job):
    """The rows and bytes of shuffles that the busiest task of ``job`` reads."""
    sc = spark.sparkContext._jsc.sc()
    tracker, group = spark.sparkContext.statusTracker(), f"most-read-{os.urandom(4).hex()}"
    spark.sparkContext.setJobGroup(group, group)
    job()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sc.listenerBus().waitUntilEmpty()
    rows = size = 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = sc.statusStore().taskList(stage, 0, 10_000)
        for read in (tasks.apply(i).taskMetrics().get().shuffleReadMetrics() for i in range(tasks.size())):
            rows, size = max(rows, read.recordsRead()), max(size, read.localBytesRead() + read.remoteBytesRead())
    return rows, size


def test_batches_of_one_type_are_dealt_over_tasks(spark, tmp_path):
    """Rows without type, key or text among them; keys without value come last, as in the SQL."""
    n = 6000
    docs = duckdb.sql(f"""SELECT i AS doc_id, repeat(md5(i::VARCHAR), 1 + i % 7) AS text, CASE WHEN i % 50 = 0 THEN NULL WHEN i % 40 = 0 THEN 'de' ELSE 'en' END AS lang,
        CASE WHEN i % 30 <> 0 THEN 's' || i % 3 END AS source FROM range({n}) t(i)""")
    docs = duckdb.sql("SELECT *, length(text) AS n_chars FROM (SELECT * REPLACE (CASE WHEN source IS NULL THEN 'x' WHEN doc_id % 11 <> 0 THEN text END AS text) FROM docs)")
    docs.write_parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(f"SELECT file_type, batch, n, est_tokens FROM ({plans.SQL['embed_batches']})").fetchall()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = plans.QUERIES["embed_batches"](spark, str(tmp_path)).select("file_type", "batch", "n", "est_tokens")
        out = []
        rows, size = most_read(spark, lambda: out.extend(got.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n"] for r in out) == n
    assert norm([tuple(r) for r in out]) == norm(want)
    assert rows < n / 2 and size < 100_000
