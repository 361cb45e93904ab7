import pytest
from pyspark.sql import functions as F

from notewarp.functions import terms as Q
from notewarp.operators import search


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("A", "a.md", "text", "has autophagy only", [1.0, 0.0]),
        ("B", "b.md", "text", "mitophagy and PINK1 here", [0.0, 1.0]),
        ("C", "c.pdf", "pdf", "autophagy with PINK1", [-1.0, 0.0]),
        ("D", "d.md", "text", "just PINK1 自噬", [0.0, 0.0]),
        ("E", "e.md", None, "mt-Keima probe", [1.0, 0.0]),
    ]
    return spark.createDataFrame(rows, "chunk_id string, file_path string, file_type string, text string, embedding array<float>")


def ids(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_more_terms_rank_first_but_the_score_is_by_count(chunks):
    hits = search.lexical(chunks, ["autophagy", "mitophagy", "PINK1"]).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == ["C", "B", "A", "D"]
    assert [h["score"] for h in hits] == [0.85, 0.85, 0.8, 0.8]
    assert [h["match_terms"] for h in hits] == [2, 2, 1, 1]


def test_score_is_capped(spark):
    rows = spark.createDataFrame([("X", "x", "text", "a1 b1 c1 d1 e1 f1", [0.0])], "chunk_id string, file_path string, file_type string, text string, embedding array<float>")
    terms = ["a1", "b1", "c1", "d1", "e1", "f1"]
    assert [search.lexical(rows, terms[:n]).first()["score"] for n in range(1, 7)] == [0.8, 0.85, 0.9, 0.95, 0.99, 0.99]


def test_variants_are_case_sensitive_and_do_not_inflate(chunks):
    assert ids(search.lexical(chunks, ["mt-keima"])) == []
    assert ids(search.lexical(chunks, ["mt-keima"], match="ci")) == ["E"]
    assert search.lexical(chunks, ["mt-Keima"]).first()["match_terms"] == 1
    assert search.lexical(chunks, ["PINK1", "PINK1"]).first()["match_terms"] == 2


def test_filter_limit_snippet_and_no_terms(chunks):
    assert ids(search.lexical(chunks, ["PINK1"], file_type="pdf")) == ["C"]
    assert ids(search.lexical(chunks, ["PINK1"], n=1)) == ["B"]
    assert search.lexical(chunks, ["自噬"], chars=4).first()["snippet"] == "just"
    assert search.lexical(chunks, []).collect() == []
    assert ids(search.lexical(chunks.where("false"), ["PINK1"])) == []


def test_semantic_order_opposite_and_zero_vectors(chunks):
    hits = search.semantic(chunks, [1.0, 0.0]).orderBy("rank").collect()
    assert [(h["chunk_id"], h["score"]) for h in hits] == [("A", 1.0), ("E", 1.0), ("B", 0.0), ("C", -1.0), ("D", None)]
    assert ids(search.semantic(chunks, [1.0, 0.0], file_type="text", n=2)) == ["A", "B"]


def test_order_is_by_the_cosine_not_by_the_rounded_score(spark):
    rows = [("a", [1.0, 0.004]), ("b", [1.0, 0.0]), ("c", [1.0, 0.002])]
    df = spark.createDataFrame([(i, i, "text", "x", v) for i, v in rows], "chunk_id string, file_path string, file_type string, text string, embedding array<double>")
    hits = search.semantic(df, [1.0, 0.0], 2).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == ["b", "c"] and {h["score"] for h in hits} == {1.0}
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, vector array<double>")
    batch = search.semantic_batch(df, queries, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in batch] == [(i, c) for i in range(5) for c in "bc"]
    assert search.semantic_batch(df, queries.where("false")).collect() == []
    assert [h["chunk_id"] for h in search.hybrid(df, [1.0, 0.0], [], 2).orderBy("rank").collect()] == ["b", "c"]


def test_hybrid_lexical_first_without_repeats(spark):
    rows = [("a", 0.75), ("b", 0.70), ("d", 0.60), ("c", 0.1)]
    vec = lambda s: [s, (1 - s * s) ** 0.5]
    df = spark.createDataFrame([(i, i, "text", "word" if i in "bc" else "x", vec(s)) for i, s in rows], "chunk_id string, file_path string, file_type string, text string, embedding array<double>")
    hits = search.hybrid(df, [1.0, 0.0], ["word"], 3).orderBy("rank").collect()
    assert [(h["chunk_id"], h["source"]) for h in hits] == [("b", "lexical"), ("c", "lexical"), ("a", "semantic")]
    assert hits[0]["score"] == 0.8 and hits[2]["match_terms"] is None
    assert [h["source"] for h in search.hybrid(df, [1.0, 0.0], [], 2).collect()] == ["semantic"] * 2
    assert [h["source"] for h in search.hybrid(df, [1.0, 0.0], ["word"], 2).collect()] == ["lexical"] * 2


@pytest.mark.parametrize(
    "query, want",
    [
        ("how does autophagy work", ["autophagy", "work"]),
        ("mt-Keima assay, PINK1.", ["mt-Keima", "assay", "PINK1"]),
        ("自噬 与 PINK1", ["自噬", "与", "PINK1"]),
        ("the of a x ?", []),
        ("", []),
        ("foo foo", ["foo", "foo"]),
        ("(paren) end!?", ["(paren)", "end"]),
    ],
)
def test_terms(spark, query, want):
    assert Q.extract_terms(query) == want
    assert spark.range(1).select(Q.terms(F.lit(query)).alias("t")).first()["t"] == want


def test_stop_words_and_variants(spark):
    assert len(Q.STOP_WORDS) > 100
    assert Q.case_variants("mt-Keima") == ["mt-Keima", "mt-keima", "MT-KEIMA", "Mt-Keima"]
    assert Q.case_variants("自噬") == ["自噬"] and Q.case_variants("a") == ["a", "A"]
    for term in ("mt-Keima", "PINK1", "p62/SQSTM1", "a"):
        assert spark.range(1).select(Q.ascii_variants(F.lit(term)).alias("v")).first()["v"] == Q.case_variants(term)
