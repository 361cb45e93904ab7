"""A training-data pipeline out of the operators in notewarp.llm.

Each stage reads what the stage before it wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewarp.llm import decontaminate, mixing, ngram_join, quality, tokenstore
from notewarp.llm.common import Scratch, passing


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps and that are not toxic. Null and empty texts stay; repeated rows share their fate."""
    found = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.where("kept and not toxic").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the smallest doc_id. Texts without words, null ones too, all stay."""
    return ngram_join.deduplicate(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts stay; repeated rows share their fate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source of its own; equal rows share their copies."""
    return mixing.mixed(docs).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the content-addressed store, read back: doc_id, start, n_tokens, ids_crc32. A null text is an end id alone."""
    import public_tokenizers

    return tokenstore.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: Models and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each result written and read again.

    What a stage wrote for itself is deleted with its result written, and that result once the next one is. Empty
    tables go through all stages and give an empty result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with passing():
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.free(f"stage{i - 1}")
