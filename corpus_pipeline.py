"""A training-data pipeline of five corpus operators; each stage reads what its predecessor wrote.

Null, empty and word-free texts are kept by the first three stages and dropped by the mix, which takes no word of them. Rows
that share a doc_id share their fate in every stage; rows without doc_id are kept by the stage of near copies and judged
together by the others. Texts of any length are read whole. Ties are settled by doc_id. Extra columns are carried on, whatever
their names, to the last stage. An empty table gives no row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm import decontam, jaccard, mixing, tokens, toxicity
from prefixloom.llm.shared import documents, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go."""
    return toxicity.keep_clean(spark, docs, documents(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles, at a similarity of 0.8, the least doc_id stays."""
    return jaccard.keep_one(spark, docs, percent=80, k=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_contaminated(spark, docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it, the last time for a part too; a document of which it takes no word goes."""
    taken = mixing.mix(spark, docs).filter("taken > 0").select(F.col("doc_id").alias("id__"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times__"))
    # rows that share an id stand as often as the one that is taken most
    taken = taken.groupBy("id__").agg(F.max("times__").alias("times__"))
    mixed = docs.join(taken, docs["doc_id"].eqNullSafe(taken["id__"]))
    return mixed.withColumn("n__", F.explode(F.sequence(F.lit(1), F.col("times__")))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; their digests."""
    return tokens.op1(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Trees, fingerprints and a tokenizer have no SQL form; tests hold each stage's operator and the stage of near copies against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
