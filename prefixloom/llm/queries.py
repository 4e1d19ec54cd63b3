"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard, langid, mixing, quality, repeats, tokens, topk, toxicity, urls
from .shared import documents as table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": lambda s, d: tokens.op1(s, table(s, d)),
        "op2_top_k": lambda s, d: topk.op2(s, table(s, d, "embeddings")),
        "op3_url_filter": lambda s, d: urls.op3(s, table(s, d, "pages")),
        "op4_toxicity": lambda s, d: toxicity.op4(s, table(s, d), table(s, d, "labels")),
        "op5_decontamination": lambda s, d: decontam.op5(s, table(s, d), table(s, d, "benchmark")),
        "op6_mixing": lambda s, d: mixing.op6(s, table(s, d)),
        "op7_repeats": lambda s, d: repeats.op7(s, table(s, d)),
        "op8_quality": lambda s, d: quality.op8(s, table(s, d), table(s, d, "labels")),
        "op9_language": lambda s, d: langid.op9(s, table(s, d)),
        "op10_ngram_jaccard": lambda s, d: jaccard.op10(s, table(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": TOP_K}


#: Exact top-k by brute force.
TOP_K = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
