"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import alignment, contamination, crosspolytope, language, licenses, lm, mixing, nearest, ngram_join, pii, quality, urls, whitening

# Where the public tokenizers lie on the driver, which hands their files to the tasks.
TOKENIZERS = os.environ.get("TRACEMILL_TOKENIZERS", "/opt/tokenizers")
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_identified(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scored(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.trained(docs, _table(spark, sf_dir, "labels")))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & nearest.usable(F.col("embedding")))
    v = e.select("vec_id", nearest.floored(F.col("embedding"), 64).alias("v"))
    return nearest.nearest(v, v.where(F.col("vec_id") % 20 == 0), k=20)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).drop("source")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a_file, b_file = (Path(TOKENIZERS, name).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(_table(spark, sf_dir, "documents"), a_file, b_file)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.linked(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), scale=256, top=4)


QUERIES = {q.__name__: q for q in (
    op1_url_filters, op2_decontamination, op3_ngram_jaccard_join, op4_license_scans, op5_language_id, op6_lm_scoring, op7_quality_classifier,
    op8_exact_top_k, op9_pii, op10_mixing, op11_cross_tokenizer_alignment, op12_embedding_near_dedup, op13_whitening,
)}

ORACLE = {
    "op8_exact_top_k": """
        WITH ok AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM ok),
        s AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op12_embedding_near_dedup": """
        WITH RECURSIVE r AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        ok AS (
            SELECT row, v FROM r
            WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT a.row AS a, b.row AS b FROM ok a JOIN ok b ON a.row <> b.row AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach AS (SELECT row, row AS other FROM r UNION SELECT reach.row, links.b FROM reach JOIN links ON reach.other = links.a),
        least AS (SELECT reach.row, min(o.vec_id) AS component_id FROM reach JOIN r o ON reach.other = o.row GROUP BY 1),
        n AS (SELECT a AS row, count(*) AS n FROM links GROUP BY 1)
        SELECT r.vec_id, coalesce(n.n, 0) AS n_links, component_id, r.vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM r JOIN least USING (row) LEFT JOIN n USING (row)
    """,
}
