"""The operators on their whole tables, as named queries, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kubestrata.llm import (
    adscan,
    cover_tree,
    credentials,
    impact,
    lexical,
    mixing,
    near_copies,
    packing,
    personal,
    quality,
    token_files,
    url_lists,
    warc,
)

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents")).drop("_k", "_t")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_table(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan_secrets(table(spark, sf_dir, "documents"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = url_lists.captures_and_entries(table(spark, sf_dir, "pages"), table(spark, sf_dir, "events"))
    return url_lists.evaluate(captures, entries)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan_personal(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adscan.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(table(spark, sf_dir, "pages"))


def op12_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.product_codes(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_token_files, op3_secret_scan, op4_url_lists, op5_source_mix, op6_exact_top_k, op7_personal_data,
    op8_best_fit_packing, op9_quality_classifier, op10_nearest_neighbours, op11_warc_archives, op12_cover_tree_codes,
    op13_ranked_search,
)}

ORACLES = {
    "op3_secret_scan": credentials.ORACLE,
    "op4_url_lists": url_lists.ORACLE,
    "op6_exact_top_k": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_personal_data": personal.ORACLE,
    "op11_warc_archives": warc.ORACLE,
    "op12_cover_tree_codes": cover_tree.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
}
