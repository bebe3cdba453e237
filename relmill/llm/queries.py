"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.llm.new_sql import REPAIR, TOP_K, clustering_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.interpolated_lm import interpolated_lm

    return interpolated_lm(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), sha256=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: host, path, action
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


#: Target weights of the synthetic documents' sources.
SOURCE_WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)}


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, and the block, slot, place in the block, window and phase of every document."""
    from relmill.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source"), SOURCE_WEIGHTS)
    return out.select("doc_id", "source", *[F.col(f"_{c}").alias(c) for c in ("block", "slot", "place", "release", "deadline", "phase")])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of its lines, the numbers of those removed and how many they are."""
    from relmill.llm.line_dedup import removed_lines

    docs = table(spark, sf_dir, "documents")
    n = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    gone = removed_lines(docs, min_words=1)
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return n.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.size(lines).cast("long").alias("n_removed"), lines.alias("removed_lines"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from relmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.centroid_clustering import centroid_clustering

    return centroid_clustering(table(spark, sf_dir, "embeddings")).drop("n_exact")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.top_k import exact_top_k

    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relmill.llm.conversation_repair import damaged, repair

    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_interpolated_lm, op3_exact_dedup, op4_repeated_passages, op5_jaccard_join, op6_pfair_mixing, op7_line_dedup, op8_best_fit_packing, op9_embedding_dedup, op10_toxicity, op11_centroid_clustering, op12_exact_top_k, op13_conversation_repair)}

SQL = {
    "op3_exact_dedup": """
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from (select doc_id, coalesce(text, '') as t from documents)
    """,
    "op11_centroid_clustering": clustering_sql(),
    "op12_exact_top_k": TOP_K,
    "op13_conversation_repair": REPAIR,
}
