"""The registered queries of this subpackage, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation_repair, decontaminate, license_scan, mixture_shards, near_dedup, packing, pii, prefix_trie, suffix_tree, token_counts, toxicity, url_filter
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def public_vocabulary() -> packing.Vocabulary:
    return packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_vocabulary()))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, sf_dir, "documents"))


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    names = F.filter(F.col("notices.license"), lambda x: x != "unknown")
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_sort(F.array_distinct(names)).alias("licenses"), "notices")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(conversation_repair.damage(table(spark, sf_dir, "conversations")), "present")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_mixture_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shards.digest(mixture_shards.assign_shards(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_packing, op2_pii_spans, op3_near_duplicates, op4_suffix_tree_scores, op5_benchmark_leaks, op6_nearest_vectors, op7_url_verdicts, op8_toxicity, op9_token_counts, op10_license_notices,
        op11_conversation_repair, op12_conversation_trie, op13_mixture_shards)
}

ORACLE: dict[str, str] = {
    "op11_conversation_repair": conversation_repair.REPAIR_SQL,
    "op12_conversation_trie": prefix_trie.TRIE_SQL,
    "op13_mixture_shards": mixture_shards.SHARDS_SQL,
    "op5_benchmark_leaks": decontaminate.LEAKS_SQL,
    "op6_nearest_vectors": """
        with good as (
            select vec_id, embedding::double[] as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs as (
            select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) as score
            from good q join good c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
        ranked as (select *, row_number() over (partition by query_id order by score, vec_id)::integer as rank from pairs)
        select query_id, rank, vec_id, score from ranked where rank <= 10""",
}
