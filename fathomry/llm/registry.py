"""The queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arc_to_warc, chat_format, collocations, common, ctw, decontaminate, jaccard_join, packing, prefix_trie, quality_rules, sharding, substring_dedup, toxicity, weak_labels


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(common.documents(spark, sf_dir))


def op2_pack_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), tokenizer_path())


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(common.documents(spark, sf_dir)).drop("item")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.windows(chat_format.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(common.documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(common.documents(spark, sf_dir, "doc_id", "text"))


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(common.documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("prefix_sha256")


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.documents(spark, sf_dir, "lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ctw_score,
        op2_pack_best_two_fit,
        op3_jaccard_join,
        op4_chat_windows,
        op5_weak_labels,
        op6_quality_rules,
        op7_toxicity_pu,
        op8_shard_ring,
        op9_decontaminate,
        op10_substring_dedup,
        op11_prefix_trie,
        op12_arc_to_warc,
        op13_collocations,
    )
}
ORACLE: dict[str, str] = {"op4_chat_windows": chat_format.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL, "op12_arc_to_warc": arc_to_warc.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
