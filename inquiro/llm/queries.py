"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inquiro.llm import chat_template, decontamination, line_dedup, line_rules, link_filter, mixing, prefix_trie, sharding, simhash, source_divergence, suffix_tree, token_counts, toxicity
from inquiro.llm.common import table


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op2_link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_documents(table(spark, sf_dir, "documents"), with_text=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_template.format_conversations(chat_template.with_control_case(table(spark, sf_dir, "conversations")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_tree, op2_link_filter, op3_line_rules, op4_simhash, op5_toxicity, op6_sharding, op7_decontamination, op8_token_counts, op9_mixing, op10_chat_template, op11_source_divergence, op12_prefix_trie, op13_line_dedup, pipeline)
}
ORACLES: dict[str, str] = {"op9_mixing": mixing.ORACLE_SQL, "op11_source_divergence": source_divergence.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_line_dedup": line_dedup.ORACLE_SQL}
