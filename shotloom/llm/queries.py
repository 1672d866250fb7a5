"""The registered queries of the operators: each applies one of them to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotloom.llm import oracles
from shotloom.llm._words import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.secret_scan import report

    return report(read(spark, sf_dir, "documents"))


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.html_wrapper import main_text

    return main_text(read(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shotloom.llm.bpe import encode_decode

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.ngram_join import link

    return link(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.media_columns import summary

    return summary(read(spark, sf_dir, "documents"))


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.quality_rules import apply_policy, ledger, measure

    decided = apply_policy(ledger(measure(read(spark, sf_dir, "documents"))), "v2")
    return decided.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op7_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.quality_rules import ablation, ledger, measure

    return ablation(ledger(measure(read(spark, sf_dir, "documents"))), "v2")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.license_scan import scan

    return scan(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.substring_dedup import dedup

    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.quality_mil import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.dual_tree import cluster

    return cluster(read(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shotloom.llm.token_align import alignment

    return alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotloom.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_wrapper": op2_html_wrapper,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_media_audio": op6_media_audio,
    "op7_rule_ledger": op7_rule_ledger,
    "op7_rule_ablation": op7_rule_ablation,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_attention_mil": op10_attention_mil,
    "op11_dual_tree_lloyd": op11_dual_tree_lloyd,
    "op12_token_alignment": op12_token_alignment,
    "op13_hyperminhash": op13_hyperminhash,
}

ORACLES: dict[str, str] = {
    "op5_ngram_join": oracles.NGRAM_JOIN,
    "op7_rule_ledger": oracles.RULE_LEDGER,
    "op7_rule_ablation": oracles.RULE_ABLATION,
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op11_dual_tree_lloyd": oracles.LLOYD,
    "op13_hyperminhash": oracles.MINHASH,
}
