"""One query for each operator of this folder, over its whole table."""

from __future__ import annotations

import public_tokenizers

from tidewright.llm import bpe, chat, chat_repair, exact_dedup, hard_negatives, html_text, jaccard_join, mixing, quality_nbsvm, quality_rules, simhash, substring_dedup, toxicity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark, sf_dir):
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op3_chat_collapse(spark, sf_dir):
    return chat.collapse(_table(spark, sf_dir, "conversations"))


def op4_quality_nbsvm(spark, sf_dir):
    return quality_nbsvm.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash_golay(spark, sf_dir):
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_rules(spark, sf_dir):
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.group_copies(_table(spark, sf_dir, "documents"))


def op11_ngram_jaccard(spark, sf_dir):
    return jaccard_join.similar(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


def op13_chat_repair(spark, sf_dir):
    return chat_repair.report(chat_repair.damaged(_table(spark, sf_dir, "conversations")))


QUERIES = (op1_source_mix, op2_substring_dedup, op3_chat_collapse, op4_quality_nbsvm, op5_simhash_golay, op6_byte_bpe, op7_quality_rules, op8_toxicity, op9_html_text, op10_exact_dedup, op11_ngram_jaccard, op12_hard_negatives, op13_chat_repair)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": mixing.ORACLE, "op2_substring_dedup": substring_dedup.ORACLE, "op3_chat_collapse": chat.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_ngram_jaccard": jaccard_join.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_chat_repair": chat_repair.ORACLE}
