"""The registered queries of the text operators, over whole tables, and the SQL where it can express them."""

from __future__ import annotations

from pulsegate.llm import chat_format, decontaminate, line_dedup, mixing, quality_rules, secret_scan, shallot, simhash_dedup, substring_dedup, token_counts, token_store, vantage, whitening
from pulsegate.llm.common import table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.repeat_digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts.token_digest(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark, sf_dir):
    return simhash_dedup.simhash_digest(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_store(spark, sf_dir):
    return token_store.store_digest(table(spark, sf_dir, "documents"))


def op6_source_mix(spark, sf_dir):
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    return chat_format.chat_digest(table(spark, sf_dir, "conversations"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_digest(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.scan_digest(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark, sf_dir):
    return shallot.clusters_digest(table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark, sf_dir):
    return vantage.neighbours_digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_store": op5_token_store,
    "op6_source_mix": op6_source_mix,
    "op7_chat_format": op7_chat_format,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLES = {
    "op7_chat_format": chat_format.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op12_centroid_clustering": shallot.ORACLE,
    "op13_nearest_neighbours": vantage.ORACLE,
}
