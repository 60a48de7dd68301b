"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bm25, byte_bpe, merkle, mixing, near_vectors, ngram_jaccard, quality, repair, secrets, token_files, url_rules, warc, word_table


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_quality_classifier": lambda s, d: quality.scored_documents(_table(s, d, "documents"), _table(s, d, "labels")),
    "op2_byte_bpe": lambda s, d: byte_bpe.digests(s, _table(s, d, "documents")),
    "op3_source_mixing": lambda s, d: mixing.mix_report(_table(s, d, "documents")),
    "op4_ngram_jaccard": lambda s, d: ngram_jaccard.jaccard_components(_table(s, d, "documents")),
    "op5_warc": lambda s, d: warc.round_trip(_table(s, d, "pages")),
    "op6_token_files": lambda s, d: token_files.token_digests(_table(s, d, "documents")),
    "op7_secret_scan": lambda s, d: secrets.secret_digests(_table(s, d, "documents")),
    "op8_url_rules": lambda s, d: url_rules.judge(_table(s, d, "pages"), url_rules.rule_table(s)),
    "op9_bm25": lambda s, d: bm25.search_documents(_table(s, d, "documents")),
    "op10_near_vectors": lambda s, d: near_vectors.near_vectors(_table(s, d, "embeddings")),
    "op11_conversation_repair": lambda s, d: repair.repair_report(_table(s, d, "conversations")),
    "op12_merkle_manifest": lambda s, d: merkle.manifest_report(_table(s, d, "documents")),
    "op13_word_bpe": lambda s, d: word_table.digests(_table(s, d, "documents")),
}

ORACLE = {
    "op3_source_mixing": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op8_url_rules": url_rules.ORACLE,
    "op10_near_vectors": near_vectors.ORACLE,
    "op11_conversation_repair": repair.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
