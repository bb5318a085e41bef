"""The subpackage's named queries and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module and function of it; modules load when their query is asked for.
NAMES = {
    "op1_chat_snapshots": ("tesserae.llm.chat", "op1"),
    "op2_host_rules": ("tesserae.llm.host_rules", "op2"),
    "op3_byte_bpe": ("tesserae.llm.byte_bpe", "op3"),
    "op4_substring_dedup": ("tesserae.llm.substring_dedup", "op4"),
    "op5_warc_round_trip": ("tesserae.llm.warc", "op5"),
    "op6_quality_classifier": ("tesserae.llm.quality", "op6"),
    "op7_packing": ("tesserae.llm.packing", "op7"),
    "op8_ngram_jaccard_join": ("tesserae.llm.ngram_join", "op8"),
    "op9_order_minhash": ("tesserae.llm.order_minhash", "op9"),
    "op10_toxicity": ("tesserae.llm.toxicity", "op10"),
    "op11_filter_audit": ("tesserae.llm.filter_audit", "op11"),
    "op12_token_counts": ("tesserae.llm.token_counts", "op12"),
    "op13_prefix_trie": ("tesserae.llm.prefix_trie", "op13"),
    "pipeline": ("corpus_pipeline", "run"),
}


def _lazy(module: str, name: str):
    def run(spark, sf_dir: str):
        return getattr(importlib.import_module(module), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _lazy(*where) for name, where in NAMES.items()}


def oracles() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    from .sql import ORACLES

    return {**ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
