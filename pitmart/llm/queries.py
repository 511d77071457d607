"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitmart.llm import chat, fingerprints, language_model, lattice, licenses, minhash, mixing, packing, pii, prefix_trie, quality, repeats, survival

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_licenses": licenses.op2_licenses,
    "op3_language_model": language_model.op3_language_model,
    "op4_pii": pii.op4_pii,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_repeats": repeats.op6_repeats,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_tool_calls": chat.op9_tool_calls,
    "op10_mixing": mixing.op10_mixing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_filter_audit": survival.op12_filter_audit,
    "op13_embedding_near_duplicates": lattice.op13_embedding_near_duplicates,
}
ORACLE_SQL: dict[str, str] = {"op2_licenses": licenses.ORACLE_SQL, "op9_tool_calls": chat.ORACLE_SQL, "op12_filter_audit": survival.ORACLE_SQL}
