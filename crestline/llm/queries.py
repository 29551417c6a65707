"""The queries of this subpackage, by the names they are registered under, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_trie import op8_bpe_trie
from .hamming_search import OP1_SQL, op1_hamming_top_k
from .lattice_lm import op4_lattice_lm
from .license_scan import op5_license_scan
from .line_dedup import OP9_SQL, op9_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .packing import op6_packing
from .quality_classifier import op3_quality_classifier
from .quality_rules import OP7_SQL, op7_quality_rules
from .simhash import op10_simhash
from .token_counts import op2_token_counts
from .url_filter import OP11_SQL, op11_url_filter
from .whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_top_k": op1_hamming_top_k,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_license_scan": op5_license_scan,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe_trie": op8_bpe_trie,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_url_filter": op11_url_filter,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op1_hamming_top_k": OP1_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_url_filter": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
