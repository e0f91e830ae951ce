"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name, module.
_MODULES = (
    ("op1_chat_format", "chat"),
    ("op2_source_mix", "mixing"),
    ("op3_ngram_join", "ngrams"),
    ("op4_pii", "pii"),
    ("op5_line_dedup", "lines"),
    ("op6_exact_dedup", "exact"),
    ("op7_language_id", "langid"),
    ("op8_url_filter", "urls"),
    ("op9_byte_bpe", "bpe"),
    ("op10_vector_dedup", "vectors"),
    ("op11_merkle_manifest", "merkle"),
    ("op12_license_scan", "licenses"),
    ("op13_source_divergence", "divergence"),
)


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in _MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in _MODULES}
    return {name: sql for name, sql in found.items() if sql}
