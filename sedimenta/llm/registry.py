"""Queries of the text operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_secret_scan": "secret_scan",
    "op3_byte_bpe": "byte_bpe",
    "op4_mixing": "mixing",
    "op5_quality_rules": "quality_rules",
    "op6_language_id": "language_id",
    "op7_gif_media": "gif_media",
    "op8_quality_bayes": "quality_bayes",
    "op9_minhash": "minhash",
    "op10_warc": "warc",
}


def _query(name: str, module: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(name, module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {k: v for k, v in found.items() if v}
