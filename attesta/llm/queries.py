"""The registered queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_embedding_dedup": "embeddings",
    "op2_url_filter": "urls",
    "op3_toxicity": "toxicity",
    "op4_suffix_dedup": "suffix",
    "op5_simhash": "simhash",
    "op6_token_files": "tokenfile",
    "op7_decontamination": "decontaminate",
    "op8_substring_dedup": "substring",
    "op9_packing": "packing",
    "op10_line_dedup": "lines",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
