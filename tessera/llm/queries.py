"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query name -> (module, function)
_QUERIES = {
    "op1_quality": ("quality", "op1_quality"),
    "op2_media": ("media", "op2_media"),
    "op3_repeats": ("repeats", "op3_repeats"),
    "op4_jaccard": ("jaccard", "op4_jaccard"),
    "op5_bpe": ("tokens", "op5_bpe"),
    "op6_quality_classifier": ("classifier", "op6_quality_classifier"),
    "op7_secrets": ("secrets", "op7_secrets"),
    "op8_chat": ("chat", "op8_chat"),
    "op9_packing": ("packing", "op9_packing"),
    "op10_language": ("language", "op10_language"),
}


def queries() -> dict:
    out = {name: getattr(importlib.import_module(f"tessera.llm.{module}"), function) for name, (module, function) in _QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(m for m, _ in _QUERIES.values()):
        out |= getattr(importlib.import_module(f"tessera.llm.{module}"), "ORACLE", {})
    return out
