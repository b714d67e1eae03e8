"""The queries of this subpackage, by the names the repository entry point registers, and their SQL."""

from __future__ import annotations

from . import ann, chat, decontaminate, langid, lexical, packing, quality, repeats, secrets, sharding, simhash, toxicity, variants

MODULES = {
    "op1_packing": packing,
    "op2_simhash": simhash,
    "op3_chat_perspectives": chat,
    "op4_toxicity": toxicity,
    "op5_secrets": secrets,
    "op6_quality": quality,
    "op7_language_id": langid,
    "op8_ann": ann,
    "op9_decontamination": decontaminate,
    "op10_repeats": repeats,
    "op11_lexical": lexical,
    "op12_variants": variants,
    "op13_sharding": sharding,
}


def queries() -> dict:
    """Query functions (spark, sf_dir) by name."""
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name, for the operators that SQL can express."""
    return {name: module.ORACLE for name, module in MODULES.items() if hasattr(module, "ORACLE")}
