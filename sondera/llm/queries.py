"""The thin queries opN_<name> and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this package that defines it
MODULES = {
    "op1_multiprobe_ann": "ann",
    "op8_line_dedup": "line_dedup",
    "op2_mixing": "mixing",
    "op10_decontamination": "decontaminate",
    "op6_quality": "quality",
    "op5_suffix_dedup": "suffix_dedup",
    "op7_substring_dedup": "substring_dedup",
    "op3_html_text": "html_text",
    "op4_language_id": "langid",
    "op9_simhash": "simhash",
    "op11_ranked_search": "ranked_search",
    "op12_token_files": "token_files",
    "op13_spelling": "spelling",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from .mixing import ORACLE_SQL as mixing
    from .ranked_search import ORACLE_SQL as ranked_search

    return {"op2_mixing": mixing, "op11_ranked_search": ranked_search}
