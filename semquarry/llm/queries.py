"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query: module
_MODULES = {
    "op1_jaccard": "jaccard",
    "op2_pieces": "pieces",
    "op3_topk": "topk",
    "op4_wrappers": "wrappers",
    "op5_attention": "attention",
    "op6_toxicity": "toxicity",
    "op7_packing": "packing",
    "op8_neardup": "neardup",
    "op9_secrets": "secrets",
    "op10_shards": "shards",
}
_SQL = {"op3_topk": ("topk", "OP3_SQL"), "op8_neardup": ("neardup", "OP8_SQL"), "op10_shards": ("shards", "OP10_SQL")}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in _SQL.items()}
