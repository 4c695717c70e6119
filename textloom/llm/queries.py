"""The queries of this folder, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_weighted_fingerprints": "weighted_fingerprints",
    "op8_simhash_groups": "simhash_groups",
    "op7_rule_forest": "rule_forest",
    "op5_pu_quality": "pu_quality",
    "op6_repeat_automata": "repeat_automata",
    "op3_token_files": "token_files",
    "op9_curve_packing": "curve_packing",
    "op4_dom_marginals": "dom_marginals",
    "op10_piece_backtracking": "piece_backtracking",
    "op2_katz_backoff": "katz_backoff",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return getattr(import_module(f".{_MODULES[name]}", __package__), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
