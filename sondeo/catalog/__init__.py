"""All registered queries. Importing a module of this package fills the registry."""

from __future__ import annotations

import importlib

from sondeo.catalog.base import ORACLES, QUERIES

MODULES = ["tables", "text_functions", "retrieval", "evaluation", "judging", "logs", "segments", "sync", "streams"]


# Columns that Spark types as int where DuckDB's counters are BIGINT.
INT_COLUMNS = {name: ["rank"] for name in (
    "r01_dense_top_k", "r01_filtered_dense", "r02_sparse_top_k", "r02_sparse_text_search", "r03_lexical_top_k", "r04_reciprocal_rank_fusion",
    "r04_fusion_of_order_lines", "r05_convex_combination", "r06_rerank", "r07_production_search", "r14_mode_comparison", "w01_rank_assignment",
    "a08_snippet_match", "a10_alpha_sweep")} | {"a34_output_sizes": ["max_value", "median", "p90"]}


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"sondeo.catalog.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    out = dict(ORACLES)
    for name, columns in INT_COLUMNS.items():
        casts = ", ".join(f"{c}::INT AS {c}" for c in columns)
        out[name] = f"SELECT * REPLACE ({casts}) FROM ({out[name]})"
    return out
