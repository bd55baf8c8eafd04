"""Registry of the named queries: name -> (Spark builder, oracle SQL builder).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the given tables; the SQL builder returns DuckDB/ANSI text over the same
tables, or is ``None`` where the operator has no SQL form (seeded training).
"""

from __future__ import annotations

import importlib

MODULES = ["bias_report", "source_queries", "text_queries", "profile_queries", "dataset_queries", "vocab_queries", "quality_queries", "model_queries", "baseline"]


def registry() -> dict:
    out: dict = {}
    for m in MODULES:
        mod = importlib.import_module(f"biasframe.plans.{m}")
        for name, entry in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = entry
    return out
