"""All registered queries."""

from __future__ import annotations

import importlib

from skillgrid.plans import registry

MODULES = (
    "cleaning_queries", "skill_queries", "extract_queries", "score_queries", "evidence_queries", "report_queries", "review_queries", "collection_queries", "knowledge_queries", "file_queries", "plugin_queries", "sink_queries",
)

for _name in MODULES:
    importlib.import_module(f"skillgrid.plans.{_name}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)


def flagship(spark, sf_dir):
    return registry.QUERIES["H16_top_similarities"](spark, sf_dir)
