"""Queries over the driver tables, one module per area."""

from importlib import import_module

MODULES = ["time_queries", "table_queries", "score_queries", "text_queries", "report_queries", "model_queries", "source_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"sensorloom.workload.{name}")
