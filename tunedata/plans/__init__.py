"""Registered queries, one module per area."""

from importlib import import_module

AREAS = (
    "normalising",
    "filtering",
    "mixing",
    "pairs",
    "tokenwork",
    "weighting",
    "logstats",
    "scoring",
    "safeness",
    "ranks",
    "monitors",
    "files",
    "streams",
    "models",
)


def load_all() -> None:
    for area in AREAS:
        import_module(f"tunedata.plans.{area}")
