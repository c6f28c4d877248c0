"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from creditloom.plans.registry import REGISTRY, Query

# In the order in which queries are listed and timed.
_MODULES = (
    "feature_queries",
    "segment_queries",
    "sampling_queries",
    "evaluation_queries",
    "ingest_queries",
    "model_queries",
)


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"creditloom.plans.{module}")
    return dict(REGISTRY)
