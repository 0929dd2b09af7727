"""All registered queries (importing the catalog modules fills the registry)."""

from __future__ import annotations

from corpusflow.plans import catalog_chat, catalog_enrich, catalog_io, catalog_mix, catalog_stream, catalog_text  # noqa: F401
from corpusflow.plans.registry import REGISTRY


def queries() -> dict:
    """Name -> Spark job over the driver tables."""
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    """Name -> DuckDB twin of the Spark job."""
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
