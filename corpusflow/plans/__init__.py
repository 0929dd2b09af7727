"""End-to-end jobs and the query catalog (each query has a DuckDB twin)."""
