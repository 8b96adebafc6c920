"""SQL for the queries of this subpackage that DuckDB can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {"p7_roundtrip": "SELECT doc_id, TRUE AS same FROM documents"}
