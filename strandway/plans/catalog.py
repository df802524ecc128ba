"""Registry of the trajectory queries: name -> (spark, sf_dir) -> DataFrame, and their SQL twins."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name``, with its DuckDB twin if it has one."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from strandway.plans import queries_core, queries_episodes, queries_evaluation, queries_exact, queries_misc, queries_more, queries_records, queries_retrieval, queries_windows  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
