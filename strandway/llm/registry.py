"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from strandway.llm import queries as q
from strandway.llm import sql


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.SQL.items() if k in q.QUERIES}
