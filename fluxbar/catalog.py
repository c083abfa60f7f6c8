"""Registry of the library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

_queries: dict = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name."""

    def keep(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def _load() -> None:
    from fluxbar.plans import market, research, runs, trials  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
