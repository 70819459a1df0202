"""All registered queries and their SQL, by name."""

from __future__ import annotations

from .plans import base, queries_audit, queries_experiment, queries_files, queries_joins, queries_planning, queries_profile, queries_quality, queries_raster, queries_scalars, queries_selection  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
