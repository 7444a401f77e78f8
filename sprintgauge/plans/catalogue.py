"""All registered queries and the SQL that answers the same question."""

from __future__ import annotations

import functools

from ..session import ship_package
from . import curation, evaluation, modelling, retrieval

_AREAS = [curation, evaluation, retrieval, modelling]


def _shipped(query):
    """``query`` with the package sent to workers first: a Python step binds what was sent before."""
    @functools.wraps(query)
    def run(spark, sf_dir):
        return query(ship_package(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(query) for area in _AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
