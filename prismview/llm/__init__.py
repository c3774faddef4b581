"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from prismview.llm.oracle import ORACLES
from prismview.llm.queries import QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
