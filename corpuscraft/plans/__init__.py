"""Registered queries: each binds operators to tables, with an equivalent SQL text where SQL can express it."""

from . import artifacts, contracts, coverage, curation, curriculum, evaluation, formulations, generators, grading, materials, sequences, streams  # noqa: F401
from ._registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
