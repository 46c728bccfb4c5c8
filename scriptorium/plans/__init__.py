"""Registered queries with their SQL."""

from . import answering, business, curation, evaluation, retrieval

QUERIES = retrieval.QUERIES | curation.QUERIES | evaluation.QUERIES | business.QUERIES | answering.QUERIES
ORACLES = retrieval.ORACLES | curation.ORACLES | evaluation.ORACLES | business.ORACLES | answering.ORACLES
