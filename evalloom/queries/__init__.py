"""Queries over the driver tables."""

from evalloom.queries import boards, corpus, grading, layers, logs, registries, storage
from evalloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "boards", "corpus", "grading", "layers", "logs", "registries", "storage"]
