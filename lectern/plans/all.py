"""Importing this registers every query of the library."""

from . import catalogue, engine, evaluation, lookup, loops, mentions, naming, outline, provenance, reconcile, retrieval, segmentation, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
