"""Wires operators to the shared tables; importing it fills the registry."""

from talkspark.plans import queries_captions, queries_chapters, queries_segment, queries_sources, queries_terms, queries_translation, queries_words  # noqa: F401
from talkspark.plans.registry import ORACLES, QUERIES  # noqa: F401
