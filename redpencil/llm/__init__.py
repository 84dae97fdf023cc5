"""Operators for preparing language-model training data: deduplication, scans, scoring, formatting and packing.

Nothing else in the package imports this subpackage. Its queries are listed in ``redpencil.llm.queries``.
"""
