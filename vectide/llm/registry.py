"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from vectide.llm import queries_copies, queries_models, queries_native, queries_sequences, queries_text

QUERIES = {**queries_copies.QUERIES, **queries_models.QUERIES, **queries_native.QUERIES, **queries_sequences.QUERIES, **queries_text.QUERIES}
SQL = {**queries_native.SQL}
