"""All queries of the subpackage, and their SQL."""

from __future__ import annotations

from lodestone.llm import leaks, log_entropy, near_duplicates, pack_bins, quality, rank_scores, similar_vectors, split_text, term_counts

_MODULES = [similar_vectors, split_text, term_counts, near_duplicates, rank_scores, log_entropy, pack_bins, leaks, quality]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
