"""Relational operators: deduplication, ranking, quotas, graph closure."""
