"""Queries of this subpackage and their SQL, by name."""

from . import embedding_dup, language, media, mixing, near_dup, packing, pii, quality, token_counts, toxicity

MODULES = (packing, media, pii, toxicity, mixing, quality, near_dup, language, embedding_dup, token_counts)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
