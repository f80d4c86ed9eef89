"""All queries of the core, by name, with their SQL twins."""

from __future__ import annotations

from spandrel.plans import data_queries, estate_queries, more_queries, reference_queries

QUERIES = data_queries.QUERIES | reference_queries.QUERIES | more_queries.QUERIES | estate_queries.QUERIES
ORACLE = data_queries.ORACLE | reference_queries.ORACLE | more_queries.ORACLE | estate_queries.ORACLE
FLAGSHIP = reference_queries.blast_radius
