"""Registered queries of the core library and their SQL."""

from tillroll.queries import curation, layout, receipts, tables

QUERIES: dict = receipts.QUERIES | layout.QUERIES | curation.QUERIES | tables.QUERIES
ORACLE_SQL: dict[str, str] = receipts.ORACLE_SQL | layout.ORACLE_SQL | curation.ORACLE_SQL | tables.ORACLE_SQL
