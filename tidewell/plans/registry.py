"""Names of all registered queries, with the SQL that states each one's meaning."""

from __future__ import annotations

from . import activity, corpus, live, people, reading

QUERIES = activity.QUERIES | corpus.QUERIES | people.QUERIES | reading.QUERIES | live.QUERIES
ORACLE_SQL = activity.ORACLE_SQL | corpus.ORACLE_SQL | people.ORACLE_SQL | reading.ORACLE_SQL | live.ORACLE_SQL
