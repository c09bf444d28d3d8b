"""All queries of the library by name, and the SQL twin of each that has one."""

from __future__ import annotations

from lodestone.plans import building, corpus, service, vectors

QUERIES = vectors.QUERIES | corpus.QUERIES | building.QUERIES | service.QUERIES
SQL = vectors.SQL | corpus.SQL | building.SQL | service.SQL
