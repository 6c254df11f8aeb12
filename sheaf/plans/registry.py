"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import documents, reports, search

QUERIES = {**documents.QUERIES, **search.QUERIES, **reports.QUERIES}
ORACLE_SQL = {**documents.ORACLE_SQL, **search.ORACLE_SQL, **reports.ORACLE_SQL}
