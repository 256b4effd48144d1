"""All registered queries of the ledger side and their oracles."""

from . import queries_facts, queries_ingest, queries_pursuit, queries_rules  # noqa: F401  registration on import
from .queries_facts import Q as QUERIES
from .queries_facts import S as ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
