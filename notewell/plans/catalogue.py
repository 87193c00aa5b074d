"""All queries of the library by name, and their SQL."""

from . import dashboard, history, notes, retrieval, sync, telemetry, vault

MODULES = (retrieval, notes, dashboard, sync, history, vault, telemetry)
QUERIES = {name: q for m in MODULES for name, q in m.CATALOGUE.queries.items()}
SQL = {name: q for m in MODULES for name, q in m.CATALOGUE.sql.items()}
