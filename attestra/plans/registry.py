"""All registered queries of the library."""

from . import core, detail, integrity, listed, maintained, more, notices, portal, streams

MODULES = (core, more, detail, notices, listed, maintained, portal, integrity, streams)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
