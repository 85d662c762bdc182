"""Named queries of the core and the SQL that must give the same rows."""

from . import core, core_sql, nested, stores

QUERIES = {**core.QUERIES, **stores.QUERIES, **nested.QUERIES}
SQL = {**core_sql.SQL, **stores.SQL, **nested.SQL}
