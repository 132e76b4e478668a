"""The library's queries by name, and SQL for those that SQL can express."""

from webloom.plans import changes, web

QUERIES = {**changes.QUERIES, **web.QUERIES}
ORACLE_SQL = {**changes.ORACLE_SQL, **web.ORACLE_SQL}
