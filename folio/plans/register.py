"""Where plans enter their queries, with SQL that gives the same rows."""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return enter
