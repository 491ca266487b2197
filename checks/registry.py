"""Query registry: name -> Spark callable, name -> DuckDB SQL."""

from checks.tables import Tables

QUERIES = {}
ORACLES = {}


def query(name, *ctes, select=None):
    """Register a builder ``fn(tables)``; ``ctes`` and ``select`` make up its oracle."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if select:
            head = "WITH " + ",".join(ctes) + "\n" if ctes else ""
            ORACLES[name] = head + select
        return fn

    return add


def same_result(name, of):
    """Register a builder whose rows have to be those of another query, by that query's oracle."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ORACLES[name] = ORACLES[of]
        return fn

    return add
