"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.plans import batches, bindings, files, graph, laws, lookups, mixtures, networks, parts, pipes, prepared, reconcile, series, solved, solvers

MODULES = [reconcile, series, graph, bindings, laws, mixtures, pipes, networks, parts, solvers, solved, batches, files, lookups, prepared]


def _without_zones(query):
    """query with its timestamps as wall clock in the session's zone, as the tables have them."""

    @wraps(query)
    def run(spark, sf_dir) -> DataFrame:
        df = query(spark, sf_dir)
        zoned = [c for c, kind in df.dtypes if kind == "timestamp"]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df

    return run


def queries() -> dict:
    return {name: _without_zones(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
