"""The registry that the plans add their queries to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its function's name, with the SQL that gives the same rows, if there is any."""

    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return add
