"""All queries over the test tables by name, and the SQL that says the same."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import files, files_sql, sql
from factloom.plans import queries as q

#: Helpers of the queries module that are no queries.
HELPERS = {"table", "rounded", "held_out", "predictions1", "predictions2", "gold2", "answered1"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in (q, files) for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and not n.startswith("_") and n not in HELPERS}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | files_sql.oracle_sql()
