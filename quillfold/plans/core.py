"""Registry of the queries outside the subpackage for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillfold.plans import controlq, exportq, identityq, ledgerq, mailops, mailq, scoreq, shapeq, signalq, streamq, toolq

MODULES = (mailops, ledgerq, mailq, signalq, identityq, toolq, scoreq, controlq, shapeq, exportq, streamq)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
