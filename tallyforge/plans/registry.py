"""Registration of queries: a function of the model, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyforge.sources.model import Model
from tallyforge.sources.model_sql import MODEL_SQL

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", recursive: bool = False):
    """Register under the function's name. ``sql`` follows the model's views, ``more`` adds views of its own, which may be recursive."""

    def register(f: Callable[[Model], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            SQL[name] = (MODEL_SQL.replace("WITH", "WITH RECURSIVE", 1) if recursive else MODEL_SQL) + (", " + more if more else "") + sql
        return f

    return register
