"""Registered queries: key -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def sql_draw(seed: str, modulus: int) -> str:
    return f"(('0x'||substr(md5({seed}),1,8))::BIGINT % {modulus})"


def sql_list(values) -> str:
    return "[" + ",".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ",".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"
