"""Registration of queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc
from .views import sql_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Registered] = {}


def query(name: str, *, ids: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the adapter views that the SQL text uses."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else with_views(sql, views.split())
        REGISTRY[name] = Registered(run, text, tuple(ids.split()))
        return fn

    return register


def with_views(sql: str, views: list[str]) -> str:
    body = sql.strip().rstrip(";")
    ctes = sql_views(views)
    if not ctes:
        return body
    prefix = "with " + ",\n".join(f"{name} as ({text})" for name, text in ctes)
    if body.lower().startswith("with "):
        return prefix + ",\n" + body[5:]
    return prefix + "\n" + body
