"""Registration of named queries and of the derived views they read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class View:
    name: str
    sql: str
    duck: str | None = None

    def mentions(self, names) -> list[str]:
        return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", self.sql)]


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[["Inputs"], DataFrame]
    sql: str | None


VIEWS: dict[str, View] = {}
QUERIES: dict[str, Query] = {}


def view(name: str, sql: str, duck: str | None = None) -> None:
    """Define a derived view; ``duck`` replaces the text where the dialects differ."""
    VIEWS[name] = View(name, sql, duck)


def query(key: str, sql: str | None = None):
    """Register the decorated function under ``key``; ``sql`` may read any view by name."""

    def register(fn):
        QUERIES[key] = Query(key, fn, sql)
        return fn

    return register


def _view_order(sql: str) -> list[str]:
    """Derived views that ``sql`` reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, definition in VIEWS.items():
            if name in order or not re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                continue
            visit(definition.sql)
            if name not in order:
                order.append(name)

    visit(sql)
    return order


def oracle_text(q: Query) -> str | None:
    """The query's SQL with the views it reads placed in front as common table expressions."""
    if q.sql is None:
        return None
    parts = [f"{n} AS ({VIEWS[n].duck or VIEWS[n].sql})" for n in _view_order(q.sql)]
    body = q.sql.strip()
    own = re.match(r"WITH\s+(?:RECURSIVE\s+)?(.*)", body, re.S)
    if own:
        return "WITH RECURSIVE " + ",\n".join(parts + [own.group(1)])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


class Inputs:
    """Base tables and derived views of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                definition = VIEWS[name]
                for dep in definition.mentions([*BASE_TABLES, *VIEWS]):
                    self[dep].createOrReplaceTempView(dep)
                frame = self.spark.sql(definition.sql)
            self._frames[name] = frame
        return self._frames[name]
