"""Registry of the named queries and their SQL equivalents.

Each entry pairs a Spark query ``fn(spark, sf_dir) -> DataFrame`` with an
optional DuckDB SQL text over the given tables.  Results are normalised the
same way on both sides: integer columns as BIGINT, floating columns rounded
to 6 places.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUND_PLACES = 6


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    ints: tuple = ()
    doubles: tuple = ()
    doc: str = ""
    extra: dict = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize(self.fn(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        repl = [f"CAST({_qi(c)} AS BIGINT) AS {_qi(c)}" for c in self.ints]
        repl += [f"round(CAST({_qi(c)} AS DOUBLE), {ROUND_PLACES}) AS {_qi(c)}" for c in self.doubles]
        if not repl:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{self.sql}\n) AS q"


def _qi(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ints=(), doubles=(), doc: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, tuple(ints), tuple(doubles), doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def normalize(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, floating values rounded to 6 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), ROUND_PLACES)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    import importlib
    for mod in MODULES:
        importlib.import_module(f"patchlens.catalog.{mod}")
    return REGISTRY


MODULES = ["prep", "textq", "commits", "profileq", "splitsq", "metricsq", "resultsq", "tfidfq", "explainq", "modelsq", "ioq", "reportsq"]
