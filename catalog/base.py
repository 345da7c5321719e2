"""Registry and shared SQL fragments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.fixtures import FIXTURES
from profilelab.sources.readers import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-02-01"

# White space as the operators strip it (the characters that occur in the data).
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _named(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", sql, re.I)]


def fx(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived input table: the statement of the same name in fixtures.py run over the given tables."""
    sql = FIXTURES.get(name, f"SELECT * FROM {name}")
    for t in _named(sql):
        spread(spark.read.parquet(f"{sf}/{t}.parquet")).createOrReplaceTempView(t)
    return spark.sql(sql)


def with_fx(body: str) -> str:
    """Prefix a SQL text with the derived tables it names."""
    used = [n for n in FIXTURES if re.search(rf"\b(?:from|join)\s+{n}\b", body, re.I)]
    if not used:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in used)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def _plain(df: DataFrame) -> DataFrame:
    """Widen small numeric types so both engines return the same kinds."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: _plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = with_fx(sql)
        return fn

    return add
