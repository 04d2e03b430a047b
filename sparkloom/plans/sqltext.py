"""Queries whose plan is one SQL text, run by Spark and, as the twin, by DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.registry import Registry
from sparkloom.sources.tables import table

_NAME = re.compile(r"\{([a-z]\w*)\}")


def r2(x: str, digits: int = 2) -> str:
    """SQL for a double rounded half away from zero the same way in both engines."""
    k = 10**digits
    return f"(sign({x}) * floor(abs({x}) * {k} + 0.5) / {k})"


def cents(x: str) -> str:
    """SQL for money in a double as whole cents."""
    return f"CAST(round({x} * 100) AS BIGINT)"


#: Revenue of a line in hundredths of a cent: exact in integers.
REVENUE = f"({cents('l_extendedprice')} * (100 - CAST(round(l_discount * 100) AS BIGINT)))"


def as_twin(sql: str) -> str:
    return _NAME.sub(r"\1", sql)


def sql_query(registry: Registry, name: str, sql: str, twin: str | None = None) -> None:
    """Register `sql`, with {table} for tables; `twin` where DuckDB writes something differently."""
    tables = sorted(set(_NAME.findall(sql)))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf, t) for t in tables})

    run.__doc__ = " ".join(sql.split())[:120]
    registry.add(name, as_twin(twin or sql))(run)
