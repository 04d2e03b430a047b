"""A small measure layer: named aggregates, defined once, evaluated in any context."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REF = re.compile(r"\[(\w+)(@all)?\]")


class Measures:
    """Measures are SQL aggregates over the rows of a context, or expressions over other measures: [name], and
    [name@all] for the measure over all rows of the context, whatever the grouping.

    Base measures come from one aggregation, those over all rows from one more (a single row, broadcast); derived
    ones are projections. A measure that refers to an unknown one, or in a circle, is an error.
    """

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def add(self, name: str, sql: str) -> Measures:
        self.known[name] = sql
        return self

    def _needed(self, name: str, path: tuple[str, ...] = ()) -> list[str]:
        """Base measures and derived ones that a measure needs, those it needs first."""
        if name not in self.known or name in path:
            raise ValueError(f"measure {name} is unknown or defined by itself")
        out = []
        for m in _REF.finditer(self.known[name]):
            out += self._needed(m[1], (*path, name))
        return [*out, name]

    def evaluate(self, df: DataFrame, measures: list[str], by: list[str]) -> DataFrame:
        """One row per combination of `by` (one in all without any) with the measures asked for."""
        needed = list(dict.fromkeys(x for m in measures for x in self._needed(m)))
        base = [m for m in needed if not _REF.search(self.known[m])]
        whole = sorted({m[1] for x in needed for m in _REF.finditer(self.known[x]) if m[2]})
        if any(_REF.search(self.known[w]) for w in whole):
            raise ValueError("only a base measure can be taken over all rows")
        out = df.groupBy(*by).agg(*[F.expr(self.known[m]).alias(m) for m in base])
        if whole:
            out = out.crossJoin(F.broadcast(df.agg(*[F.expr(self.known[w]).alias(f"{w}__all") for w in whole])))
        for m in needed:
            if m not in base:
                out = out.withColumn(m, F.expr(_REF.sub(lambda x: f"`{x[1]}__all`" if x[2] else f"`{x[1]}`", self.known[m])))
        return out.select(*by, *measures)
