"""Counts of a run, taken on its own plan while it runs: no pass over the data is made for them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Named counts. Each is there once an action has run over the DataFrame that rows() or values() gave back."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def values(self, df: DataFrame, name: str, *more: Column) -> DataFrame:
        """df as it is; its rows, and `more` aggregates, will be told under `name`."""
        self._seen[name] = Observation(f"{name} {uuid.uuid4()}")
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *more)

    def told(self) -> dict[str, dict]:
        """{name: {rows, ...}}. Waits for an action that has begun; one must have, or it would wait for ever."""
        return {name: dict(o.get) for name, o in self._seen.items()}


def missing(df: DataFrame) -> list[Column]:
    """How many rows lack a value, for each floating column."""
    return [F.sum(F.col(f.name).isNull().cast("long")).alias(f"no_{f.name}") for f in df.schema if f.dataType.simpleString() in ("double", "float")]
