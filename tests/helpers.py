from __future__ import annotations

import datetime as dt

from cellkpi.sources.schema import fact_schema


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def facts(spark, rows: list[dict], grain: str = "daily"):
    """A fact frame of the full schema from partial rows; dates may be given as text."""
    schema = fact_schema(grain)
    full = []
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
        if isinstance(row.get("DATE_ID"), str):
            row = {**row, "DATE_ID": day(row["DATE_ID"])}
        full.append(tuple(row.get(name) for name in schema.names))
    return spark.createDataFrame(full, schema)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def values(df, *columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
