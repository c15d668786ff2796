"""Registry of the checked queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df, digits: int = 6, special: dict | None = None):
    """Floating columns to doubles rounded for comparison, integers to bigint."""
    from pyspark.sql import functions as F

    out, special = [], special or {}
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("double", "float") or t.startswith("decimal"):
            out.append((F.round(F.col(f"`{f.name}`").cast("double"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name))
        elif t in ("integer", "byte", "short", "long"):
            out.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def rsql(cols, digits: int | None = 6) -> str:
    """The same rounding in SQL: ``{alias: expression}`` to a select list."""
    if digits is None:
        return ", ".join(f'cast({e} AS double) AS "{a}"' for a, e in cols.items())
    return ", ".join(
        f'round(cast({expr} AS double), {digits}) + 0.0::double AS "{alias}"'
        for alias, expr in cols.items()
    )
