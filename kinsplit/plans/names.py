"""Column names that are free in a table, and names quoted for expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def free(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col(quote(name))


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, by name."""
    return [column(c) for c in df.columns]
