"""Frames whose columns may have any names: dotted ones, clashing ones, or names that an operator wants to add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(names: list[str], wanted: str) -> int | None:
    """Where a column stands: the first of that very name, else the first that differs in letter case only."""
    exact = next((i for i, n in enumerate(names) if n == wanted), None)
    return exact if exact is not None else next((i for i, n in enumerate(names) if n.lower() == wanted.lower()), None)


def plain(docs: DataFrame, needed: list[str], optional: list[str] = ()) -> DataFrame:
    """``docs`` with the columns that an operator reads under their names, and all others as ``_0``, ``_1`` and so on."""
    names = docs.columns
    new = [f"_{i}" for i in range(len(names))]
    for n in (*needed, *optional):
        at = place(names, n)
        if at is not None:
            new[at] = n
        elif n in needed:
            raise ValueError(f"no column {n} among {names}")
    return docs.toDF(*new)


def restored(out: DataFrame, inner: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``inner`` (made by ``plain`` of ``docs``) from ``out``, under their own names again."""
    return out.select(*inner.columns).toDF(*docs.columns)


def free(wanted: str, names: list[str]) -> str:
    """A name for an added column: the wanted one, with underscores behind it while the input has such a column."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def repeated(df: DataFrame, times: str, block: int = 4096) -> DataFrame:
    """Each row as many times as its column ``times`` says, which is dropped; in blocks, so that no array is longer than one."""
    blocks = df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col(times) - 1) / block).cast("long"))))
    rest = F.least(F.lit(block).cast("long"), F.col(times) - F.col("block") * block)
    return blocks.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), rest))).drop("block", times)


def kind(df: DataFrame, name: str) -> str:
    """The column's type as it is written in schemas."""
    return df.schema[name].dataType.simpleString()


def with_added(out: DataFrame, inner: DataFrame, docs: DataFrame, **added: Column) -> DataFrame:
    """As ``restored``, with further columns behind, each under a free name."""
    names = list(docs.columns)
    for n in added:
        names.append(free(n, names))
    return out.select(*inner.columns, *(c.alias(f"added_{i}") for i, c in enumerate(added.values()))).toDF(*names)
