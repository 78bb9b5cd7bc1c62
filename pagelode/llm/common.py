"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of the contracts: runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(column: str | Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(column, UPPER, LOWER)


def words(column: str | Column) -> Column:
    """The words of a text in order; an empty array for null or no word."""
    text = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return F.array_remove(F.split(text, SPACE), "")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(column, F.lit(""))


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores added until no column of ``taken`` has it.

    Spark resolves names without regard to case.
    """
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def own_names(operator):
    """Let an operator on a frame use names that begin with an underscore for itself.

    Columns of the frame with such names are put aside under other names and come back
    under their own; names given as arguments follow.
    """

    @wraps(operator)
    def run(df: DataFrame, *args, **options):
        aside: dict[str, str] = {}
        for c in df.columns:
            if c.startswith("_"):
                aside[c] = free_name(f"aside{c}", [*df.columns, *aside.values()])
        if not aside:
            return operator(df, *args, **options)
        follow = lambda x: aside.get(x, x) if isinstance(x, str) else x
        renamed = df.withColumnsRenamed(aside)
        out = operator(renamed, *map(follow, args), **{k: follow(v) for k, v in options.items()})
        return out.withColumnsRenamed({held: c for c, held in aside.items()})

    return run


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once for each row.

    A column used inside a lambda may be replaced by its expression when a filter moves
    below the projection, and then runs for every element; a lambda's variable cannot.
    """
    return F.get(F.transform(F.array(value), body), 0)


def sha256(column: str | Column) -> Column:
    """Lower-case hex of the UTF-8 bytes."""
    return F.sha2(column, 256)


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts
