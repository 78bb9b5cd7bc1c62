"""Joins that look at sizes before they broadcast.

A side is broadcast only after a bounded probe has shown that it is small. Past
that bound the same join runs as a shuffle, salted where one key may hold a large
part of the big side.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, functions as F

from ..functions.shards import shard_column

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Broadcasts of frames that grow with the corpus, which a query may hold at once: each
#: gets this part of the bounds.
HELD_TOGETHER = 8
SALTS = 32
#: Bytes of a stored table behind one task of what is dealt out from it.
TASK_BYTES = 8 * 1024 * 1024


_SIZES: WeakKeyDictionary = WeakKeyDictionary()


def _bounded_size(df: DataFrame):
    """Rows and bytes of ``df``, reading at most one row more than the bound."""
    if df not in _SIZES:
        _SIZES[df] = (
            df.limit(BROADCAST_ROWS + 1)
            .select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
            .agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size"))
            .first()
        )
    return _SIZES[df]


def fits_broadcast(df: DataFrame, times: int = 1) -> bool:
    """True if ``times`` copies of ``df`` are few enough rows and bytes.

    A frame is measured once; later calls with the same frame reuse the figures.
    """
    size = _bounded_size(df)
    return (
        size["rows"] * times <= BROADCAST_ROWS and size["size"] * times <= BROADCAST_BYTES
    )


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    bound: DataFrame | None = None,
    times: int = 1,
) -> DataFrame:
    """Join ``big`` with a side that is expected, but not known, to be small.

    ``spread`` names columns of ``big`` that vary within one join key; with them
    the shuffle form splits every key over ``SALTS`` tasks. The probe reads
    ``bound`` instead of ``small`` if computing ``small`` is costly; ``small`` has
    at most ``times`` rows per row of ``bound``.
    """
    if fits_broadcast(small if bound is None else bound, times):
        return big.join(F.broadcast(small), on, how)
    return shuffle_join(big, small, on, how, spread)


def shuffle_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
) -> DataFrame:
    """Join by shuffle; with ``spread`` the keys are salted by those columns."""
    if not spread:
        return big.join(small, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    copies = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    )
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def deal_by(df: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """``df`` dealt by ``key``, in parts whose number grows with the table it stems from.

    What is then grouped by ``key`` and other columns needs no further shuffle, and a
    task holds about as much on a large table as on a small one.
    """
    if shard_column(stored) is None:  # not a stored table: its size is not known
        return df.repartition(key)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, stored_bytes(stored) // TASK_BYTES + 1), key)


def stored_bytes(stored: DataFrame) -> int:
    """Bytes of the files that a scan of a stored table reads."""
    return int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
