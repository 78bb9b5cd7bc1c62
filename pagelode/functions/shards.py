"""Hash directories of stored tables.

A stored table carries its shard number in a partition column whose name tells the
number of shards, ``shard_64``. A join that also matches this column lets Spark
prune directories at run time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Seed of Spark's xxhash64; XXH64 of a text's UTF-8 bytes with it is the same number.
HASH_SEED = 42


def shard_number(key: Column | str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def add_shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumn(f"shard_{shards}", shard_number(key, shards))


def shard_column(df: DataFrame) -> str | None:
    """Name of the shard column of a stored table, None for other frames."""
    names = [c for c in df.columns if re.fullmatch(r"shard_\d+", c)]
    return names[0] if names else None


def align_shards(stored: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, list]:
    """``other`` with the shard column of ``stored``, and the columns to join on."""
    name = shard_column(stored)
    if name is None:
        return other, []
    return add_shard(other, key, int(name.split("_")[1])), [name]
