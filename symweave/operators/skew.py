"""Helpers for keys that own a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many of the most frequent keys are salted. Any key with more than 1/(HOT+1) of the rows is among
#: them; salting a key that is not hot costs a few copies of its partner rows and nothing else.
HOT = 64
#: Parts that a hot key is split into.
SALTS = 32


def key_hash(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a composite key, to shuffle 16 bytes instead of strings.

    The length of each part takes part in the hash, so that moving a character from one part to the
    next changes it. Nulls hash to a value of their own; leave them out beforehand where they are no key.
    """
    sized = [x for c in cols for x in (c, F.length(c))]
    return F.xxhash64(*sized), F.xxhash64(F.lit(7919), *reversed(sized))


def hot_values(df: DataFrame, col: str, most: int = HOT) -> list[int]:
    """The most frequent values of a BIGINT column, at most ``most`` of them; ties break by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), col).limit(most).where("n > 1")
    return [r[0] for r in top.collect()]


def salt_many(key: Column, spread: Column, hot: list[int], salts: int = SALTS) -> Column:
    """The salt of a row of the large side: a hot key's rows spread over ``salts`` values."""
    if not hot:
        return F.lit(0)
    return F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def salt_all(key: Column, hot: list[int], salts: int = SALTS) -> Column:
    """All salts of a row of the small side, to be exploded."""
    if not hot:
        return F.array(F.lit(0))
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))


def top_of(df: DataFrame, key: list[str], order: list[Column], most: int, spread: str, name: str = "n") -> DataFrame:
    """The first ``most`` rows of each key in an order, numbered in ``name``.

    Chosen within hashed parts of a key first, then among the parts' firsts, so that no task sorts all rows of a frequent key.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(64))
    first = df.withColumn(name, F.row_number().over(Window.partitionBy(*key, part).orderBy(*order))).where(F.col(name) <= most)
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= most)


def joined(many: DataFrame, few: DataFrame, on: list[str], spread: str, how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """Join (inner, or ``left`` keeping the rows of ``many``) in which a frequent value of the first key does not meet in one task.

    The most frequent values of ``many`` (counted here unless given) are split by ``spread``, and the rows of
    ``few`` with them are repeated.
    """
    hot = hot_values(many, on[0]) if hot is None else hot
    if not hot:
        return many.join(few, on, how)
    a = many.withColumn("_salt", salt_many(F.col(on[0]), F.col(spread), hot))
    b = few.withColumn("_salt", F.explode(salt_all(F.col(on[0]), hot)))
    return a.join(b, [*on, "_salt"], how).drop("_salt")
