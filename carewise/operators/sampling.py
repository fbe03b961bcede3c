"""Seeded samples of exact size, the same under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.functions.text import seeded_order

# Digits of the hash that one pass counts, and rows whose order is looked at one by one.
DIGITS = 3
LAST_ROWS = 1_000


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, last_rows: int = LAST_ROWS) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) in the seeded order of the unique ``key``.

    Counts per leading digits of the hash lead to the last key of the sample, so the sample is a
    filter: no row is shuffled, and only keys of the last few hundred rows are sorted.
    """
    ordered = df.withColumn("_order", seeded_order(F.col(key), seed))
    keys = ordered.select("_order", F.col(key).alias("_key"))
    prefix, wanted = "", n
    while True:
        head = F.substring("_order", 1, len(prefix) + DIGITS)
        inside = keys.filter(F.col("_order").startswith(prefix)) if prefix else keys
        counts = sorted(inside.groupBy(head.alias("head")).count().collect())  # at most 16 ** DIGITS rows
        for row in counts:
            if row["count"] >= wanted:
                break
            wanted -= row["count"]
        else:
            return df
        prefix = row["head"]
        if row["count"] <= last_rows or len(prefix) > 32 - DIGITS:
            break
    if wanted <= 0:
        return df.limit(0)
    last = keys.filter(F.col("_order").startswith(prefix)).orderBy("_order", "_key").limit(wanted)
    bound = last.agg(F.max(F.struct("_order", "_key")).alias("b")).first()["b"]
    within = (F.col("_order") < bound["_order"]) | ((F.col("_order") == bound["_order"]) & (F.col(key) <= F.lit(bound["_key"])))
    return ordered.filter(within).drop("_order")


def quotas(size: int, classes: Sequence[str]) -> dict[str, int]:
    """An even share per class; the first classes get one more when it does not divide."""
    share, extra = divmod(size, len(classes))
    return {name: share + (1 if i < extra else 0) for i, name in enumerate(classes)}


def stratified_sample(
    df: DataFrame, size: int, stratum: str, classes: Sequence[str], key: str, seed: int = 42
) -> DataFrame:
    """The quota of every class in seeded order; a short class gives all its rows.

    The literal bound lets Spark cut each class to the largest quota before the shuffle.
    """
    share = quotas(size, classes)
    allowed: Column = F.lit(0)
    for name, quota in share.items():
        allowed = F.when(F.col(stratum) == name, F.lit(quota)).otherwise(allowed)
    order = W.partitionBy(stratum).orderBy("_order", key)
    return (
        df.withColumn("_order", seeded_order(F.col(key), seed))
        .withColumn("_n", F.row_number().over(order))
        .filter((F.col("_n") <= max(share.values())) & (F.col("_n") <= allowed))
        .drop("_order", "_n")
    )


def balanced_sample(
    df: DataFrame, size: int, stratum: str, classes: Sequence[str], key: str, seed: int = 42
) -> DataFrame:
    """A stratified sample, topped up from the rows not taken until ``size`` is reached."""
    drawn = stratified_sample(df, size, stratum, classes, key, seed)
    pool = df.join(drawn.select(key), key, "left_anti")
    return drawn.unionByName(sample_n(pool, size - drawn.count(), key, seed).select(*drawn.columns))


def numbered(sample: DataFrame, pattern: str, key: str, seed: int = 42, name: str = "conversation_id") -> DataFrame:
    """Shuffle a sample and number its rows by ``pattern``, such as ``GOLDEN_%03d``.

    Rows are counted per leading digits of their hash; a number is a row's place among those of
    the same digits, behind all rows of smaller ones, so no task orders the whole sample.
    """
    ordered = sample.withColumn("_order", seeded_order(F.col(key), seed + 1)).withColumn("_head", F.substring("_order", 1, 2))
    counts = ordered.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_head", (F.sum("_n").over(W.orderBy("_head")) - F.col("_n")).alias("_before"))  # 256 rows
    place = F.row_number().over(W.partitionBy("_head").orderBy("_order", key))
    numbers = ordered.withColumn("_place", place).join(F.broadcast(before), "_head")
    number = (F.col("_before") + F.col("_place")).cast("int")
    return numbers.withColumn(name, F.format_string(pattern, number)).drop("_order", "_head", "_place", "_before")
