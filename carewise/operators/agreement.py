"""Agreement of two raters: differences, Pearson and Spearman correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.functions.text import snippet
from carewise.session import stored

# Distinct values that one task ranks.
RANGE_VALUES = 100_000
# Means and moments take scores with this many decimals and add them as decimals, so that sums are
# exact; scores have to stay below 1e8. Ranks are those of the scores as they are.
PLACES = 4
COMPARISON_SNIPPET = 75


def comparisons(rated: DataFrame, first: str, second: str) -> DataFrame:
    """The rated records side by side, texts shortened."""
    return rated.select(
        "conversation_id",
        snippet(F.col("customer_message"), COMPARISON_SNIPPET).alias("customer_message"),
        snippet(F.col("grounded_reply"), COMPARISON_SNIPPET).alias("grounded_reply"),
        first,
        second,
        F.round(F.abs(F.col(first) - F.col(second)), 2).alias("absolute_diff"),
    )


def _exact(score: str) -> Column:
    return F.round(score, PLACES).cast(f"decimal(12,{PLACES})")


def score_pairs(rated: DataFrame, first: str, second: str) -> DataFrame:
    """(x, y, n): how many records have each pair of scores. All agreement follows from this table."""
    known = rated.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    return known.groupBy(F.col(first).cast("double").alias("x"), F.col(second).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _times(value: Column) -> Column:
    """The sum over all records of a value of their pair, exact."""
    return F.sum(value * F.col("n").cast("decimal(12,0)")).cast("double")


def agreement_of(pairs: DataFrame, close: float = 0.5) -> DataFrame:
    """Sample size, both means, mean absolute difference and the share within ``close``."""
    x, y, size = _exact("x"), _exact("y"), F.sum("n")
    gap = F.abs(x - y)
    return pairs.agg(
        F.coalesce(size, F.lit(0)).alias("sample_size"),
        F.round(F.try_divide(_times(x), size), 2).alias("mean_first"),
        F.round(F.try_divide(_times(y), size), 2).alias("mean_second"),
        F.round(F.try_divide(_times(gap), size), 3).alias("mean_absolute_difference"),
        F.round(F.try_divide(F.sum(F.when(gap <= close, F.col("n")).otherwise(0)), size) * 100.0, 1).alias("agreement_percentage"),
    )


def rater_agreement(rated: DataFrame, first: str, second: str, close: float = 0.5) -> DataFrame:
    return agreement_of(score_pairs(rated, first, second), close)


def pearson_of(pairs: DataFrame) -> DataFrame:
    """Pearson correlation, 3 places; null when a column is constant."""
    x, y, size = _exact("x"), _exact("y"), F.sum("n")
    both, xx, yy = (_times(v) - _times(a) * _times(b) / size for v, a, b in ((x * y, x, y), (x * x, x, x), (y * y, y, y)))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return pairs.agg(
        F.round(F.when(varies, F.try_divide(both, F.sqrt(xx) * F.sqrt(yy))), 3).alias("pearson"),
        F.coalesce(size, F.lit(0)).alias("sample_size"),
    )


def pearson(rated: DataFrame, first: str, second: str) -> DataFrame:
    return pearson_of(score_pairs(rated, first, second))


def average_ranks(counts: DataFrame, value: str) -> DataFrame:
    """(value, rank): the mean rank of the tied rows, from (value, n) with one row per value.

    Running counts go over ranges of values cut at approximate quantiles, plus the totals of
    the ranges before, so no task orders the whole table. The cuts need not be exact.
    """
    ranges = -(-counts.count() // RANGE_VALUES)
    steps = [i / ranges for i in range(1, ranges)]
    cuts = counts.agg(F.percentile_approx(value, steps, 1000).alias("cuts")).first()["cuts"] if steps else []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    ranged = counts.withColumn("_range", F.size(F.filter(bounds, lambda c: c <= F.col(value))))
    totals = ranged.groupBy("_range").agg(F.sum("n").alias("_total"))
    before = totals.select(
        "_range",
        (F.sum("_total").over(W.orderBy("_range")) - F.col("_total")).alias("_before"),  # a row per range
    )
    inside = F.sum("n").over(W.partitionBy("_range").orderBy(value)) - F.col("n")
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(
        value, (F.col("_before") + F.col("_inside") + (F.col("n") + 1) / 2.0).alias("rank")
    )


def spearman_of(pairs: DataFrame) -> DataFrame:
    """Spearman correlation, 3 places; null when a column is constant.

    ``pairs`` is a stored table of counts, so a frequent value is one row. Both mean ranks are
    (rows + 1) / 2, which leaves plain sums of products of deviations.
    """
    def ranks(name: str) -> DataFrame:
        counts = pairs.groupBy(name).agg(F.sum("n").alias("n"))
        return average_ranks(counts, name).withColumnRenamed("rank", f"rank_{name}")

    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    ranked = pairs.join(ranks("x"), "x").join(ranks("y"), "y")
    middle = (total + 1) / 2.0
    dx, dy = F.col("rank_x") - middle, F.col("rank_y") - middle
    sums = ranked.agg(
        F.sum(F.col("n") * dx * dy).alias("xy"),
        F.sum(F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("n") * dy * dy).alias("yy"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_size"),
    )
    varies = (F.col("xx") > 0) & (F.col("yy") > 0)
    return sums.select(
        F.when(varies, F.round(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")), 3)).alias("spearman"),
        "sample_size",
    )


def spearman(rated: DataFrame, first: str, second: str) -> DataFrame:
    return spearman_of(stored(score_pairs(rated, first, second), "score-pairs"))
