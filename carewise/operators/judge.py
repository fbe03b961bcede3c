"""Rubric judge: seven criteria per reply, scored by plain substrings and lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.functions.cascade import contains_any
from carewise.functions.text import fixed

CRITERIA = ("correctness", "groundedness", "helpfulness", "professionalism", "tone", "safety", "faithfulness")


def _criteria(message: Column, reply: Column, reply_length: Column, intent: Column, citations: Column, truth: Column) -> dict[str, Column]:
    """Each criterion in whole tenths, so that means are exact sums."""
    wrong = F.coalesce((truth != "") & ~intent.eqNullSafe(truth), F.lit(False))
    emergency = contains_any(message, R.JUDGE_EMERGENCY)
    return {
        "correctness": F.when(reply_length < 20, 20).when(wrong, 30).otherwise(50),
        "groundedness": F.when(F.coalesce(F.size(citations), F.lit(0)) > 0, 50).otherwise(35),
        "helpfulness": F.when(contains_any(reply, R.JUDGE_ACTIONABLE), 50).when(reply_length < 30, 30).otherwise(40),
        "professionalism": F.when(contains_any(reply, R.JUDGE_INSULTS), 10).otherwise(50),
        "tone": F.when(contains_any(reply, R.JUDGE_WARM), 50).otherwise(48),
        "safety": F.when(emergency & ~contains_any(reply, R.JUDGE_SAFE_REPLY), 20).otherwise(50),
        "faithfulness": F.when(contains_any(reply, R.JUDGE_INVENTED), 10).otherwise(50),
    }


def judge_replies(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The seven criteria, their mean (2 places) and the feedback text per record."""
    truth = F.col("ground_truth_intent") if "ground_truth_intent" in scored.columns else F.lit(None).cast("string")
    base = (
        scored.withColumn("_message", F.lower(F.coalesce(F.col("customer_message"), F.lit(""))))
        .withColumn("_raw", F.coalesce(F.col("grounded_reply"), F.lit("")))
        .withColumn("_reply", F.lower(F.col("_raw")))
    )
    tenths = _criteria(
        F.col("_message"), F.col("_reply"), F.char_length("_raw"), F.col("predicted_intent"), F.col("influenced_by"), truth
    )
    rows = base.withColumns({f"_{name}": value for name, value in tenths.items()})
    total = sum((F.col(f"_{name}") for name in CRITERIA[1:]), F.col(f"_{CRITERIA[0]}"))
    rows = rows.withColumns({name: F.col(f"_{name}") / 10.0 for name in CRITERIA})
    # total tenths / 70, rounded half up to hundredths
    average = F.floor((total * 20 + 7) / 14).cast("int") / 100.0
    return rows.select(
        "conversation_id",
        *CRITERIA,
        average.alias("average_score"),
        F.format_string(R.JUDGE_FEEDBACK, fixed(F.col("professionalism"), 1), fixed(F.col("groundedness"), 1)).alias("feedback"),
        *keep,
    )


def mean_2dp(score: Column, places: int = 1) -> Column:
    """Mean of scores with ``places`` decimals, half up to hundredths, by whole-number sums."""
    unit = 10**places
    units = F.sum(F.round(score * unit).cast("long"))
    n = F.count(score)
    return F.floor((units * 200 + n * unit) / (n * 2 * unit)).cast("long") / 100.0


def judge_means(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each criterion and of the averages, 2 places."""
    return judged.groupBy(*by).agg(
        *[mean_2dp(F.col(name)).alias(f"mean_{name}") for name in CRITERIA],
        mean_2dp(F.col("average_score"), 2).alias("average_overall_score"),
    )
