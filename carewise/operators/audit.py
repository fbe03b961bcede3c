"""Independent audit of scored records by its own rule set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.functions.cascade import first_match, found
from carewise.functions.text import fixed, strip_spaces

DEFAULT_AUDIT_CONFIDENCE = 0.8


def review(status: str, reason: Column | str, tenths: int) -> Column:
    """One review; scores are whole tenths so that sums of them are exact."""
    return F.struct(
        F.lit(status).alias("status"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        F.lit(tenths).alias("tenths"),
    )


def intent_review(lowered: Column, intent: Column, confidence: Column, intents: Sequence[str] | None = None) -> Column:
    known = [i.name for i in R.taxonomy()] if intents is None else list(intents)
    return first_match(
        [
            (~intent.isin(*known), review(R.FAIL, F.format_string(R.AUDIT_UNLISTED, intent), 0)),
            (found(lowered, R.AUDIT_SAFETY) & (intent != R.SAFETY),
             review(R.FAIL, F.format_string(R.AUDIT_MISSED_SAFETY, intent), 20)),
            (found(lowered, R.AUDIT_DISPUTE) & ~intent.isin(*R.BILLING_INTENTS),
             review(R.WARNING, F.format_string(R.AUDIT_MISSED_DISPUTE, intent), 60)),
            (confidence < R.AUDIT_LOW_CONFIDENCE,
             review(R.WARNING, F.format_string(R.AUDIT_UNSURE, fixed(confidence, 2)), 65)),
        ],
        review(R.PASS, R.AUDIT_INTENT_OK, 100),
    )


def escalation_review(lowered: Column, intent: Column, decision: Column) -> Column:
    escalated = F.upper(F.coalesce(decision, F.lit(""))) == R.ESCALATE
    safety = (intent == R.SAFETY) | found(lowered, R.AUDIT_SAFETY)
    billing = intent.isin(*R.BILLING_INTENTS) | found(lowered, R.AUDIT_BILLING)
    needless = intent.isin(R.LOST, R.PICKUP) & escalated & ~safety & ~billing
    return first_match(
        [
            (~escalated & safety, review(R.FAIL, R.AUDIT_SAFETY_NOT_ESCALATED, 0)),
            (~escalated & billing, review(R.FAIL, R.AUDIT_BILLING_NOT_ESCALATED, 30)),
            (needless, review(R.WARNING, F.format_string(R.AUDIT_NEEDLESS_ESCALATION, intent), 75)),
        ],
        review(R.PASS, R.AUDIT_ESCALATION_OK, 100),
    )


def grounding_review(reply: Column, citations: Column) -> Column:
    lowered = F.lower(reply)
    return first_match(
        [
            (F.char_length(strip_spaces(reply)) < R.AUDIT_SHORT_REPLY, review(R.FAIL, R.AUDIT_NO_REPLY, 0)),
            (found(lowered, R.AUDIT_BANNED), review(R.FAIL, R.AUDIT_PROMISE, 10)),
            (~found(lowered, R.AUDIT_HELPFUL), review(R.WARNING, R.AUDIT_TONE, 60)),
            (F.coalesce(F.size(citations), F.lit(0)) <= 0, review(R.WARNING, R.AUDIT_NO_CITATION, 65)),
        ],
        review(R.PASS, R.AUDIT_GROUNDING_OK, 100),
    )


def audit_items(scored: DataFrame, keep: Sequence[str] = (), intents: Sequence[str] | None = None) -> DataFrame:
    """Verdict, score and the three reviews per record, missing fields taking their defaults.

    item_score is .35 / .35 / .30 of the reviews, computed in whole hundredths (half up).
    """
    texts = (
        scored.withColumn("_low", F.lower(F.coalesce(F.col("customer_message"), F.lit(""))))
        .withColumn("_intent", F.coalesce(F.col("predicted_intent"), F.lit("")))
        .withColumn("_reply", F.coalesce(F.col("grounded_reply"), F.lit("")))
        .withColumn("_sure", F.coalesce(F.col("intent_confidence"), F.lit(DEFAULT_AUDIT_CONFIDENCE)))
    )
    reviewed = (
        texts.withColumn("_i", intent_review(F.col("_low"), F.col("_intent"), F.col("_sure"), intents))
        .withColumn("_e", escalation_review(F.col("_low"), F.col("_intent"), F.col("escalation.decision")))
        .withColumn("_g", grounding_review(F.col("_reply"), F.col("influenced_by")))
    )
    statuses = [F.col(f"{name}.status") for name in ("_i", "_e", "_g")]
    thousandths = F.col("_i.tenths") * 35 + F.col("_e.tenths") * 35 + F.col("_g.tenths") * 30
    hundredths = F.floor((thousandths + 5) / 10).cast("int")

    def any_is(status: str) -> Column:
        return (statuses[0] == status) | (statuses[1] == status) | (statuses[2] == status)

    def shown(name: str) -> Column:
        return F.struct(F.col(f"{name}.status").alias("status"), F.col(f"{name}.reason").alias("reason"))

    return reviewed.select(
        F.coalesce(F.col("conversation_id").cast("string"), F.lit("UNKNOWN")).alias("conversation_id"),
        first_match([(any_is(R.FAIL), F.lit(R.FAIL)), (any_is(R.WARNING), F.lit(R.WARNING))], F.lit(R.PASS)).alias("item_verdict"),
        (hundredths / 100.0).alias("item_score"),
        shown("_i").alias("intent_review"),
        shown("_e").alias("escalation_review"),
        shown("_g").alias("grounding_review"),
        *keep,
    )


def _status(failures: Column, total: Column, percent: int) -> Column:
    return F.when(failures * 100 > total * percent, R.FAIL).when(failures > 0, R.WARNING).otherwise(R.PASS)


def rollup_columns(verdict: Column, score: Column, intent: Column, escalation: Column, grounding: Column) -> list[Column]:
    """Conditional counts of one batch; scores are summed as whole hundredths."""
    def failed(status: Column) -> Column:
        return F.count(F.when(status == R.FAIL, 1))

    return [
        F.count(F.lit(1)).alias("total_reviewed"),
        F.sum(F.round(score * 100).cast("long")).alias("_hundredths"),
        failed(verdict).alias("discrepancies"),
        failed(intent).alias("intent_failures"),
        failed(escalation).alias("escalation_failures"),
        failed(grounding).alias("grounding_failures"),
    ]


def report_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The acceptance report from the counts of ``rollup_columns``."""
    total = F.col("total_reviewed")
    tenths = F.floor((F.col("_hundredths") * 2 + total * 10) / (total * 20)).cast("long")
    approved = (F.col("_tenths") >= 85) & (F.col("discrepancies") * 100 <= total * 5)
    return counts.withColumn("_tenths", tenths).select(
        *by,
        F.when(approved, "APPROVED").otherwise("FLAGGED").alias("audit_status"),
        _status(F.col("intent_failures"), total, 10).alias("intent_review"),
        _status(F.col("grounding_failures"), total, 5).alias("grounding_review"),
        _status(F.col("escalation_failures"), total, 5).alias("escalation_review"),
        (F.col("_tenths") / 10.0).alias("overall_score"),
        "discrepancies",
        "total_reviewed",
        F.when(approved, R.AUDIT_APPROVED_NOTE)
        .otherwise(F.format_string(R.AUDIT_FLAGGED_NOTE, F.col("discrepancies")))
        .alias("reviewer_notes"),
        "intent_failures",
        "escalation_failures",
        "grounding_failures",
    )


def audit_rollup(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report over all items, or one per group. A group without items has no row;
    an empty batch as a whole is an error."""
    counts = items.groupBy(*by).agg(*rollup_columns(
        F.col("item_verdict"),
        F.col("item_score"),
        F.col("intent_review.status"),
        F.col("escalation_review.status"),
        F.col("grounding_review.status"),
    ))
    if not by:
        counts = counts.filter(F.when(F.col("total_reviewed") > 0, True).otherwise(F.raise_error(F.lit("empty review batch")).cast("boolean")))
    return report_of(counts, by)


def sample_audits(items: DataFrame, n: int = 5) -> DataFrame:
    """The first items by id, as the report's sample."""
    return items.orderBy("conversation_id").limit(n)
