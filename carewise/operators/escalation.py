"""Escalation policy: hand over to a person or answer automatically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.functions.cascade import first_match, found
from carewise.functions.text import fixed


def decision(what: str, reason: Column | str, confidence: float) -> Column:
    return F.struct(
        F.lit(what).alias("decision"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        F.lit(confidence).alias("confidence"),
    )


def escalation_of(lowered: Column, intent: Column, confidence: Column, low_confidence: float = R.LOW_CONFIDENCE) -> Column:
    """The decision struct; an intent or a pattern can trigger each of the first four arms."""
    low_reason = F.format_string(R.REASON_LOW_CONFIDENCE, fixed(confidence, 2))
    return first_match(
        [
            ((intent == R.SAFETY) | found(lowered, R.ESCALATION_SAFETY), decision(R.ESCALATE, R.REASON_SAFETY, 0.98)),
            (intent.isin(*R.BILLING_INTENTS) | found(lowered, R.ESCALATION_BILLING),
             decision(R.ESCALATE, R.REASON_BILLING, 0.94)),
            ((intent == R.ACCOUNT) | found(lowered, R.ESCALATION_ACCOUNT),
             decision(R.ESCALATE, R.REASON_ACCOUNT, 0.92)),
            ((intent == R.DRIVER) | found(lowered, R.ESCALATION_CONDUCT),
             decision(R.ESCALATE, R.REASON_CONDUCT, 0.89)),
            (confidence < low_confidence, decision(R.ESCALATE, low_reason, 0.75)),
            (intent == R.PICKUP, decision(R.AUTO_HANDLE, R.REASON_PICKUP, 0.92)),
            (intent == R.LOST, decision(R.AUTO_HANDLE, R.REASON_LOST, 0.93)),
            (intent.isin(*R.ROUTINE_INTENTS), decision(R.AUTO_HANDLE, R.REASON_ROUTINE, 0.88)),
        ],
        decision(R.AUTO_HANDLE, R.REASON_OTHER, 0.80),
    )


def escalate(
    classified: DataFrame,
    message: str = "customer_message",
    intent: str = "predicted_intent",
    confidence: str = "intent_confidence",
    low_confidence: float = R.LOW_CONFIDENCE,
) -> DataFrame:
    """Add the ``escalation`` struct (decision, reason, confidence)."""
    chain = escalation_of(F.col("_low"), F.coalesce(F.col(intent), F.lit("")), F.col(confidence), low_confidence)
    return (
        classified.withColumn("_low", F.lower(F.coalesce(F.col(message), F.lit(""))))
        .withColumn("escalation", chain)
        .drop("_low")
    )
