"""Reply selection with the conversations that support it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.functions.cascade import first_match
from carewise.functions.text import end_sentence, fixed, snippet, strip_spaces

EMPTY_CITATIONS = "array<struct<conversation_id:string,similarity_score:double,historical_snippet:string>>"


def hits_per_query(hits: DataFrame, key: str) -> DataFrame:
    """One row per query with its hits in rank order; a query has top-k hits at most."""
    hit = F.struct("rank", F.col("conversation_id").alias("hit_id"), "similarity_score", "support_reply")
    return hits.groupBy(key).agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def influenced_by(hits: Column) -> Column:
    """Citations in rank order: id, score and a snippet of the historical reply."""
    return F.coalesce(
        F.transform(
            hits,
            lambda hit: F.struct(
                hit["hit_id"].cast("string").alias("conversation_id"),
                hit["similarity_score"].alias("similarity_score"),
                snippet(hit["support_reply"]).alias("historical_snippet"),
            ),
        ),
        F.array().cast(EMPTY_CITATIONS),
    )


def _rationale(text: str, best: Column, brand: str) -> Column:
    """One fixed rationale with the best hit's id and score filled in."""
    score = F.coalesce(best["similarity_score"], F.lit(0.0))
    return F.format_string(
        R.for_brand(text, brand), best["hit_id"].cast("string"), fixed(score, 2), fixed(score, 4)
    )


def reply_of(intent: Column, decision: Column, hits: Column, brand: str = R.DEFAULT_BRAND) -> Column:
    """Struct of reply and rationale; without hits a fixed fallback, a null decision means AUTO_HANDLE."""
    best = F.try_element_at(hits, F.lit(1))
    adapted = end_sentence(strip_spaces(F.coalesce(best["support_reply"], F.lit(""))))

    def arm(reply: Column | str, rationale: str) -> Column:
        text = F.lit(R.for_brand(reply, brand)) if isinstance(reply, str) else reply
        return F.struct(text.alias("reply"), _rationale(rationale, best, brand).alias("rationale"))

    no_evidence = F.struct(
        F.lit(R.REPLY_NO_EVIDENCE).alias("reply"), F.lit(R.for_brand(R.RATIONALE_NO_EVIDENCE, brand)).alias("rationale")
    )
    escalated = F.coalesce(decision == R.ESCALATE, F.lit(False))
    handed_over = first_match(
        [
            (intent == R.SAFETY, arm(R.REPLY_SAFETY, R.RATIONALE_SAFETY)),
            (intent.isin(*R.BILLING_INTENTS), arm(R.REPLY_BILLING, R.RATIONALE_BILLING)),
            (intent == R.ACCOUNT, arm(R.REPLY_ACCOUNT, R.RATIONALE_ACCOUNT)),
        ],
        arm(R.REPLY_ESCALATED, R.RATIONALE_ESCALATED),
    )
    automatic = first_match(
        [
            (intent == R.PICKUP, arm(R.REPLY_PICKUP, R.RATIONALE_PICKUP)),
            (intent == R.LOST, arm(R.REPLY_LOST, R.RATIONALE_LOST)),
            (intent == R.PAYMENT, arm(R.REPLY_PAYMENT, R.RATIONALE_PAYMENT)),
            (intent == R.APP, arm(R.REPLY_APP, R.RATIONALE_APP)),
        ],
        arm(adapted, R.RATIONALE_ADAPTED),
    )
    nothing = F.coalesce(F.size(hits), F.lit(0)) <= 0
    return first_match([(nothing, no_evidence), (escalated, handed_over)], automatic)


def ground_replies(decided: DataFrame, hits: DataFrame, key: str = "conversation_id", brand: str = R.DEFAULT_BRAND) -> DataFrame:
    """Add grounded_reply, influenced_by, grounding_rationale and is_grounded.

    ``decided`` holds predicted_intent and the escalation struct; ``hits`` is a search
    result whose query key column is named ``key`` + '_asked'.
    """
    asked = f"{key}_asked"
    per_query = hits_per_query(hits, asked).withColumnRenamed(asked, key)
    rows = decided.join(per_query, key, "left").withColumn(
        "_reply", reply_of(F.coalesce(F.col("predicted_intent"), F.lit("")), F.col("escalation.decision"), F.col("hits"), brand)
    )
    return rows.select(
        *decided.columns,
        F.col("_reply.reply").alias("grounded_reply"),
        influenced_by(F.col("hits")).alias("influenced_by"),
        F.col("_reply.rationale").alias("grounding_rationale"),
        (F.coalesce(F.size("hits"), F.lit(0)) > 0).alias("is_grounded"),
    )
