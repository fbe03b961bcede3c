"""Scoring and auditing a stream of messages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carewise.operators.audit import audit_items
from carewise.operators.retrieval import ConversationIndex, Retriever
from carewise.plans.jobs import Classifier, score_messages

SCORED_COLUMNS = (
    "customer_message",
    "predicted_intent",
    "intent_confidence",
    "escalation",
    "grounded_reply",
    "influenced_by",
    "grounding_rationale",
    "is_grounded",
)


def score_and_audit(messages: DataFrame, model: Classifier, index: Retriever, **options) -> DataFrame:
    """Scored records with their audit, one row per message; what each micro-batch runs."""
    scored = score_messages(messages, model, index, **options)
    return audit_items(scored, keep=SCORED_COLUMNS)


def start_scoring(
    messages: DataFrame,
    model: Classifier,
    index: Retriever,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Score every micro-batch and write it under ``path``.

    Top-k needs a window over a query's hits, which a stateless stream lacks, so batches are
    scored whole. A batch overwrites its own folder: after a restart it is written again, not twice.
    Batches follow one another, so the tables of a search are replaced by those of the next.
    """
    if isinstance(index, ConversationIndex):
        index = replace(index.laid_out(), scratch=f"{checkpoint.rstrip('/')}-scratch")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # classified and searched
        try:
            score_and_audit(batch, model, index, **options).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_scored_stream(spark, path: str) -> DataFrame:
    """All batches written so far."""
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
