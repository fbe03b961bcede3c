"""The jobs users run: conversations, evaluation set, index, scoring, audit, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.operators.agreement import agreement_of, pearson_of, score_pairs, spearman_of
from carewise.operators.audit import audit_items, audit_rollup
from carewise.operators.conversations import valid_unique_conversations
from carewise.operators.escalation import escalate
from carewise.operators.intent import (
    IntentModel,
    disjoint_training,
    keyword_baseline,
    label_conversations,
    random_baseline,
    taxonomy_table,
)
from carewise.operators.judge import CRITERIA, judge_means, judge_replies
from carewise.operators.metrics import accuracy, binary_prf, class_sums, compared, confusion_counts, macro_prf, weighted_prf
from carewise.operators.replies import ground_replies
from carewise.operators.retrieval import THRESHOLD, TOP_K, ConversationIndex, Retriever
from carewise.operators.sampling import balanced_sample, numbered, sample_n
from carewise.operators.tfidf import TfidfSettings
from carewise.operators.topics import discover_topics
from carewise.session import stored
from carewise.sources.tables import write_metrics

GOLDEN_SIZE = 200
GROUND_TRUTH = {
    "intent": "ground_truth_intent",
    "escalation": "ground_truth_escalation",
    "reply_keywords": "expected_reply_keywords",
}


class Classifier(Protocol):
    def classify(self, messages: DataFrame, key: str, text: str) -> DataFrame: ...


def build_conversations(
    tweets: DataFrame,
    brand_account: str,
    min_len: int = R.MIN_MESSAGE_LENGTH,
    target: int | None = None,
    seed: int = 42,
    id_prefix: str = "CONV",
) -> DataFrame:
    """Valid, unique conversations; with ``target``, a seeded sample with running ids."""
    conversations = valid_unique_conversations(tweets, brand_account, min_len)
    if target is None:
        return conversations
    sample = sample_n(conversations, target, "support_tweet_id", seed)
    return numbered(sample, f"{id_prefix}_%04d", "support_tweet_id", seed)


def build_golden(
    conversations: DataFrame,
    size: int = GOLDEN_SIZE,
    seed: int = 42,
    classes: Sequence[str] | None = None,
    id_prefix: str = "GOLDEN",
    brand: str = R.DEFAULT_BRAND,
) -> DataFrame:
    """Labelled, balanced evaluation records in shuffled order."""
    labelled = stored(label_conversations(conversations, brand=brand), "labelled")
    names = [i.name for i in R.taxonomy()] if classes is None else list(classes)
    drawn = balanced_sample(labelled, size, "intent", names, "conversation_id", seed)
    return numbered(drawn, f"{id_prefix}_%03d", "conversation_id", seed, "golden_id").select(
        F.col("golden_id").alias("conversation_id"),
        "customer_message",
        "intent",
        "escalation",
        "reply_keywords",
        "ground_truth_notes",
    )


def build_index(conversations: DataFrame, path: str | None = None, settings: TfidfSettings | None = None) -> ConversationIndex:
    """Fit the retrieval index; with ``path`` it is saved and read back."""
    index = ConversationIndex.fit(conversations, settings)
    if path is None:
        return index
    index.save(path)
    return ConversationIndex.load(conversations.sparkSession, path)


def score_messages(
    messages: DataFrame,
    model: Classifier,
    index: Retriever,
    key: str = "conversation_id",
    text: str = "customer_message",
    top_k: int = TOP_K,
    threshold: float = THRESHOLD,
    low_confidence: float = R.LOW_CONFIDENCE,
    limit: int | None = None,
    brand: str = R.DEFAULT_BRAND,
) -> DataFrame:
    """Intent, retrieval, escalation and grounded reply for every message.

    Columns intent, escalation and reply_keywords of the input, where present, are carried
    as the ground truth.
    """
    if limit:
        messages = messages.orderBy(key).limit(limit)
    truth = [F.col(old).alias(new) for old, new in GROUND_TRUTH.items() if old in messages.columns]
    asked = messages.select(F.col(key).alias("conversation_id"), F.col(text).alias("customer_message"), *truth)
    decided = escalate(model.classify(asked, "conversation_id", "customer_message"), low_confidence=low_confidence)
    hits = index.search(
        asked.select(F.col("conversation_id").alias("conversation_id_asked"), "customer_message"),
        "conversation_id_asked",
        "customer_message",
        top_k,
        threshold,
    )
    scored = ground_replies(decided, hits, "conversation_id", brand)
    carried = [c for c in scored.columns if c in GROUND_TRUTH.values()]
    return scored.select(
        "conversation_id",
        "customer_message",
        "predicted_intent",
        "intent_confidence",
        "escalation",
        "grounded_reply",
        "influenced_by",
        "grounding_rationale",
        "is_grounded",
        *carried,
    )


def audit_batch(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The acceptance report of scored records, over all or per group."""
    return audit_rollup(audit_items(scored, keep=by), by)


def export_taxonomy(
    conversations: DataFrame, path: str, intents: Sequence[R.Intent] | None = None, **topic_options
) -> None:
    """Write the taxonomy, the leading terms of the discovered clusters and a one-row summary."""
    rows = taxonomy_table(conversations.sparkSession, intents)
    write_metrics(rows, f"{path}/intents")
    write_metrics(discover_topics(conversations, **topic_options), f"{path}/clusters")
    summary = conversations.agg(F.count(F.lit(1)).alias("source_conversations"))
    total = len(R.taxonomy() if intents is None else intents)
    write_metrics(summary.select(F.lit(total).alias("total_intents"), "source_conversations"), f"{path}/meta")


@dataclass(frozen=True)
class TrainingResult:
    model: IntentModel
    metrics: DataFrame  # accuracy, macro_f1, train_size, test_size


def train_and_evaluate(
    labelled: DataFrame,
    evaluation: DataFrame,
    path: str | None = None,
    max_iter: int = 1000,
    brand: str = R.DEFAULT_BRAND,
    steps: int | None = None,
    optimum: bool = False,
) -> TrainingResult:
    """Train on what the evaluation set does not hold, then measure on it."""
    training = stored(disjoint_training(labelled, evaluation), "training")
    model = IntentModel.fit(training, max_iter=max_iter, brand=brand, steps=steps, optimum=optimum)
    if path is not None:
        model.save(path)
    predicted = model.classify(evaluation, "conversation_id", "customer_message")
    confusion = stored(confusion_counts(predicted, "intent", "predicted_intent"), "confusion")
    right = accuracy(confusion).select(
        F.round("accuracy", 4).alias("accuracy"), F.col("support").alias("test_size")
    )
    macro = macro_prf(confusion).agg(F.round(F.max("f1"), 4)).scalar()
    size = training.agg(F.count(F.lit(1))).scalar()
    return TrainingResult(model, right.select("accuracy", macro.alias("macro_f1"), size.alias("train_size"), "test_size"))


def _long(row: DataFrame, section: str, names: dict[str, str]) -> DataFrame:
    """Columns of a one-row table as (section, metric, value)."""
    pairs = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value")) for column, metric in names.items()
    ])
    return row.select(F.lit(section).alias("section"), F.inline(pairs))


def _named_predictions(scored: DataFrame, *others: Column, brand: str = R.DEFAULT_BRAND) -> DataFrame:
    """(model, truth, predicted) of the scored intents and of both baselines, and of ``others``."""
    named = random_baseline(
        keyword_baseline(scored.withColumn("_main", F.col("predicted_intent")), brand=brand).withColumnRenamed("predicted_intent", "_keyword"), "conversation_id"
    ).withColumnRenamed("predicted_intent", "_random")
    models = {"main_agent": "_main", "baseline_1_random": "_random", "baseline_2_keyword": "_keyword"}
    rows = [_prediction(model, "ground_truth_intent", F.col(column)) for model, column in models.items()]
    return named.select(F.inline(F.array(*rows, *others)))


def _prediction(model: str, truth: str, predicted: Column) -> Column:
    return F.struct(F.lit(model).alias("model"), F.col(truth).alias("truth"), predicted.alias("predicted"))


def baseline_predictions(scored: DataFrame) -> DataFrame:
    """(model, truth, predicted) of the scored intents and of both baselines, in one pass."""
    return _named_predictions(scored.select("conversation_id", "customer_message", "ground_truth_intent", "predicted_intent"))


def evaluate(
    scored: DataFrame, rated: DataFrame | None = None, first: str = "human_score", second: str = "judge_score", brand: str = R.DEFAULT_BRAND
) -> DataFrame:
    """All metrics as long rows (section, metric, value).

    ``rated`` holds two score columns of real raters; without it the agreement section is
    left out. The scored records are read twice, for all confusion tables and for the judge; all
    agreement comes from one table of score pairs.
    """
    policy = _prediction("escalation_policy", "ground_truth_escalation", F.col("decision"))
    columns = ["conversation_id", "customer_message", "ground_truth_intent", "predicted_intent", "ground_truth_escalation"]
    named = _named_predictions(scored.select(*columns, F.col("escalation.decision").alias("decision")), policy, brand=brand)
    tables = stored(confusion_counts(named, "truth", "predicted", ["model"]), "confusion")

    def of(model: str) -> DataFrame:
        return tables.filter(F.col("model") == model).drop("model")

    confusion, escalations = of("main_agent"), of("escalation_policy")
    judged = judge_replies(scored)

    def rounded(df: DataFrame, *names: str) -> DataFrame:
        return df.select(*[F.round(n, 4).alias(n) for n in names])

    parts = [
        _long(scored.agg(F.count(F.lit(1)).alias("n")), "dataset", {"n": "eval_size"}),
        _long(rounded(accuracy(confusion), "accuracy"), "main_agent", {"accuracy": "accuracy"}),
        _long(rounded(macro_prf(confusion), "precision", "recall", "f1"), "main_agent",
              {"precision": "macro_precision", "recall": "macro_recall", "f1": "macro_f1"}),
        _long(rounded(weighted_prf(confusion), "f1"), "main_agent", {"f1": "weighted_f1"}),
        _long(rounded(accuracy(escalations), "accuracy"), "escalation_policy", {"accuracy": "accuracy"}),
        _long(rounded(binary_prf(escalations), "precision", "recall", "f1"), "escalation_policy",
              {"precision": "precision_escalate", "recall": "recall_escalate", "f1": "f1_escalate"}),
        _long(judge_means(judged), "judge",
              {"average_overall_score": "average_overall_score", **{f"mean_{c}": c for c in CRITERIA}}),
    ]
    models = compared(class_sums(tables.filter(F.col("model").startswith("baseline")), ["model"]), "model")
    measures = F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
        F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")),
    )
    parts.append(models.select(F.col("model").alias("section"), F.inline(measures)))
    if rated is not None:
        pairs = stored(score_pairs(rated, first, second), "score-pairs")
        parts += [
            _long(agreement_of(pairs), "rater_agreement", {
                "sample_size": "sample_size",
                "agreement_percentage": "agreement_pct_within_0_5",
                "mean_absolute_difference": "mean_abs_difference",
            }),
            _long(pearson_of(pairs), "rater_agreement", {"pearson": "pearson_correlation"}),
            _long(spearman_of(pairs), "rater_agreement", {"spearman": "spearman_correlation"}),
        ]
    return reduce(DataFrame.unionByName, parts)
