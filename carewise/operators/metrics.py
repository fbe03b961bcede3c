"""Classification metrics, all derived from one confusion table, and failure cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.session import filter_computed


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label")


def confusion_counts(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., truth, predicted, n): at most labels squared rows; rows without a truth are left out.

    A missing prediction stays as null: it counts for the support of its truth and is a miss.
    """
    known = df.filter(F.col(truth).isNotNull())
    return known.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return confusion.groupBy(*by).agg(
        F.try_divide(right, F.sum("n")).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("support")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))


def class_sums(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, calls, hits and the ratios of every label that is a truth or a prediction.

    Each cell counts once for its truth and once for its prediction, so no join is needed.
    """
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), none.alias("called"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), none.alias("support"), F.col("n").alias("called"), none.alias("hits")),
    )
    sums = (
        confusion.select(*by, F.inline(sides))
        .filter(F.col("label").isNotNull())
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    )
    return (
        sums.withColumn("precision", _ratio(F.col("hits"), F.col("called")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def per_class(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label."""
    return class_sums(confusion, by).select(*by, "label", "precision", "recall", "f1", "support")


def macro_prf(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain means over the labels."""
    return per_class(confusion, by).groupBy(*by).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("support"),
    )


def weighted_prf(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means weighted by truth support."""
    def weighted(name: str) -> Column:
        return F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(name)

    return per_class(confusion, by).groupBy(*by).agg(
        weighted("precision"), weighted("recall"), weighted("f1"), F.coalesce(F.sum("support"), F.lit(0)).alias("support")
    )


def binary_prf(confusion: DataFrame, positive: str = R.ESCALATE, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of one label."""
    n = F.col("n")
    true, called = F.col("truth") == positive, F.col("predicted") == positive
    sums = confusion.groupBy(*by).agg(
        F.sum(F.when(true & called, n).otherwise(0)).alias("hits"),
        F.sum(F.when(called, n).otherwise(0)).alias("called"),
        F.sum(F.when(true, n).otherwise(0)).alias("support"),
    )
    return (
        sums.withColumn("precision", _ratio(F.col("hits"), F.col("called")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
        .select(*by, "precision", "recall", "f1", "support")
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """One row per label, then 'accuracy', 'macro avg' and 'weighted avg'."""
    right = accuracy(confusion).select(
        F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"),
        F.col("accuracy").alias("f1"), "support",
    )
    macro = macro_prf(confusion).withColumn("label", F.lit("macro avg"))
    weighted = weighted_prf(confusion).withColumn("label", F.lit("weighted avg"))
    return per_class(confusion).unionByName(right).unionByName(macro).unionByName(weighted)


def confusion_matrix(confusion: DataFrame) -> DataFrame:
    """The full label grid with zeros; truth and predicted range over the same sorted labels.

    A missing prediction has no column, so a row's sum may be below the support of its truth.
    """
    both = F.array_union(F.collect_set("truth"), F.collect_set("predicted"))
    labels = confusion.agg(F.sort_array(both).alias("labels"))
    grid = labels.select("labels", F.explode("labels").alias("truth")).select(
        "truth", F.explode("labels").alias("predicted")
    )
    return grid.join(confusion, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce(F.col("n"), F.lit(0)).alias("n")
    )


def compare_models(predictions: DataFrame, model: str, truth: str, predicted: str) -> DataFrame:
    """Accuracy and macro F1 per model, 4 places, for long (model, truth, predicted) rows."""
    return compared(class_sums(confusion_counts(predictions, truth, predicted, [model]), [model]), model)


def compared(sums: DataFrame, model: str) -> DataFrame:
    """Accuracy and macro F1 per model from its class sums."""
    return sums.groupBy(model).agg(
        F.round(F.try_divide(F.sum("hits"), F.sum("support")), 4).alias("accuracy"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
    )


def failure_cases(scored: DataFrame) -> DataFrame:
    """Records whose intent or escalation differs from a known truth, with the reason."""
    decided = F.col("_decision")

    def differs(truth: Column, got: Column) -> Column:
        return F.coalesce((truth != "") & ~truth.eqNullSafe(got), F.lit(False))

    intent_wrong = differs(F.col("ground_truth_intent"), F.col("predicted_intent"))
    escalation_wrong = differs(F.col("ground_truth_escalation"), decided)
    rows = scored.withColumn("_decision", F.col("escalation.decision"))
    return filter_computed(rows, intent_wrong | escalation_wrong).select(
        "conversation_id",
        "customer_message",
        "predicted_intent",
        "ground_truth_intent",
        decided.alias("predicted_escalation"),
        "ground_truth_escalation",
        F.col("intent_confidence").alias("confidence"),
        F.when(intent_wrong, R.FAILURE_INTENT).otherwise(R.FAILURE_ESCALATION).alias("reason"),
        F.lit(R.FAILURE_CAUSE).alias("root_cause"),
        F.lit(R.FAILURE_REMEDY).alias("possible_improvement"),
    )


def top_failures(scored: DataFrame, n: int = 5) -> DataFrame:
    return failure_cases(scored).orderBy("conversation_id").limit(n)
