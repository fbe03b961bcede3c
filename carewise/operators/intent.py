"""Intents: taxonomy match, labeller, baselines and the trained classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.functions.cascade import first_match, found
from carewise.functions.text import comparison_key, is_blank
from carewise.operators.descent import FEATURE_UNIT, descend, minimise
from carewise.operators.tfidf import TfidfSettings, fit_vocabulary, vector_rows, weigh
from carewise.session import broadcast_if_small, stored

CLASSIFIER_TERMS = 8000
INVERSE_REGULARISATION = 3.0
TOLERANCE = 1e-4
KEYWORD_CONFIDENCE = 0.85
DEFAULT_CONFIDENCE = 0.40
BLANK_CONFIDENCE = 0.50


def taxonomy_table(spark: SparkSession, intents: Sequence[R.Intent] | None = None) -> DataFrame:
    """The taxonomy as rows, ``ord`` being the test order."""
    intents = R.taxonomy() if intents is None else intents
    rows = F.array(*[
        F.struct(
            F.lit(i.name).alias("intent"),
            F.lit(n).alias("ord"),
            F.lit(i.description).alias("description"),
            F.array(*[F.lit(word) for word in i.keywords]).alias("keywords"),
            F.lit(i.regex).alias("regex"),
            F.lit(i.default_escalation).alias("default_escalation"),
            F.lit(i.priority).alias("priority"),
        )
        for n, i in enumerate(intents)
    ])
    return spark.range(1).select(F.inline(rows))


def intents_from_table(table: DataFrame) -> tuple[R.Intent, ...]:
    """A user's own taxonomy table (the columns of ``taxonomy_table``) as rules.

    Rules are part of a query's plan, so the table comes to the driver.
    """
    rows = table.orderBy("ord").collect()
    return tuple(
        R.Intent(r["intent"], r["description"], tuple(r["keywords"]), r["regex"], r["default_escalation"], r["priority"])
        for r in rows
    )


def rule_intent(
    lowered: Column, intents: Sequence[R.Intent] | None = None, first: str | None = R.FIRST_TESTED_INTENT
) -> Column:
    """First taxonomy intent whose pattern occurs, ``first`` being tested before all; else null."""
    intents = R.taxonomy() if intents is None else intents
    ordered = sorted(intents, key=lambda i: i.name != first)  # stable: the rest keeps its order
    return first_match((found(lowered, i.regex), F.lit(i.name)) for i in ordered)


def with_rule_intent(
    df: DataFrame, message: str = "customer_message", name: str = "rule_intent", brand: str = R.DEFAULT_BRAND
) -> DataFrame:
    rule = rule_intent(F.col("_low"), R.taxonomy(brand))
    return df.withColumn("_low", F.lower(F.col(message))).withColumn(name, rule).drop("_low")


def label_conversations(
    conversations: DataFrame,
    message: str = "customer_message",
    rules: Sequence[R.LabelRule] | None = None,
    brand: str = R.DEFAULT_BRAND,
) -> DataFrame:
    """Add intent, escalation, reply_keywords and ground_truth_notes by the labeller's rules."""
    rules = R.label_rules(brand) if rules is None else rules

    def outcome(rule: R.LabelRule) -> Column:
        return F.struct(
            F.lit(rule.intent).alias("intent"),
            F.lit(rule.escalation).alias("escalation"),
            F.lit(rule.reply_keywords).alias("reply_keywords"),
            F.lit(rule.notes).alias("ground_truth_notes"),
        )

    low = F.col("_low")
    chain = first_match(
        [(found(low, rule.pattern), outcome(rule)) for rule in rules if rule.pattern is not None],
        next((outcome(rule) for rule in rules if rule.pattern is None), None),
    )
    labelled = conversations.withColumn("_low", F.lower(F.coalesce(F.col(message), F.lit("")))).withColumn("_label", chain)
    return labelled.select(*conversations.columns, "_label.*")


def intent_rollup(df: DataFrame, intent: str = "intent", intents: Sequence[R.Intent] | None = None) -> DataFrame:
    """Rows per taxonomy intent with its attributes; intents without rows count 0."""
    counts = df.groupBy(F.col(intent).alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    return (
        taxonomy_table(df.sparkSession, intents)
        .join(counts, "intent", "left")
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    )


def calibrated_by_rule(probability: Column) -> Column:
    """Confidence of an intent that a rule and the model both know."""
    return F.round(F.least(F.lit(0.96), F.greatest(F.lit(0.88), probability * 2.0 + 0.40)), 2)


def calibrated_by_model(probability: Column) -> Column:
    """Confidence of the model's own best class."""
    return F.round(F.least(F.lit(0.92), F.greatest(F.lit(0.45), probability * 1.8)), 2)


def disjoint_training(labelled: DataFrame, evaluation: DataFrame, message: str = "customer_message") -> DataFrame:
    """Labelled rows whose message, trimmed and lower-cased, is not in the evaluation set.

    The distinct keys of the evaluation set are measured: few are broadcast, many are
    shuffled, where Spark splits a message that fills a large part of the labelled rows.
    """
    keys = stored(evaluation.select(comparison_key(F.col(message)).alias("_key")).distinct(), "evaluation-keys")
    keys, _ = broadcast_if_small(keys)
    return labelled.withColumn("_key", comparison_key(F.col(message))).join(keys, "_key", "left_anti").drop("_key")


def class_weights(labelled: DataFrame, label: str = "intent") -> DataFrame:
    """Balanced weight n / (k * n_c) of every class."""
    counts = labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    classes = W.partitionBy()  # one row per class
    share = F.sum("n").over(classes) / (F.count(F.lit(1)).over(classes) * F.col("n"))
    return counts.select("label", "n", share.alias("weight"))


def keyword_baseline(
    df: DataFrame, message: str = "customer_message", default: str = R.GENERAL, brand: str = R.DEFAULT_BRAND
) -> DataFrame:
    """Taxonomy match, or the default intent with low confidence."""
    matched = F.col("_rule")
    return (
        with_rule_intent(df, message, "_rule", brand)
        .withColumn("predicted_intent", F.coalesce(matched, F.lit(default)))
        .withColumn("intent_confidence", F.when(matched.isNotNull(), KEYWORD_CONFIDENCE).otherwise(DEFAULT_CONFIDENCE))
        .drop("_rule")
    )


def random_baseline(df: DataFrame, key: str, classes: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """A uniform class and a confidence in [0.8/k, 1.5/k], both drawn from a hash of the key."""
    classes = [i.name for i in R.taxonomy()] if classes is None else list(classes)
    k = len(classes)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    share = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long") / float(2**32)
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn("predicted_intent", F.element_at(names, (draw % k + 1).cast("int"))).withColumn(
        "intent_confidence", F.round(F.lit(0.8 / k) + share * (1.5 / k - 0.8 / k), 2)
    )


@dataclass(frozen=True)
class KeywordModel:
    """The keyword baseline behind the interface of the classifier."""

    default: str = R.GENERAL
    brand: str = R.DEFAULT_BRAND

    def classify(self, messages: DataFrame, key: str, text: str) -> DataFrame:
        predicted = keyword_baseline(messages, text, self.default, self.brand)
        blank = is_blank(F.col(text))
        return predicted.withColumn(
            "predicted_intent", F.when(blank, F.lit(R.GENERAL)).otherwise(F.col("predicted_intent"))
        ).withColumn(
            "intent_confidence", F.when(blank, F.lit(BLANK_CONFIDENCE)).otherwise(F.col("intent_confidence"))
        )


def _training_rows(docs: DataFrame, key: str, vectors: DataFrame, size: int, whole: bool) -> DataFrame:
    """Training rows, stored, in whole units if asked for; feature ``size`` is the intercept."""
    kind, unit = ("bigint", FEATURE_UNIT) if whole else ("double", 1.0)
    x = F.round(F.col("weight") * FEATURE_UNIT).cast("long") if whole else F.col("weight")
    grouped = vectors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_id", x.alias("x")))).alias("_terms"))
    one = F.array(F.struct(F.lit(size).alias("term_id"), F.lit(unit).cast(kind).alias("x")))
    terms = F.concat(F.coalesce("_terms", F.array().cast(f"array<struct<term_id:int,x:{kind}>>")), one)
    rows = docs.join(grouped, key, "left").select(F.col("_label").cast("int").alias("label"), F.col("_weight").alias("weight"), terms.alias("_terms"))
    return stored(rows.select("label", "weight", F.col("_terms.term_id").alias("at"), F.col("_terms.x").alias("x")), "training-rows")


@dataclass(frozen=True)
class IntentModel:
    """TF-IDF and multinomial logistic regression, kept as tables.

    ``weights`` holds one row per term: idf and the coefficients of all classes, so scoring
    is a join on terms and a sum per message, without Python and without a dense vector.
    """

    weights: DataFrame  # (term, term_id, idf, coefficients)
    labels: tuple[str, ...]
    intercepts: tuple[float, ...]
    settings: TfidfSettings
    brand: str = R.DEFAULT_BRAND  # whose rules decide before the model

    @classmethod
    def fit(
        cls,
        training: DataFrame,
        key: str = "conversation_id",
        text: str = "customer_message",
        label: str = "intent",
        settings: TfidfSettings | None = None,
        c: float = INVERSE_REGULARISATION,
        max_iter: int = 1000,
        brand: str = R.DEFAULT_BRAND,
        steps: int | None = None,
        optimum: bool = False,
    ) -> IntentModel:
        """Fit with the engine's solver, up to ``max_iter`` rounds and to its tolerance. With ``optimum``,
        go on to the optimum by as many rounds of L-BFGS. When ``steps`` is given, take that many
        gradient steps on whole numbers, which give the same model on any partitioning."""
        settings = settings or TfidfSettings(max_features=CLASSIFIER_TERMS)
        classes = class_weights(training.filter(F.col(label).isNotNull()), label).orderBy("label")
        rows = classes.collect()  # the labels are part of the model
        if len(rows) < 2:
            raise ValueError("the classifier needs two classes at least")
        labels = tuple(r["label"] for r in rows)
        numbers = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, float(i))])
        shares = F.create_map(*[F.lit(x) for r in rows for x in (r["label"], r["weight"])])
        docs = training.filter(F.col(label).isNotNull()).select(
            key, text, numbers[F.col(label)].alias("_label"), shares[F.col(label)].alias("_weight")
        )
        vocab = fit_vocabulary(docs, text, settings)
        size = vocab.count()
        if optimum or steps is not None:
            total = float(sum(r["n"] for r in rows))  # what balanced weights add up to
            solve, most = (descend, steps) if steps is not None else (minimise, max_iter)
            given = _training_rows(docs, key, weigh(docs, key, text, vocab, settings), size, whole=steps is not None)
            matrix = solve(given, size + 1, len(labels), total, 1.0 / (c * total), most)
            return cls._of(training.sparkSession, vocab, labels, matrix[:-1].tolist(), matrix[-1].tolist(), settings, brand)
        table = vector_rows(docs, key, weigh(docs, key, text, vocab, settings), size, ("_label", "_weight"))
        total = sum(r["n"] * r["weight"] for r in rows)
        fitted = LogisticRegression(
            featuresCol="features",
            labelCol="_label",
            weightCol="_weight",
            regParam=1.0 / (c * total),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=TOLERANCE,
        ).fit(table)
        matrix = fitted.coefficientMatrix.toArray()
        intercepts = [float(x) for x in fitted.interceptVector.toArray()]
        if len(labels) == 2:  # one logit, for the second class
            matrix = [[0.0] * size, matrix[0]]
            intercepts = [0.0, intercepts[0]]
        by_term = [[float(row[i]) for row in matrix] for i in range(size)]
        return cls._of(training.sparkSession, vocab, labels, by_term, intercepts, settings, brand)

    @classmethod
    def _of(cls, spark: SparkSession, vocab: DataFrame, labels, by_term, intercepts, settings: TfidfSettings, brand: str) -> IntentModel:
        coefficients = spark.createDataFrame(list(enumerate(by_term)), "term_id int, coefficients array<double>")
        weights = stored(vocab.join(coefficients, "term_id").select("term", "term_id", "idf", "coefficients"), "weights")
        return cls(broadcast_if_small(weights)[0], labels, tuple(intercepts), settings, brand)

    def save(self, path: str) -> None:
        s = self.settings
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.weights.sparkSession.range(1).select(
            F.lit(list(self.labels)).cast("array<string>").alias("labels"),
            F.lit(list(self.intercepts)).cast("array<double>").alias("intercepts"),
            F.lit(self.brand).alias("brand"),
            F.struct(
                F.lit(s.max_features).alias("max_features"),
                F.lit(s.low).alias("low"),
                F.lit(s.high).alias("high"),
                F.lit(s.min_df).alias("min_df"),
                F.lit(s.sublinear_tf).alias("sublinear_tf"),
                F.lit(s.strip_accents).alias("strip_accents"),
                F.lit(list(s.stop_words)).cast("array<string>").alias("stop_words"),
            ).alias("settings"),
        ).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IntentModel:
        """Read a saved model; a path without one is an error."""
        row = spark.read.parquet(f"{path}/model").first()
        weights, _ = broadcast_if_small(spark.read.parquet(f"{path}/weights"))
        settings = row["settings"].asDict()
        return cls(
            weights,
            tuple(row["labels"]),
            tuple(row["intercepts"]),
            TfidfSettings(**{**settings, "stop_words": tuple(settings["stop_words"])}),
            row["brand"],
        )

    def probabilities(self, messages: DataFrame, key: str, text: str, name: str = "probabilities") -> DataFrame:
        """``messages`` with the class probabilities in the order of ``labels``."""
        vectors = weigh(messages, key, text, self.weights.select("term", "term_id", "idf"), self.settings)
        terms = vectors.join(self.weights.select("term_id", "coefficients"), "term_id")
        # in the order of terms, so that sums do not depend on the order of rows
        own = F.sort_array(F.collect_list(F.struct("term_id", "weight", "coefficients")))
        sums = terms.groupBy(key).agg(own.alias("_terms"))
        intercepts = F.lit(list(self.intercepts)).cast("array<double>")
        margins = F.aggregate(
            F.coalesce("_terms", F.array().cast(sums.schema["_terms"].dataType)), intercepts,
            lambda total, t: F.zip_with(total, t["coefficients"], lambda a, c: a + t["weight"] * c),
        )
        scored = (
            messages.join(sums, key, "left")
            .withColumn("_margins", margins)
            .withColumn("_top", F.array_max("_margins"))
            .withColumn("_powers", F.transform("_margins", lambda m: F.exp(m - F.col("_top"))))
            .withColumn("_total", F.aggregate("_powers", F.lit(0.0), lambda a, b: a + b))
            .withColumn(name, F.transform("_powers", lambda p: p / F.col("_total")))
        )
        return scored.select(*messages.columns, name)

    def classify(self, messages: DataFrame, key: str, text: str) -> DataFrame:
        """Add predicted_intent and intent_confidence; a rule hit on a trained class decides."""
        names = F.array(*[F.lit(x) for x in self.labels])
        rows = (
            self.probabilities(messages, key, text, "_p")
            .withColumn("_low", comparison_key(F.col(text)))
            .withColumn("_rule", rule_intent(F.col("_low"), R.taxonomy(self.brand)))
            .withColumn("_at", F.array_position(names, F.col("_rule")).cast("int"))
            .withColumn("_best", F.array_max("_p"))
        )
        by_rule = F.coalesce(F.col("_at"), F.lit(0)) > 0
        blank = is_blank(F.col(text))
        intent = first_match(
            [(blank, F.lit(R.GENERAL)), (by_rule, F.col("_rule"))],
            F.element_at(names, F.array_position("_p", F.col("_best")).cast("int")),
        )
        confidence = first_match(
            [(blank, F.lit(BLANK_CONFIDENCE)), (by_rule, calibrated_by_rule(F.col("_p")[F.col("_at") - 1]))],
            calibrated_by_model(F.col("_best")),
        )
        return rows.select(
            *messages.columns, intent.alias("predicted_intent"), confidence.alias("intent_confidence")
        )

    def class_distribution(self, messages: DataFrame, key: str, text: str) -> DataFrame:
        """Add ``distribution``, a map of label to probability with 4 places."""
        names = F.array(*[F.lit(x) for x in self.labels])
        rounded = F.transform("_p", lambda p: F.round(p, 4))
        rows = self.probabilities(messages, key, text, "_p")
        return rows.select(*messages.columns, F.map_from_arrays(names, rounded).alias("distribution"))
