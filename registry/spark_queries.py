"""Every operator over the given tables, as (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carewise.functions.text import clean_text
from carewise.operators import agreement, audit, judge, metrics
from carewise.operators.conversations import (
    clean_pairs,
    first_per_message,
    is_valid_conversation,
    pair_replies,
    valid_unique_conversations,
)
from carewise.operators.intent import (
    IntentModel,
    KeywordModel,
    calibrated_by_model,
    calibrated_by_rule,
    class_weights,
    disjoint_training,
    intent_rollup,
    keyword_baseline,
    label_conversations,
    random_baseline,
    with_rule_intent,
)
from carewise.operators.retrieval import ConversationIndex
from carewise.operators.sampling import balanced_sample, sample_n, stratified_sample
from carewise.operators.tfidf import TfidfSettings, term_stats
from carewise.operators.topics import discover_topics
from carewise.plans import jobs
from carewise.session import new_folder
from carewise.sources import tables
from carewise.streaming.monitor import audit_windows, start_monitor
from carewise.streaming.scoring import read_scored_stream, start_scoring
from registry import inputs
from registry.inputs import TRAINING_STEPS

SEED = 42
Query = Callable[[SparkSession, str], DataFrame]


# --- flagship ---

def intent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns to pairs, cleaned, valid, unique, matched, decided and counted."""
    conversations = valid_unique_conversations(inputs.phrased_tweets(spark, sf_dir), inputs.BRAND_ACCOUNT)
    decided = jobs.escalate(keyword_baseline(conversations))
    return decided.groupBy(
        F.col("predicted_intent").alias("intent"), F.col("escalation.decision").alias("decision")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- scans and sinks ---

def scan_tweets_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tweets-csv")
    tables.write_tweets_csv(inputs.tweets(spark, sf_dir), path)
    tweets = tables.read_tweets_csv(spark, path)
    return tweets.drop("created_at").withColumn("in_response_to_tweet_id", F.coalesce("in_response_to_tweet_id", F.lit(-1)))


def roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "conversations")
    tables.write_conversations(inputs.pairs(spark, sf_dir), path, "csv")
    again = tables.read_conversations(spark, path, "csv")
    tables.write_conversations(again, f"{path}-parquet")
    return tables.read_conversations(spark, f"{path}-parquet").drop("created_at")


def _flat_scored(scored: DataFrame) -> DataFrame:
    return scored.select(
        "conversation_id",
        "customer_message",
        "predicted_intent",
        "intent_confidence",
        F.col("escalation.decision").alias("decision"),
        F.col("escalation.reason").alias("reason"),
        F.col("escalation.confidence").alias("decision_confidence"),
        "grounded_reply",
        F.array_join("influenced_by.conversation_id", ",").alias("cited"),
        F.array_join("influenced_by.historical_snippet", "|").alias("snippets"),
        F.coalesce(F.get("influenced_by.similarity_score", F.lit(0)), F.lit(0.0)).alias("best_score"),
        "grounding_rationale",
        "is_grounded",
        "ground_truth_intent",
        "ground_truth_escalation",
    )


def roundtrip_scored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "scored-json")
    tables.write_scored(inputs.scored(spark, sf_dir), path)
    return _flat_scored(tables.read_scored(spark, path))


def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "review-batch")
    tables.write_review_batch(inputs.scored_table(spark, sf_dir), path)
    return spark.read.json(f"{path}/metadata").select("source", "records_count")


def taxonomy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy with the messages that match each intent, out of all source conversations."""
    matched = with_rule_intent(inputs.phrased(spark, sf_dir))
    rollup = intent_rollup(matched, "rule_intent")
    total = matched.agg(F.count(F.lit(1))).scalar()
    return rollup.select(
        "intent",
        "ord",
        "description",
        F.array_join("keywords", ", ").alias("keywords"),
        "default_escalation",
        "priority",
        F.col("n").alias("matched"),
        total.alias("source_conversations"),
    )


# --- texts and filters ---

def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = inputs.dirty_texts(spark, sf_dir).withColumn("cleaned", clean_text(F.col("raw")))
    return cleaned.select("conv_id", "turn", "cleaned", F.char_length("cleaned").alias("length"))


def clean_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaner on web pages, whose markup holds entities."""
    return inputs.table(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html")).alias("cleaned"))


def valid_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pairs(spark, sf_dir).select(
        "conversation_id",
        is_valid_conversation(F.col("customer_message"), F.col("support_reply"), 150).alias("valid_150"),
        is_valid_conversation(F.col("customer_message"), F.col("support_reply")).alias("valid_20"),
    )


def paired_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pairs(pair_replies(inputs.tweets(spark, sf_dir), inputs.BRAND_ACCOUNT)).drop("created_at")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = jobs.build_conversations(inputs.doubled_tweets(spark, sf_dir), inputs.BRAND_ACCOUNT)
    return conversations.drop("created_at")


def conversation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation job with a target size and running ids."""
    sample = jobs.build_conversations(inputs.tweets(spark, sf_dir), inputs.BRAND_ACCOUNT, target=100, seed=SEED)
    return sample.select("conversation_id", "support_tweet_id", "char_length_customer", "char_length_reply")


def dedup_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = clean_pairs(pair_replies(inputs.doubled_tweets(spark, sf_dir), inputs.BRAND_ACCOUNT))
    return first_per_message(doubled).select("support_tweet_id", "customer_message")


# --- rule cascades ---

def rule_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rule_intent(inputs.phrased(spark, sf_dir)).select("conversation_id", "rule_intent")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_conversations(inputs.phrased(spark, sf_dir)).select(
        "conversation_id", "intent", "escalation", "reply_keywords", "ground_truth_notes"
    )


def escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decided(spark, sf_dir).select(
        "conversation_id",
        "predicted_intent",
        "intent_confidence",
        F.col("escalation.decision").alias("decision"),
        F.col("escalation.reason").alias("reason"),
        F.col("escalation.confidence").alias("confidence"),
    )


def grounded_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.scored(spark, sf_dir).select("conversation_id", "grounded_reply", "grounding_rationale", "is_grounded")


def influenced_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.scored(spark, sf_dir).select(
        F.col("conversation_id").alias("query_id"), F.posexplode("influenced_by").alias("pos", "hit")
    ).select("query_id", (F.col("pos") + 1).alias("rank"), "hit.*")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_items(inputs.scored_table(spark, sf_dir), keep=("fault", "intent_confidence"))


def _review(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _audited(spark, sf_dir).select(
            "conversation_id", F.col(f"{name}.status").alias("status"), F.col(f"{name}.reason").alias("reason")
        )

    return query


def audit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("conversation_id", "item_verdict", "item_score")


def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.audit_batch(inputs.scored_table(spark, sf_dir))


def audit_rollup_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.audit_batch(inputs.scored_table(spark, sf_dir), ["predicted_intent"])


def judge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.judge_replies(inputs.scored_table(spark, sf_dir))


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five audited items by id, which the report shows."""
    items = audit.sample_audits(audit.audit_items(inputs.scored_table(spark, sf_dir)))
    return items.select("conversation_id", "item_verdict", "item_score")


def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.judge_means(judge.judge_replies(inputs.scored_table(spark, sf_dir)))


def failure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.failure_cases(inputs.scored_table(spark, sf_dir))


def top_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_failures(inputs.scored_table(spark, sf_dir)).select("conversation_id", "reason")


# --- metrics ---

def _intent_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_counts(inputs.scored_table(spark, sf_dir), "ground_truth_intent", "predicted_intent")


def _six(df: DataFrame) -> DataFrame:
    """Floating point results with six places."""
    return df.select(*[
        F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields
    ])


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_counts(label_conversations(inputs.phrased(spark, sf_dir)), "intent")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.accuracy(metrics.confusion_counts(inputs.line_flags(spark, sf_dir), "truth", "predicted")))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.classification_report(_intent_confusion(spark, sf_dir)))


def macro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.macro_prf(metrics.confusion_counts(inputs.line_flags(spark, sf_dir), "truth", "predicted")))


def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.weighted_prf(metrics.confusion_counts(inputs.line_flags(spark, sf_dir), "truth", "predicted")))


def binary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    confusion = metrics.confusion_counts(inputs.label_pairs(spark, sf_dir), "truth", "predicted")
    return _six(metrics.binary_prf(confusion, "toxic"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_intent_confusion(spark, sf_dir))


def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = jobs.baseline_predictions(inputs.scored_table(spark, sf_dir))
    return metrics.compare_models(predictions, "model", "truth", "predicted")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score columns in one projection: the judge's mean and half the audit score."""
    scored = inputs.scored_table(spark, sf_dir)
    needed = [c for c in scored.columns if c != "conversation_id"]
    judged = judge.judge_replies(scored, keep=needed).withColumnRenamed("average_score", "judge_score")
    audited = audit.audit_items(judged, keep=("customer_message", "grounded_reply", "judge_score"))
    return audited.withColumn("audit_score", F.col("item_score") / 2.0)


def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.rater_agreement(_rated(spark, sf_dir), "audit_score", "judge_score")


def rater_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.comparisons(_rated(spark, sf_dir), "audit_score", "judge_score")


def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.pearson(_rated(spark, sf_dir), "audit_score", "judge_score")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.spearman(_rated(spark, sf_dir), "audit_score", "judge_score")


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.evaluate(inputs.scored_table(spark, sf_dir), _rated(spark, sf_dir), "audit_score", "judge_score")


def metrics_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics written to their sink and read back."""
    path = new_folder(spark, "metrics")
    tables.write_metrics(metrics_summary(spark, sf_dir), path)
    return tables.read_metrics(spark, path)


# --- samples ---

def sample_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_n(inputs.table(spark, sf_dir, "documents"), 250, "doc_id", SEED).select("doc_id", "lang", "n_chars")


LANGUAGES = ("de", "en", "es", "fr")


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return stratified_sample(docs, 501, "lang", LANGUAGES, "doc_id", SEED)


def topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return balanced_sample(docs, 501, "lang", LANGUAGES, "doc_id", SEED)


def golden_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.build_golden(inputs.phrased(spark, sf_dir), 100, SEED)


def train_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = inputs.phrased(spark, sf_dir)
    golden = jobs.build_golden(messages, 100, SEED).withColumn("customer_message", F.concat(F.lit(" \t"), F.lower("customer_message")))
    return disjoint_training(label_conversations(messages), golden).select("conversation_id", "intent")


# --- features, retrieval ---

def term_stats_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stats(inputs.table(spark, sf_dir, "documents"), "text", TfidfSettings(high=1))


def _index(spark: SparkSession, sf_dir: str) -> ConversationIndex:
    return ConversationIndex.fit(inputs.pairs(spark, sf_dir))


def tfidf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return index.postings.join(index.vocab, "term_id").select(
        F.col("doc_id").alias("conversation_id"), "term", "df", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight")
    )


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.phrased(spark, sf_dir).select(
        F.col("conversation_id").alias("query_id"), F.col("customer_message").alias("query"), "fault"
    )


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "conversation_id", "similarity_score", F.char_length("support_reply").alias("reply_length"))


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_columns(_index(spark, sf_dir).search(_asked(spark, sf_dir)))


def retrieve_topk_noself(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_columns(_index(spark, sf_dir).search(_asked(spark, sf_dir), exclude_self=True))


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = jobs.build_index(inputs.pairs(spark, sf_dir), new_folder(spark, "index"))
    return _hit_columns(index.search(_asked(spark, sf_dir)))


def blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the messages blanked: no hits for them, and the default intent."""
    asked = _asked(spark, sf_dir).withColumn("query", F.when(F.col("fault") < 10, F.lit(" \n ")).otherwise(F.col("query")))
    hits = _index(spark, sf_dir).search(asked).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    classified = KeywordModel().classify(asked, "query_id", "query")
    return classified.join(hits, "query_id", "left").select(
        "query_id", "predicted_intent", "intent_confidence", F.coalesce("hits", F.lit(0)).alias("hits")
    )


# --- models ---

def class_weights_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(class_weights(label_conversations(inputs.phrased(spark, sf_dir))))


def calibrate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities taken from event values."""
    p = F.col("p")
    events = inputs.table(spark, sf_dir, "events").select("event_id", (F.pmod(F.floor(F.col("value") * 100), F.lit(1000)) / 1000.0).alias("p"))
    return events.select("event_id", calibrated_by_rule(p).alias("by_rule"), calibrated_by_model(p).alias("by_model"))


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_baseline(inputs.phrased(spark, sf_dir)).select("conversation_id", "predicted_intent", "intent_confidence")


def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_baseline(inputs.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=SEED)


def intent_priority_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = intent_rollup(label_conversations(inputs.phrased(spark, sf_dir)))
    return rollup.groupBy("priority", "default_escalation").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("intents"))


@lru_cache(maxsize=4)
def _trained(application: str, sf_dir: str, steps: int | None) -> jobs.TrainingResult:
    """The training job up to the optimum, or, for queries that SQL follows step by step, up to a step."""
    spark = SparkSession.active()
    labelled = label_conversations(inputs.phrased(spark, sf_dir))
    golden = label_conversations(jobs.build_golden(inputs.phrased(spark, sf_dir), 20, SEED).select("conversation_id", "customer_message"))
    return jobs.train_and_evaluate(labelled, golden, steps=steps, optimum=steps is None)


def _training(spark: SparkSession, sf_dir: str, steps: int | None = TRAINING_STEPS) -> jobs.TrainingResult:
    return _trained(spark.sparkContext.applicationId, sf_dir, steps)


def train_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted coefficients, one row per term and class."""
    model = _training(spark, sf_dir, steps=None).model
    names = F.array(*[F.lit(x) for x in model.labels])
    return model.weights.select("term", F.posexplode("coefficients").alias("class", "coefficient")).select(
        "term", F.get(names, F.col("class")).alias("label"), F.round("coefficient", 3).alias("coefficient")
    )


def train_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir).metrics


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _training(spark, sf_dir).model
    messages = inputs.phrased(spark, sf_dir).select("conversation_id", "customer_message")
    return model.classify(messages, "conversation_id", "customer_message").drop("customer_message")


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _training(spark, sf_dir).model
    messages = inputs.phrased(spark, sf_dir).select("conversation_id", "customer_message")
    rows = model.class_distribution(messages, "conversation_id", "customer_message")
    return rows.select("conversation_id", F.explode("distribution").alias("label", "probability"))


def classifier_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "model")
    _training(spark, sf_dir).model.save(path)
    messages = inputs.phrased(spark, sf_dir).select("conversation_id", "customer_message")
    again = IntentModel.load(spark, path)
    return again.classify(messages, "conversation_id", "customer_message").drop("customer_message")


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_topics(inputs.phrased(spark, sf_dir), starts=2)


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = label_conversations(inputs.phrased(spark, sf_dir))
    return _flat_scored(jobs.score_messages(labelled, _training(spark, sf_dir).model, _index(spark, sf_dir)))


def score_batch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring job on the first 25 messages by id, as its limit takes them."""
    labelled = label_conversations(inputs.phrased(spark, sf_dir))
    return _flat_scored(jobs.score_messages(labelled, KeywordModel(), _index(spark, sf_dir), limit=25))


def score_batch_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring job with the keyword classifier, which SQL can follow."""
    labelled = label_conversations(inputs.phrased(spark, sf_dir))
    return _flat_scored(jobs.score_messages(labelled, KeywordModel(), _index(spark, sf_dir)))


# --- streams ---

def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customer turns as a stream, scored against the index and audited."""
    messages = inputs.stream_messages(inputs.table_stream(spark, sf_dir, "conversations"))
    path = new_folder(spark, "stream-scored")
    index = _index(spark, sf_dir).laid_out()
    start_scoring(messages, KeywordModel(), index, path, f"{path}-checkpoint").awaitTermination()
    return read_scored_stream(spark, path).select(
        "conversation_id", "predicted_intent", "intent_confidence", F.col("escalation.decision").alias("decision"),
        "is_grounded", "item_verdict", "item_score",
    )


def stream_audit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit reports of the windows that the stream has closed."""
    path = new_folder(spark, "stream-audit")
    start_monitor(inputs.event_items(inputs.table_stream(spark, sf_dir, "events")), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path)


def audit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_windows(inputs.event_items(inputs.table(spark, sf_dir, "events")))


QUERIES: dict[str, Query] = {
    "intent_decisions": intent_decisions,
    "scan_tweets_csv": scan_tweets_csv,
    "roundtrip_conversations": roundtrip_conversations,
    "roundtrip_scored_json": roundtrip_scored_json,
    "review_manifest": review_manifest,
    "taxonomy_table": taxonomy_table,
    "clean_text": clean_texts,
    "clean_unescape": clean_unescape,
    "valid_conversations": valid_conversations,
    "paired_replies": paired_replies,
    "conversation_pairs": conversation_pairs,
    "conversation_sample": conversation_sample,
    "dedup_messages": dedup_messages,
    "rule_intent": rule_intent,
    "label_conversations": label_rows,
    "escalate": escalate,
    "grounded_reply": grounded_reply,
    "influenced_by": influenced_by,
    "audit_intent": _review("intent_review"),
    "audit_escalation": _review("escalation_review"),
    "audit_grounding": _review("grounding_review"),
    "audit_items": audit_items,
    "audit_sample": audit_sample,
    "audit_rollup": audit_rollup,
    "audit_rollup_by_intent": audit_rollup_by_intent,
    "judge_replies": judge_rows,
    "judge_means": judge_means,
    "failure_cases": failure_cases,
    "top_failures": top_failures,
    "label_counts": label_counts,
    "accuracy": accuracy,
    "classification_report": classification_report,
    "macro_prf": macro_prf,
    "weighted_prf": weighted_prf,
    "binary_prf": binary_prf,
    "confusion_matrix": confusion_matrix,
    "baseline_comparison": baseline_comparison,
    "rater_agreement": rater_agreement,
    "rater_comparisons": rater_comparisons,
    "pearson": pearson,
    "spearman": spearman,
    "metrics_summary": metrics_summary,
    "metrics_roundtrip": metrics_roundtrip,
    "sample_n": sample_of_n,
    "stratified_sample": stratified,
    "balanced_sample": topped_up,
    "golden_sample": golden_sample,
    "train_disjoint": train_disjoint,
    "term_stats": term_stats_documents,
    "tfidf_index": tfidf_index,
    "retrieve_topk": retrieve_topk,
    "retrieve_topk_noself": retrieve_topk_noself,
    "index_roundtrip": index_roundtrip,
    "blank_queries": blank_queries,
    "class_weights": class_weights_labels,
    "calibrate_confidence": calibrate_confidence,
    "keyword_baseline": keyword_rows,
    "random_baseline": random_rows,
    "intent_priority_rollup": intent_priority_rollup,
    "train_classifier": train_classifier,
    "train_eval_report": train_eval_report,
    "classify": classify,
    "class_distribution": class_distribution,
    "classifier_roundtrip": classifier_roundtrip,
    "topic_terms": topic_terms,
    "score_batch": score_batch,
    "score_batch_keywords": score_batch_keywords,
    "score_batch_limit": score_batch_limit,
    "stream_score": stream_score,
    "stream_audit_window": stream_audit_window,
    "audit_window": audit_window,
}
