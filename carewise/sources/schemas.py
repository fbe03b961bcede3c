"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T

TWEETS = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.LongType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("customer_tweet_id", T.LongType()),
    T.StructField("support_tweet_id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("customer_message", T.StringType()),
    T.StructField("support_reply", T.StringType()),
    T.StructField("char_length_customer", T.IntegerType()),
    T.StructField("char_length_reply", T.IntegerType()),
])

ESCALATION = T.StructType([
    T.StructField("decision", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

CITATIONS = T.ArrayType(T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("similarity_score", T.DoubleType()),
    T.StructField("historical_snippet", T.StringType()),
]))

SCORED = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("customer_message", T.StringType()),
    T.StructField("predicted_intent", T.StringType()),
    T.StructField("intent_confidence", T.DoubleType()),
    T.StructField("escalation", ESCALATION),
    T.StructField("grounded_reply", T.StringType()),
    T.StructField("influenced_by", CITATIONS),
    T.StructField("grounding_rationale", T.StringType()),
    T.StructField("is_grounded", T.BooleanType()),
    T.StructField("ground_truth_intent", T.StringType()),
    T.StructField("ground_truth_escalation", T.StringType()),
    T.StructField("expected_reply_keywords", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
