"""Pairing brand replies with the customer tweets they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.functions.rulebook import ALPHABETIC_RUN, DENIED_MESSAGES, MIN_MESSAGE_LENGTH
from carewise.functions.text import clean_text
from carewise.session import filter_computed, stored


def turns_to_tweets(turns: DataFrame, brand_account: str) -> DataFrame:
    """Conversation turns (conv_id, turn, role, text) as a tweet table.

    Assistant turns are brand tweets that answer the turn before them.
    """
    is_reply = F.col("role") == "assistant"
    tweet_id = F.col("conv_id") * 100 + F.col("turn")
    return turns.select(
        tweet_id.alias("tweet_id"),
        F.when(is_reply, F.lit(brand_account)).otherwise(F.col("conv_id").cast("string")).alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.lit(None).cast("string").alias("created_at"),
        "text",
        F.when(is_reply & (F.col("turn") > 0), tweet_id - 1).alias("in_response_to_tweet_id"),
    )


def brand_replies(tweets: DataFrame, brand_account: str) -> DataFrame:
    """Tweets of the brand that answer another tweet."""
    return tweets.filter(
        (F.col("author_id") == brand_account) & F.col("in_response_to_tweet_id").isNotNull()
    ).select(
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        F.col("tweet_id").alias("support_tweet_id"),
        F.col("text").alias("reply_text"),
    )


def customer_tweets(tweets: DataFrame, null_inbound_is_customer: bool = True) -> DataFrame:
    """One row per inbound tweet id; of several rows with an id the greatest (created_at, text) counts."""
    last = W.partitionBy("tweet_id").orderBy(
        F.col("created_at").desc_nulls_last(), F.col("text").desc_nulls_last(), F.col("inbound").desc_nulls_last()
    )
    return (
        tweets.withColumn("_version", F.row_number().over(last))
        .filter(F.col("_version") == 1)
        .filter(F.coalesce(F.col("inbound"), F.lit(null_inbound_is_customer)))
        .select(
            F.col("tweet_id").alias("customer_tweet_id"),
            "created_at",
            F.col("text").alias("message_text"),
        )
    )


def pair_replies(tweets: DataFrame, brand_account: str, null_inbound_is_customer: bool = True) -> DataFrame:
    """Every brand reply with the inbound tweet it answers; other replies are dropped.

    Only tweets that some reply names are looked at. They are stored with one row per id before
    the join, so that Spark sees its two sides as they are and can split the replies to a
    much-answered tweet over several tasks.
    """
    replies = brand_replies(tweets, brand_account)
    answered = replies.select(F.col("customer_tweet_id").alias("tweet_id")).distinct()
    parents = customer_tweets(tweets.join(answered, "tweet_id", "left_semi"), null_inbound_is_customer)
    return replies.join(stored(parents, "parents"), "customer_tweet_id")


def is_substantive(text: Column, min_len: int = MIN_MESSAGE_LENGTH) -> Column:
    """Long enough and with at least three ASCII letters in a row."""
    return (F.char_length(text) >= min_len) & text.rlike(ALPHABETIC_RUN)


def is_denied(message: Column) -> Column:
    """One of the messages that say nothing."""
    return F.lower(message).isin(*DENIED_MESSAGES)


def is_valid_conversation(message: Column, reply: Column, min_len: int = MIN_MESSAGE_LENGTH) -> Column:
    """Both sides substantive and the message not one of the denied ones."""
    return is_substantive(message, min_len) & is_substantive(reply, min_len) & ~is_denied(message)


def first_per_message(pairs: DataFrame, message: str = "customer_message", order: str = "support_tweet_id") -> DataFrame:
    """Keep the pair with the smallest ``order`` per lower-cased message."""
    first = W.partitionBy(F.lower(F.col(message))).orderBy(F.col(order))
    return pairs.withColumn("_seen", F.row_number().over(first)).filter(F.col("_seen") == 1).drop("_seen")


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with cleaned texts and their lengths, keyed by the reply's tweet id."""
    cleaned = pairs.select(
        "customer_tweet_id",
        "support_tweet_id",
        "created_at",
        clean_text(F.col("message_text")).alias("customer_message"),
        clean_text(F.col("reply_text")).alias("support_reply"),
    )
    return conversation_columns(cleaned)


def conversation_columns(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        F.col("support_tweet_id").cast("string").alias("conversation_id"),
        "customer_tweet_id",
        "support_tweet_id",
        "created_at",
        "customer_message",
        "support_reply",
        F.char_length("customer_message").alias("char_length_customer"),
        F.char_length("support_reply").alias("char_length_reply"),
    )


def valid_unique_conversations(
    tweets: DataFrame,
    brand_account: str,
    min_len: int = MIN_MESSAGE_LENGTH,
    null_inbound_is_customer: bool = True,
) -> DataFrame:
    """Clean, valid conversations, the first one per customer message.

    All replies to one tweet share its message, so only the first substantive reply can
    survive the de-duplication. It is picked before the join, which leaves one row per
    tweet on either side: neither a much-answered tweet nor a copied message makes a hot key.
    """
    replies = (
        brand_replies(tweets, brand_account)
        .withColumn("support_reply", clean_text(F.col("reply_text")))
        .drop("reply_text")
    )
    replies = filter_computed(replies, is_substantive(F.col("support_reply"), min_len))
    earliest = W.partitionBy("customer_tweet_id").orderBy("support_tweet_id", "support_reply")
    replies = replies.withColumn("_n", F.row_number().over(earliest)).filter(F.col("_n") == 1).drop("_n")
    pairs = (
        replies.join(customer_tweets(tweets, null_inbound_is_customer), "customer_tweet_id")
        .withColumn("customer_message", clean_text(F.col("message_text")))
        .drop("message_text")
    )
    message = F.col("customer_message")
    valid = filter_computed(pairs, is_substantive(message, min_len) & ~is_denied(message))
    return conversation_columns(first_per_message(valid))
