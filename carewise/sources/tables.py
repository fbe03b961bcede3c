"""Scans and sinks of the tables that the jobs exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from carewise.sources.schemas import CONVERSATIONS, METRICS, SCORED, TWEETS
from carewise.sources.splitcsv import scan_csv


def _number(text: str) -> F.Column:
    """A whole number, also when it is written as a float; null where it is neither."""
    return F.coalesce(F.expr(f"try_cast(`{text}` AS BIGINT)"), F.expr(f"try_cast(try_cast(`{text}` AS DOUBLE) AS BIGINT)"))


def read_tweets_csv(
    spark: SparkSession, path: str, max_rows: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Scan a tweet CSV by its column names; rows without a numeric id are skipped.

    All columns are read as text and cast, so nothing is inferred; others are not parsed.
    Texts may span lines; large files are split among the tasks all the same. Where none does, set
    ``multi_line`` to False, which saves the pass that counts quotes.
    """
    if multi_line:
        raw = scan_csv(spark, path)
    else:
        raw = spark.read.option("header", True).option("escape", '"').csv(path)
    raw = raw.select(*TWEETS.fieldNames())
    return coerce_tweets(raw if max_rows is None else raw.limit(max_rows))


def coerce_tweets(raw: DataFrame) -> DataFrame:
    """Typed tweets from text columns; ids that are no numbers drop the row or become null."""
    typed = raw.select(
        _number("tweet_id").alias("tweet_id"),
        "author_id",
        F.expr("try_cast(inbound AS BOOLEAN)").alias("inbound"),
        "created_at",
        "text",
        _number("in_response_to_tweet_id").alias("in_response_to_tweet_id"),
    )
    return typed.filter(F.col("tweet_id").isNotNull())


def write_tweets_csv(tweets: DataFrame, path: str) -> None:
    _csv_out(tweets.select(*TWEETS.fieldNames())).csv(path)


def _csv_out(df: DataFrame) -> DataFrameWriter:
    """Texts keep their quotes, line breaks and outer blanks."""
    return (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_conversations(conversations: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows = conversations.select(*CONVERSATIONS.fieldNames())
    writer = _csv_out(rows) if fmt == "csv" else rows.write.mode("overwrite")
    writer.format(fmt).save(path)


def read_conversations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return scan_csv(spark, path, CONVERSATIONS)
    return spark.read.schema(CONVERSATIONS).format(fmt).load(path)


def write_scored(scored: DataFrame, path: str) -> None:
    """Scored records as JSON lines, nested fields kept."""
    scored.write.mode("overwrite").json(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED).json(path)


def write_review_batch(scored: DataFrame, path: str, source: str = "Primary Agent") -> DataFrame:
    """Records plus a one-row manifest (source, time, count); the manifest counts what was written."""
    write_scored(scored, f"{path}/records")
    written = read_scored(scored.sparkSession, f"{path}/records")
    review_manifest(written, source).write.mode("overwrite").json(f"{path}/metadata")
    return written


def review_manifest(scored: DataFrame, source: str = "Primary Agent") -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("records_count")).select(
        F.lit(source).alias("source"), F.current_timestamp().alias("timestamp"), "records_count"
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric rows or report rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Long metric rows as ``write_metrics`` leaves them."""
    return spark.read.schema(METRICS).json(path)
