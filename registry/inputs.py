"""Inputs that Spark derives from the given tables.

The texts of ``conversations`` are pseudo-words that hit almost no rule, so every customer
message gets one of 29 phrases in front; scored records get a fault by a key modulus, so
that every arm of the audit and of the judge is reached. All tables are used whole.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.functions.text import clean_text
from carewise.operators.conversations import clean_pairs, pair_replies, turns_to_tweets
from carewise.operators.escalation import escalate
from carewise.operators.intent import KeywordModel, label_conversations
from carewise.operators.replies import ground_replies
from carewise.session import shuffle_tasks, stored

BRAND_ACCOUNT = "brand_support"

PHRASES = (
    "the driver never arrived at the corner",
    "you charged twice for one short ride",
    "i was overcharged by a lot yesterday",
    "please give a refund for this trip",
    "the man was rude and shouting",
    "i think my wallet is in your car",
    "my account locked me out again",
    "my password is not accepted here",
    "card declined at checkout today",
    "your app keeps crashing on my phone",
    "the app crashed on the map page",
    "he threatened me on the way home",
    "i felt unsafe in that car",
    "he took the wrong route to work",
    "how do i get a receipt",
    "nice weather in the city today",
    "can’t log in since monday",
    "can't log in since monday",
    "service was 0* and slow",
    "my trip said pickup but nobody",
    "promo code did not apply",
    "the police stopped us on main street",
    "fraud on my account last night",
    "he refused to open the trunk",
    "i dispute an unauthorized charge",
    "danger on the road tonight",
    "my wallet is gone and he is abusive",
    "\u26a0\ufe0fpolice came to the car park",
    "\u200daccident\ufe0f on the bridge tonight",
)

# Gradient steps of the registered classifier.
TRAINING_STEPS = 30

# Faults on scored records by fault number (key modulo 97): from, to, what changes.
FAULTS = 97
REPLY_FAULTS = (
    (12, 14, "Ok."),
    (15, 17, "We can help you with a free ride next week."),
    (18, 20, "Kindly restart the phone and wait for a while"),
    (21, 23, "Only an idiot would ask the support team that"),
    (24, 26, "Please call 1-800 5550 and ask for help there"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. A pattern finds it as one file and as a folder of files; a stream's path
    without a pattern must be a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns in the shape of the tweet table."""
    return turns_to_tweets(table(spark, sf_dir, "conversations"), BRAND_ACCOUNT)


def _phrase(number: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.pmod(number, F.lit(len(PHRASES))) + 1).cast("int"))


def phrased_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tweet table with a phrase in front of every customer text."""
    turns = table(spark, sf_dir, "conversations")
    phrase = _phrase(F.col("conv_id") * 8 + F.col("turn"))
    text = F.when(F.col("role") == "user", F.concat(phrase, F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return turns_to_tweets(turns.withColumn("text", text), BRAND_ACCOUNT)


def stream_messages(turns: DataFrame) -> DataFrame:
    """Cleaned customer turns, phrases in front, of a stream or a table."""
    phrase = _phrase(F.col("conv_id") * 8 + F.col("turn"))
    return turns.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("conversation_id"),
        F.concat(phrase, F.lit(" "), clean_text(F.col("text"))).alias("customer_message"),
    )


def doubled_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tweet a second time under other ids, so that each message comes twice."""
    once = tweets(spark, sf_dir)
    return once.withColumn("_shift", F.explode(F.lit([0, 10**12]))).select(
        (F.col("tweet_id") + F.col("_shift")).alias("tweet_id"),
        "author_id",
        "inbound",
        "created_at",
        "text",
        (F.col("in_response_to_tweet_id") + F.col("_shift")).alias("in_response_to_tweet_id"),
    )


def dirty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with handles, links, blanks and bad characters put around them."""
    prefix = F.element_at(
        F.array(F.lit(""), F.lit("@user_1 "), F.lit("see http://t.co/x1 "), F.lit("  \n don�t ")),
        (F.pmod(F.col("conv_id"), F.lit(4)) + 1).cast("int"),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(prefix, F.col("text"), F.lit(" \t")).alias("raw"))


@lru_cache(maxsize=4)
def _stored_pairs(application: str, sf_dir: str) -> DataFrame:
    spark = SparkSession.active()
    cleaned = clean_pairs(pair_replies(tweets(spark, sf_dir), BRAND_ACCOUNT))
    # rules and terms cost much more than reading, so the table gets a file per task
    return stored(cleaned.repartition(shuffle_tasks(spark), "support_tweet_id"), "pairs")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned customer messages with the replies to them, as the stored table that labelling,
    indexing and scoring read."""
    return _stored_pairs(spark.sparkContext.applicationId, sf_dir)


def _number() -> F.Column:
    """The number of a customer turn, which picks its phrase and its fault."""
    return F.expr("(customer_tweet_id DIV 100) * 8 + customer_tweet_id % 100")


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with a phrase in front of each whole message; ``fault`` numbers the fault."""
    return pairs(spark, sf_dir).select(
        "conversation_id",
        "customer_tweet_id",
        "support_tweet_id",
        F.concat(_phrase(_number()), F.lit(" "), F.col("customer_message")).alias("customer_message"),
        "support_reply",
        F.pmod(_number(), F.lit(FAULTS)).alias("fault"),
    )


def _fault(low: int, high: int) -> F.Column:
    return F.col("fault").between(low, high)


def own_hits(messages: DataFrame) -> DataFrame:
    """Stand-in hits: the pair itself and, for even ids, its reply again with a lower score."""
    score = F.lit(0.15) + (F.char_length("support_reply") % 80) / 100.0
    both = F.when(F.col("support_tweet_id") % 2 == 0, F.lit([1, 2])).otherwise(F.lit([1]))
    return messages.filter(~_fault(9, 11) & ~_fault(30, 32)).select(
        F.col("conversation_id").alias("conversation_id_asked"),
        F.explode(both).alias("rank"),
        "conversation_id",
        F.round(score, 4).alias("score"),
        "support_reply",
    ).select(
        "conversation_id_asked",
        "rank",
        F.format_string("H%s_%d", F.col("conversation_id"), F.col("rank")).alias("conversation_id"),
        F.round(F.col("score") / F.col("rank"), 4).alias("similarity_score"),
        "support_reply",
    )


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrased messages labelled, classified by keywords and given an escalation decision."""
    messages = phrased(spark, sf_dir).withColumn(
        "customer_message", F.when(_fault(30, 32), F.lit(" ")).otherwise(F.col("customer_message"))
    )
    labelled = label_conversations(messages).withColumns({
        "ground_truth_intent": F.when(~_fault(33, 35), F.col("intent")),
        "ground_truth_escalation": F.when(~_fault(33, 35), F.col("escalation")),
    }).drop("intent", "escalation", "reply_keywords", "ground_truth_notes")
    classified = KeywordModel().classify(labelled, "conversation_id", "customer_message").withColumns({
        "predicted_intent": F.when(_fault(0, 2), F.lit("Unlisted")).otherwise(F.col("predicted_intent")),
        "intent_confidence": F.when(_fault(0, 2), F.lit(0.85)).otherwise(F.col("intent_confidence")),
    })
    return escalate(classified)


@lru_cache(maxsize=4)
def _stored_scored(application: str, sf_dir: str) -> DataFrame:
    return stored(scored(SparkSession.active(), sf_dir), "scored")


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored records as the stored table that audit and evaluation read."""
    return _stored_scored(spark.sparkContext.applicationId, sf_dir)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records with every fault in place."""
    rows = decided(spark, sf_dir)
    grounded = ground_replies(rows, own_hits(rows))
    decision = F.col("escalation.decision")
    reply = F.col("grounded_reply")
    for low, high, text in REPLY_FAULTS:
        reply = F.when(_fault(low, high), F.lit(text)).otherwise(reply)
    changed = (
        F.when(_fault(3, 5), F.lit(R.AUTO_HANDLE)).when(_fault(27, 29), F.lower(decision)).otherwise(decision)
    )
    return grounded.withColumns({
        "escalation": F.struct(
            changed.alias("decision"),
            F.col("escalation.reason").alias("reason"),
            F.col("escalation.confidence").alias("confidence"),
        ),
        "intent_confidence": F.when(_fault(6, 8), F.lit(0.35)).otherwise(F.col("intent_confidence")),
        "grounded_reply": reply,
    })


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction from real labels: toxic against shortness of the document."""
    name = {True: "toxic", False: "clean"}
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.when(F.col("toxic") == 1, name[True]).otherwise(name[False]).alias("truth"),
        F.when(F.col("n_chars") < 200, name[True]).otherwise(name[False]).alias("predicted"),
    )


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows with several classes: the return flag against one derived from the line number,
    with no prediction for every eleventh order."""
    flag = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R"), F.lit("X")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("truth"), F.when(F.col("l_orderkey") % 11 != 0, flag).alias("predicted")
    )


def event_items(events: DataFrame) -> DataFrame:
    """Events in the shape of audit items: an error fails, a small value is a grounding failure."""
    failed = F.col("event_type") == "error"
    ungrounded = F.col("value") < 1

    def status(bad: F.Column) -> F.Column:
        return F.struct(F.when(bad, R.FAIL).otherwise(R.PASS).alias("status"))

    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("string").alias("conversation_id"),
        F.when(failed | ungrounded, R.FAIL).otherwise(R.PASS).alias("item_verdict"),
        F.when(failed, 6.5).when(ungrounded, 7.3).otherwise(10.0).alias("item_score"),
        status(failed).alias("intent_review"),
        status(failed & (F.col("user_id") % 2 == 0)).alias("escalation_review"),
        status(ungrounded).alias("grounding_review"),
    )
