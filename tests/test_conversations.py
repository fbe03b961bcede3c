import pytest
from pyspark.sql import functions as F

from carewise.operators import conversations as C
from carewise.sources import tables
from carewise.sources.schemas import TWEETS

MESSAGE = "my driver never came to the pickup point"
REPLY = "we are sorry to hear that, please send a note"


def tweets(spark, rows):
    return spark.createDataFrame(rows, TWEETS)


def sample_rows():
    return [
        (1, "alice", True, "t1", MESSAGE, None),
        (2, "desk", False, "t2", REPLY, 1),
        (3, "desk", False, "t3", REPLY + " again", 1),
        (4, "bob", True, "t4", MESSAGE.upper(), None),
        (5, "desk", False, "t5", REPLY, 4),
        (6, "desk", False, "t6", REPLY, 99),
        (7, "other", False, "t7", REPLY, 1),
        (8, "desk", False, "t8", "a statement of its own accord", None),
        (9, "desk", False, "t9", REPLY, 8),
        (10, "carol", None, "t10", "another long enough question here", None),
        (11, "desk", False, "t11", REPLY, 10),
        (12, "dave", True, "a", "old text of a tweet that was sent twice", None),
        (12, "dave", True, "b", "new text of a tweet that was sent twice", None),
        (13, "desk", False, "t13", "short", 12),
        (14, "desk", False, "t14", REPLY, 12),
    ]


def pair_ids(df):
    return sorted((r["customer_tweet_id"], r["support_tweet_id"]) for r in df.collect())


def test_pairing(spark):
    pairs = C.pair_replies(tweets(spark, sample_rows()), "desk")
    assert pair_ids(pairs) == [(1, 2), (1, 3), (4, 5), (10, 11), (12, 13), (12, 14)]
    texts = {r["support_tweet_id"]: r["message_text"] for r in pairs.collect()}
    assert texts[14].startswith("new text")
    strict = C.pair_replies(tweets(spark, sample_rows()), "desk", null_inbound_is_customer=False)
    assert (10, 11) not in pair_ids(strict)


def test_much_answered_tweet_gives_the_same_pairs(spark):
    rows = sample_rows() + [(100 + i, "desk", False, "t", f"{REPLY} {i}", 1) for i in range(50)]
    pairs = C.pair_replies(tweets(spark, rows), "desk")
    assert pairs.filter("customer_tweet_id = 1").count() == 52 and pairs.count() == 56
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # the parents are a stored table, so a skewed join can be split


def test_unique_conversations(spark):
    kept = C.valid_unique_conversations(tweets(spark, sample_rows()), "desk")
    rows = {r["support_tweet_id"]: r for r in kept.collect()}
    assert sorted(rows) == [2, 11, 14]  # 5 repeats the message of 2, 13 is short, 14 is next
    assert rows[2]["conversation_id"] == "2" and rows[2]["char_length_customer"] == len(MESSAGE)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_unique_conversations_do_not_depend_on_partitioning(spark, with_partitions, partitions):
    with_partitions(partitions)
    shuffled = tweets(spark, sample_rows()).repartition(partitions, F.rand(partitions))
    assert sorted(r["support_tweet_id"] for r in C.valid_unique_conversations(shuffled, "desk").collect()) == [2, 11, 14]


def test_validity(spark):
    cases = [
        ("", REPLY, 20, False),
        ("deleted", REPLY, 20, False),
        ("too short", REPLY, 20, False),
        ("12345678901234567890", "12345678901234567890", 20, False),
        (MESSAGE, REPLY, 20, True),
        ("Thanks", REPLY, 1, False),
        ("thanks all", REPLY, 1, True),
    ]
    rows = spark.createDataFrame(cases, "m string, r string, n int, expected boolean")
    for n in (1, 20):
        got = rows.filter(F.col("n") == n).select("m", "expected", C.is_valid_conversation(F.col("m"), F.col("r"), n).alias("got"))
        assert all(r["got"] == r["expected"] for r in got.collect())


def test_valid_filter_computes_the_cleaner_once(spark):
    plan = C.valid_unique_conversations(tweets(spark, sample_rows()), "desk")._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("regexp_replace" in line for line in filters)


def test_csv_round_trip_and_coercion(spark, tmp_path):
    rows = [(1, "a", True, "t", 'quoted "text"\nwith a break ', None), (2, "b", False, "u", " x,y\\", 1)]
    tables.write_tweets_csv(tweets(spark, rows), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in tables.read_tweets_csv(spark, str(tmp_path / "csv")).collect()) == rows
    assert tables.read_tweets_csv(spark, str(tmp_path / "csv"), max_rows=1).count() == 1
    raw = spark.createDataFrame([("7", "a", "True", "t", "x", "3.0"), ("x", "a", "False", "t", "x", ""), ("8.0", "a", "?", "t", "x", None)],
                                "tweet_id string, author_id string, inbound string, created_at string, text string, in_response_to_tweet_id string")
    assert [(r[0], r[2], r[5]) for r in tables.coerce_tweets(raw).orderBy("tweet_id").collect()] == [(7, True, 3), (8, None, None)]


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(
        "author_id,tweet_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        'a,1,True,Tue Oct 31,"two\nlines, ""quoted""",2,\n'
        "desk,2,False,Tue Oct 31,answer,,1.0\n"
    )
    rows = sorted(tuple(r) for r in tables.read_tweets_csv(spark, str(path)).collect())
    assert rows == [(1, "a", True, "Tue Oct 31", 'two\nlines, "quoted"', None), (2, "desk", False, "Tue Oct 31", "answer", 1)]


def test_copies_are_cut_before_the_shuffle(spark):
    plan = C.valid_unique_conversations(tweets(spark, sample_rows()), "desk")._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Exchange hash" in line]
    for at, line in enumerate(lines):
        if "Exchange" in line:  # the plan lists a node before its input
            assert "Partial" in lines[at + 1] and "Final" in lines[at - 1]
