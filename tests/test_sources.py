import csv
import random

import pytest

from carewise.sources.splitcsv import scan_csv
from carewise.sources.tables import read_tweets_csv
from carewise.sources.schemas import TWEETS


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes, so that every kind of text is cut."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def change(size):
        for name, value in zip(names, (size, 1)):
            spark.conf.set(name, str(value))

    yield change
    for name in names:
        spark.conf.unset(name)


def written(path, rows, header=("a", "b", "c")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)


@pytest.mark.parametrize("size", [19, 64])
def test_records_across_ranges(spark, small_ranges, tmp_path, size):
    rng = random.Random(size)
    texts = ["plain", "two\nlines", "a \"quoted\" word", "\n\n", "comma, and\n\"both\"\n", "\"", "é ß", "long " * 12, "x\n" * 25]
    for name in ("one", "two"):
        written(tmp_path / f"{name}.csv", [(f"{name}{i}", rng.choice(texts), rng.choice(texts)) for i in range(9)])
    expected = []
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", newline="", encoding="utf-8") as f:
            expected += [tuple(r) for r in csv.reader(f)][1:]
    small_ranges(size)
    got = scan_csv(spark, str(tmp_path))
    assert got.columns == ["a", "b", "c"] and sorted(map(tuple, got.collect())) == sorted(expected)


def test_tweets_of_a_split_file(spark, small_ranges, tmp_path):
    rows = [(i, "user", "True", "now", "first\nsecond \"third\"" if i % 3 else "one", "" if i % 2 else f"{i - 1}.0") for i in range(1, 14)] + [("no number", "u", "x", "y", "z", "1")]
    written(tmp_path / "tweets.csv", rows, TWEETS.fieldNames())
    small_ranges(90)
    tweets = read_tweets_csv(spark, str(tmp_path / "tweets.csv"))
    got = {r["tweet_id"]: (r["inbound"], r["text"], r["in_response_to_tweet_id"]) for r in tweets.collect()}
    assert got == {i: (True, text, int(float(parent)) if parent else None) for i, _, _, _, text, parent in rows if i != "no number"}


def test_no_records(spark, tmp_path):
    written(tmp_path / "none.csv", [])
    assert scan_csv(spark, str(tmp_path / "none.csv")).count() == 0
