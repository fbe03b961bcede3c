import random

import pytest
from pyspark.sql import functions as F

from carewise.operators import agreement, metrics
from carewise.operators.sampling import balanced_sample, numbered, quotas, sample_n, stratified_sample

PAIRS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "c")] + [("d", "a")] + [(None, "a")]


@pytest.fixture(scope="module")
def confusion(spark):
    return metrics.confusion_counts(spark.createDataFrame(PAIRS, "t string, p string"), "t", "p")


def test_per_class_by_hand(confusion):
    rows = {r["label"]: r for r in metrics.per_class(confusion).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["a"]["support"]) == (5 / 6, 5 / 7, 7)
    assert (rows["b"]["precision"], rows["b"]["recall"]) == (3 / 5, 3 / 4)
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["f1"], rows["c"]["support"]) == (0, 0, 0, 0)
    assert (rows["d"]["precision"], rows["d"]["recall"], rows["d"]["f1"], rows["d"]["support"]) == (0, 0, 0, 1)


def test_averages_by_hand(confusion):
    f1 = {"a": 10 / 13, "b": 2 / 3, "c": 0.0, "d": 0.0}
    assert metrics.accuracy(confusion).first()["accuracy"] == pytest.approx(8 / 12)
    assert metrics.macro_prf(confusion).first()["f1"] == pytest.approx(sum(f1.values()) / 4)
    assert metrics.weighted_prf(confusion).first()["f1"] == pytest.approx((7 * f1["a"] + 4 * f1["b"]) / 12)
    one = metrics.binary_prf(confusion, "b").first()
    assert (one["precision"], one["recall"], one["f1"], one["support"]) == (3 / 5, 3 / 4, pytest.approx(2 / 3), 4)
    none = metrics.binary_prf(confusion, "zzz").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0, 0, 0)
    report = {r["label"]: r for r in metrics.classification_report(confusion).collect()}
    assert set(report) == {"a", "b", "c", "d", "accuracy", "macro avg", "weighted avg"}


def test_a_missing_prediction_is_a_miss(spark):
    rows = [("a", "a"), ("a", "b"), ("a", None), ("b", "b")]
    counts = metrics.confusion_counts(spark.createDataFrame(rows, "t string, p string"), "t", "p")
    assert metrics.accuracy(counts).first().asDict() == {"accuracy": 0.5, "support": 4}
    classes = {r["label"]: r for r in metrics.per_class(counts).collect()}
    assert set(classes) == {"a", "b"}
    assert classes["a"]["recall"] == pytest.approx(1 / 3) and classes["a"]["support"] == 3
    assert classes["a"]["precision"] == 1.0


def test_matrix_has_the_full_grid(confusion):
    grid = {(r["truth"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(confusion).collect()}
    assert len(grid) == 16 and sum(grid.values()) == 12 and grid["a", "b"] == 2 and grid["c", "c"] == 0


def test_empty_input(spark):
    empty = metrics.confusion_counts(spark.createDataFrame([], "t string, p string"), "t", "p")
    assert metrics.accuracy(empty).first()["accuracy"] is None
    assert metrics.confusion_matrix(empty).count() == 0


def test_models_side_by_side(spark):
    rows = [("x", t, p) for t, p in PAIRS] + [("y", t, t) for t, _ in PAIRS]
    got = {r["model"]: (r["accuracy"], r["macro_f1"]) for r in
           metrics.compare_models(spark.createDataFrame(rows, "model string, t string, p string"), "model", "t", "p").collect()}
    assert got["y"] == (1.0, 1.0) and got["x"][0] == 0.6667


def test_label_counts(spark):
    rows = metrics.label_counts(spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "l string"), "l").collect()
    assert [tuple(r) for r in rows] == [("b", 2), ("a", 1), ("c", 1)]


def brute_spearman(xs, ys):
    def ranks(values):
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    rx, ry = ranks(xs), ranks(ys)
    mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
    xy = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    return xy / (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5


@pytest.mark.parametrize("places", [0, 1, 6])
def test_spearman_equals_brute_force(spark, places):
    rng = random.Random(places)
    xs = [3.0 if rng.random() < 0.33 else round(rng.random() * 5, places) for _ in range(400)]
    ys = [round(x + rng.gauss(0, 2), places) for x in xs]
    rated = spark.createDataFrame(list(zip(xs, ys)), "a double, b double")
    row = agreement.spearman(rated, "a", "b").first()
    assert row["sample_size"] == 400 and row["spearman"] == pytest.approx(brute_spearman(xs, ys), abs=6e-4)


def test_constant_scores_have_no_correlation(spark):
    rated = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "a double, b double")
    assert agreement.pearson(rated, "a", "b").first()["pearson"] is None
    assert agreement.spearman(rated, "a", "b").first()["spearman"] is None
    assert agreement.spearman(rated.limit(0), "a", "b").first()["spearman"] is None


def test_rater_agreement(spark):
    rated = spark.createDataFrame([(4.0, 4.5), (3.0, 5.0), (5.0, 5.0)], "a double, b double")
    row = agreement.rater_agreement(rated, "a", "b").first()
    assert tuple(row) == (3, 4.0, 4.83, 0.833, 66.7)
    assert agreement.pearson(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "a double, b double"), "a", "b").first()["pearson"] == 1.0


# --- samples ---

def test_quotas():
    assert quotas(200, list("abcdefghijk"))["a"] == 19 and sum(quotas(200, list("abcdefghijk")).values()) == 200
    assert quotas(2, list("abc")) == {"a": 1, "b": 1, "c": 0}


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_samples_are_exact_and_repeatable(spark, with_partitions, partitions):
    with_partitions(partitions)
    rows = spark.range(5000).repartition(partitions).withColumn("c", F.when(F.col("id") < 4000, "big").when(F.col("id") < 4900, "mid").otherwise("small"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    once = ids(sample_n(rows, 321, "id"))
    assert len(once) == len(set(once)) == 321 and once == ids(sample_n(rows, 321, "id", last_rows=0))
    assert once != ids(sample_n(rows, 321, "id", seed=1))
    assert sample_n(rows, 6000, "id").count() == 5000 == sample_n(rows, 6000, "id", last_rows=0).count()
    strata = stratified_sample(rows, 700, "c", ["big", "mid", "small"], "id").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in strata} == {"big": 234, "mid": 233, "small": 100}
    full = balanced_sample(rows, 700, "c", ["big", "mid", "small"], "id")
    assert len(ids(full)) == 700 and len(set(ids(full))) == 700
    assert balanced_sample(rows, 9000, "c", ["big", "mid", "small"], "id").count() == 5000


def test_large_balanced_sample(spark, monkeypatch):
    from carewise.operators import sampling

    rows = spark.range(3000).withColumn("c", F.when(F.col("id") < 2900, "big").otherwise("small"))
    small = sorted(r["id"] for r in balanced_sample(rows, 400, "c", ["big", "small"], "id").collect())
    monkeypatch.setattr(sampling, "DIGITS", 1)
    assert small == sorted(r["id"] for r in balanced_sample(rows, 400, "c", ["big", "small"], "id").collect())


def test_strata_outside_the_classes_only_top_up(spark):
    rows = spark.range(100).withColumn("c", F.when(F.col("id") < 10, "a").otherwise("other"))
    assert {r["c"] for r in stratified_sample(rows, 8, "c", ["a"], "id").collect()} == {"a"}
    assert balanced_sample(rows, 30, "c", ["a"], "id").filter("c = 'a'").count() == 10


def test_numbering(spark):
    got = [r["conversation_id"] for r in numbered(spark.range(12), "G_%03d", "id").orderBy("conversation_id").collect()]
    assert got[0] == "G_001" and got[-1] == "G_012"


def test_ranks_of_close_scores(spark):
    """Scores that differ in the tenth place have ranks of their own; sums take four places."""
    rng = random.Random(12)
    xs = [0.5 + rng.randrange(10**5) * 1e-10 for _ in range(300)]
    ys = [x * x + rng.randrange(50) * 1e-10 for x in xs]
    rated = spark.createDataFrame(list(zip(xs, ys)), "a double, b double").repartition(3)
    exact = brute_spearman(xs, ys)
    assert exact > 0.9 and agreement.spearman(rated, "a", "b").first()["spearman"] == pytest.approx(exact, abs=6e-4)
    assert agreement.pearson(rated, "a", "b").first()["pearson"] is None  # constant with four places
