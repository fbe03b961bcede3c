import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.operators import descent, intent
from carewise.operators.topics import discover_topics
from carewise.operators.tfidf import TfidfSettings
from carewise.plans import jobs

TEXTS = [
    ("the car did not come at all", R.PICKUP),
    ("nobody came to the corner to get me", R.PICKUP),
    ("the bill was too high for this way", R.FARE),
    ("the amount on the bill is too much", R.FARE),
    ("give me back the money for the ride", R.REFUND),
    ("money should come back to the card", R.REFUND),
    ("the umbrella stayed on the seat", R.LOST),
    ("a scarf stayed under the seat", R.LOST),
    ("the screen of the phone stays white", R.APP),
    ("a white screen and then nothing on the phone", R.APP),
]


def frame(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "conversation_id string, customer_message string, intent string")


@pytest.fixture(scope="module")
def model(spark):
    return intent.IntentModel.fit(frame(spark, TEXTS))


def classified(model, spark, *texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "conversation_id string, customer_message string")
    return [(r["predicted_intent"], r["intent_confidence"]) for r in
            model.classify(rows, "conversation_id", "customer_message").orderBy("conversation_id").collect()]


def test_classes_and_rule_override(spark, model):
    assert model.labels == tuple(sorted({label for _, label in TEXTS}))
    got = classified(model, spark, "driver never arrived here", "umbrella on the seat", " ", "zzz qqq", "the police came")
    assert got[0][0] == R.PICKUP and 0.88 <= got[0][1] <= 0.96
    assert got[1][0] == R.LOST and 0.45 <= got[1][1] <= 0.92
    assert got[2] == (R.GENERAL, 0.50)
    assert got[3][0] in model.labels
    assert got[4][0] in model.labels  # a rule hit on a class that was not trained does not decide


def test_probabilities_sum_to_one_and_fit_the_training_set(spark, model):
    rows = model.class_distribution(frame(spark, TEXTS), "conversation_id", "customer_message").collect()
    for row in rows:
        assert sum(row["distribution"].values()) == pytest.approx(1.0, abs=5e-4)
        assert max(row["distribution"], key=row["distribution"].get) == row["intent"]


def test_two_classes_save_and_load(spark, tmp_path):
    two = [t for t in TEXTS if t[1] in (R.LOST, R.APP)]
    model = intent.IntentModel.fit(frame(spark, two))
    model.save(str(tmp_path / "model"))
    again = intent.IntentModel.load(spark, str(tmp_path / "model"))
    texts = ["umbrella under the seat", "white phone screen", "something else entirely"]
    assert classified(model, spark, *texts) == classified(again, spark, *texts)
    assert [c[0] for c in classified(again, spark, *texts)[:2]] == [R.LOST, R.APP]
    with pytest.raises(Exception):
        intent.IntentModel.load(spark, str(tmp_path / "nothing"))


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        intent.IntentModel.fit(frame(spark, TEXTS[:2]))


def test_class_weights(spark):
    weights = {r["label"]: r["weight"] for r in intent.class_weights(frame(spark, TEXTS[:3])).collect()}
    assert weights == {R.PICKUP: pytest.approx(3 / 4), R.FARE: pytest.approx(3 / 2)}


def test_calibration(spark):
    rows = spark.createDataFrame([(0.1,), (0.25,), (0.9,)], "p double")
    got = rows.select(intent.calibrated_by_rule(F.col("p")), intent.calibrated_by_model(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(0.88, 0.45), (0.9, 0.45), (0.96, 0.92)]


def test_random_baseline_is_repeatable_and_in_range(spark):
    ids = spark.range(2000)
    first = intent.random_baseline(ids, "id").orderBy("id").collect()
    assert first == intent.random_baseline(ids.repartition(7), "id").orderBy("id").collect()
    assert {r["predicted_intent"] for r in first} == {i.name for i in R.taxonomy()}
    assert all(round(0.8 / 11, 2) <= r["intent_confidence"] <= round(1.5 / 11, 2) for r in first)


def test_training_is_disjoint_from_evaluation(spark):
    golden = frame(spark, [("  " + TEXTS[0][0].upper(), R.PICKUP), (TEXTS[5][0], R.REFUND)])
    result = jobs.train_and_evaluate(frame(spark, TEXTS * 2), golden)
    row = result.metrics.first()
    assert (row["train_size"], row["test_size"]) == (16, 2) and 0 <= row["accuracy"] <= 1 and 0 <= row["macro_f1"] <= 1


def test_topics(spark):
    rows = frame(spark, TEXTS * 3)
    settings = TfidfSettings(max_features=2500, min_df=3, sublinear_tf=False)
    topics = discover_topics(rows, clusters=3, terms=4, starts=2, settings=settings).collect()
    assert len({r["cluster"] for r in topics}) == 3
    for name in {r["cluster"] for r in topics}:
        mine = sorted((r for r in topics if r["cluster"] == name), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4]
        assert all(a["weight"] >= b["weight"] for a, b in zip(mine, mine[1:]))


def test_steps_come_near_the_solver_and_repeat_exactly(spark, with_partitions):
    """The same bits on any partitioning, and nearly the classes of the engine's own solver."""
    rows = frame(spark, [(f"{text} {extra}", label) for extra in ("today", "again", "it was late", "") for text, label in TEXTS])
    fitted = []
    for partitions in (1, 7):
        with_partitions(partitions)
        model = intent.IntentModel.fit(rows.repartition(partitions), steps=60)
        fitted.append((sorted(map(tuple, model.weights.select("term", F.col("coefficients").cast("string")).collect())), model.intercepts))
    assert fitted[0] == fitted[1]
    solved = intent.IntentModel.fit(rows)
    stepped, exact = ({r["conversation_id"]: r["distribution"] for r in m.class_distribution(rows, "conversation_id", "customer_message").collect()} for m in (model, solved))
    assert max(abs(stepped[i][label] - exact[i][label]) for i in exact for label in exact[i]) < 0.03


def test_optimum_leaves_no_slope_on_any_partitioning(spark, with_partitions):
    """The whole training ends at the optimum: the loss over all rows, worked out densely, has no slope left."""
    texts = [f"{text} {extra}" for extra in ("today", "again", "it was late", "") for text, _ in TEXTS]
    rows = frame(spark, [(text, TEXTS[i % len(TEXTS)][1]) for i, text in enumerate(texts)])
    fitted = []
    for partitions in (1, 7):
        with_partitions(partitions)
        model = intent.IntentModel.fit(rows.repartition(partitions), optimum=True)
        weights = model.weights.orderBy("term_id").collect()
        fitted.append(np.array([r["coefficients"] for r in weights] + [list(model.intercepts)]))
    assert np.abs(fitted[0] - fitted[1]).max() < 1e-9
    c, size = fitted[0], len(weights)
    x, labels, n = np.zeros((len(texts), size + 1)), [], rows.count()
    x[:, size] = 1.0
    ids = {r["conversation_id"]: i for i, r in enumerate(rows.collect())}
    for r in intent.weigh(rows, "conversation_id", "customer_message", model.weights.select("term", "term_id", "idf"), model.settings).collect():
        x[ids[r["conversation_id"]], r["term_id"]] = r["weight"]
    labels = np.array([model.labels.index(r["intent"]) for r in rows.collect()])
    weight = n / (len(model.labels) * np.bincount(labels)[labels])
    share = np.exp(x @ c)
    share /= share.sum(axis=1, keepdims=True)
    share[np.arange(n), labels] -= 1.0
    ridge = np.full((size + 1, 1), 1.0 / (intent.INVERSE_REGULARISATION * n))
    ridge[-1] = 0.0
    assert np.abs(x.T @ (weight[:, None] * share) / n + ridge * c).max() < 1e-11


def test_registered_training_goes_on_to_the_optimum(spark, monkeypatch):
    """The query's training is no fixed number of steps."""
    from registry import spark_queries

    calls = []
    own = frame(spark, TEXTS * 2)
    monkeypatch.setattr(spark_queries.inputs, "phrased", lambda *_: own.drop("intent"))
    monkeypatch.setattr(spark_queries, "label_conversations", lambda rows: rows.join(own.select("conversation_id", "intent"), "conversation_id"))
    monkeypatch.setattr(spark_queries.jobs, "build_golden", lambda rows, *_: rows.limit(1))
    monkeypatch.setattr(intent, "minimise", lambda *a, solve=intent.minimise: calls.append(a) or solve(*a))
    spark_queries._trained.cache_clear()
    try:
        rows = spark_queries.train_classifier(spark, "own rows")
        assert rows.columns == ["term", "label", "coefficient"] and rows.count() > 0
    finally:
        spark_queries._trained.cache_clear()
    assert len(calls) == 1 and calls[0][-1] == 1000  # rounds at most


def test_rounds_that_do_not_suffice_warn():
    scale = np.array([[1.0], [50.0]])

    def bowl(c):
        return float((scale * (c - 3) ** 2).sum() / 2 + (c ** 4).sum()), scale * (c - 3) + 4 * c ** 3

    with pytest.warns(UserWarning, match="did not converge"):
        descent.lbfgs(bowl, np.ones((2, 1)), 2)
    assert np.abs(bowl(descent.lbfgs(bowl, np.ones((2, 1)), 100))[1]).max() <= descent.STEEPEST


def test_sums_leave_a_task_in_time(spark, monkeypatch):
    """A task whose rows weigh a lot gives its sums away in several parts; nothing changes."""
    from carewise.operators import descent

    rng = random.Random(3)
    rows = spark.createDataFrame(
        [(rng.randrange(3), rng.uniform(0.2, 4.0), sorted(rng.sample(range(20), 3)) + [20], [rng.randrange(10**6) for _ in range(3)] + [10**6]) for _ in range(200)],
        "label int, weight double, at array<int>, x array<long>").repartition(2)
    whole = descent.descend(rows, 21, 3, 200.0, 0.01, 5)
    monkeypatch.setattr(descent, "MOST_WEIGHT", 3)
    assert (descent.descend(rows, 21, 3, 200.0, 0.01, 5) == whole).all() and whole.any()
    assert not descent.descend(rows.limit(0), 21, 3, 200.0, 0.01, 2).any()


@pytest.mark.parametrize("taken", [1, 7, 10**6])
def test_gradient_sums_in_pieces(monkeypatch, taken):
    """Rows are multiplied a bounded number of features at a time; the sums stay those of all rows."""
    longest, errors = [], descent.errors
    monkeypatch.setattr(descent, "TAKEN_FEATURES", taken)
    monkeypatch.setattr(descent, "errors", lambda margins, *rest: longest.append(len(margins)) or errors(margins, *rest))
    rng = np.random.default_rng(5)
    at = [[*sorted(rng.choice(20, rng.integers(0, 6), replace=False).tolist()), 20] for _ in range(60)]
    x = [rng.integers(1, 10**6, len(a)).tolist() for a in at]
    label, weight = rng.integers(0, 3, 60), rng.uniform(0.5, 2, 60)
    c = rng.integers(-10**9, 10**9, (21, 3))
    batch = pa.record_batch({"label": pa.array(label, pa.int32()), "weight": weight, "at": pa.array(at, pa.list_(pa.int32())), "x": pa.array(x, pa.list_(pa.int64()))})
    g = np.zeros(63, dtype=np.int64)
    for part in descent._sums(c)(iter([batch, batch.slice(0, 0), batch.slice(40)])):
        g[part.column("at").to_numpy()] += part.column("g").to_numpy()
    dense = np.zeros((60, 21), dtype=np.int64)
    for i in range(60):
        dense[i, at[i]] = x[i]
    dense, label, weight = (np.concatenate([v, v[40:]]) for v in (dense, label, weight))
    assert np.array_equal(g.reshape(21, 3), dense.T @ errors(dense @ c, label, weight))
    assert max(longest) <= max(1, taken)
