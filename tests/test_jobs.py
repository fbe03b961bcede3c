import json

import pytest
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.operators.intent import KeywordModel
from carewise.operators.retrieval import ConversationIndex
from carewise.plans import jobs
from carewise.sources import tables
from carewise.streaming.monitor import audit_windows, start_monitor
from carewise.streaming.scoring import read_scored_stream, score_and_audit, start_scoring
from registry import inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def phrased(spark):
    return inputs.phrased(spark, SF)


@pytest.fixture(scope="module")
def index(spark):
    return ConversationIndex.fit(inputs.pairs(spark, SF)).laid_out()


def test_golden_set(spark, phrased):
    golden = jobs.build_golden(phrased, 20)
    assert golden.columns == ["conversation_id", "customer_message", "intent", "escalation", "reply_keywords", "ground_truth_notes"]
    assert sorted(r[0] for r in golden.select("conversation_id").collect()) == [f"GOLDEN_{i:03d}" for i in range(1, 21)]


def test_conversation_target(spark):
    sample = jobs.build_conversations(inputs.tweets(spark, SF), inputs.BRAND_ACCOUNT, target=10, id_prefix="X")
    assert sorted(r[0] for r in sample.select("conversation_id").collect()) == [f"X_{i:04d}" for i in range(1, 11)]


def test_scoring_carries_truth_only_if_present(spark, phrased, index):
    plain = jobs.score_messages(phrased, KeywordModel(), index, limit=5)
    assert plain.count() == 5 and "ground_truth_intent" not in plain.columns
    labelled = jobs.label_conversations(phrased)
    full = jobs.score_messages(labelled, KeywordModel(), index)
    assert full.count() == phrased.count()
    assert {"ground_truth_intent", "ground_truth_escalation", "expected_reply_keywords"} <= set(full.columns)
    for row in full.collect():
        cited = [c["similarity_score"] for c in row["influenced_by"]]
        assert len(cited) <= 3 and cited == sorted(cited, reverse=True) and row["is_grounded"] == bool(cited)


def test_scored_json_and_review_batch(spark, phrased, index, tmp_path):
    scored = jobs.score_messages(jobs.label_conversations(phrased), KeywordModel(), index)
    written = tables.write_review_batch(scored, str(tmp_path / "batch"))
    assert sorted(map(str, written.collect())) == sorted(map(str, scored.select(written.columns).collect()))
    manifest = json.loads(spark.read.text(str(tmp_path / "batch" / "metadata")).first()[0])
    assert manifest["records_count"] == scored.count() and manifest["source"] == "Primary Agent"
    tables.write_metrics(jobs.audit_batch(written), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["total_reviewed"] == scored.count()


def test_evaluation_rows(spark):
    rows = jobs.evaluate(inputs.scored_table(spark, SF)).collect()
    sections = {r["section"] for r in rows}
    assert sections == {"dataset", "main_agent", "escalation_policy", "judge", "baseline_1_random", "baseline_2_keyword"}
    assert len({(r["section"], r["metric"]) for r in rows}) == len(rows)


def test_stream_equals_batch(spark, phrased, index, tmp_path):
    messages = phrased.select("conversation_id", "customer_message")
    messages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    start_scoring(stream, KeywordModel(), index, out, str(tmp_path / "state")).awaitTermination()
    written = read_scored_stream(spark, out)
    assert written.select("batch_id").distinct().count() == 3
    assert sorted(p.name for p in tmp_path.glob("state-scratch/*")) == ["hits", "query-vectors"]
    expected = score_and_audit(messages, KeywordModel(), index)
    assert sorted(map(str, written.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    # a restart finds nothing new and writes nothing twice
    start_scoring(stream, KeywordModel(), index, out, str(tmp_path / "state")).awaitTermination()
    assert read_scored_stream(spark, out).count() == expected.count()


def test_monitor_equals_batch_on_closed_windows(spark, tmp_path):
    events = inputs.table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    out = str(tmp_path / "out")
    start_monitor(inputs.event_items(stream), out, str(tmp_path / "state")).awaitTermination()
    latest = events.agg(F.max("ts")).first()[0]
    batch = audit_windows(inputs.event_items(events))
    closed = batch.filter(F.col("window_end") <= F.lit(latest) - F.expr("INTERVAL 10 MINUTES"))
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(batch.columns).collect())) == sorted(map(tuple, closed.collect()))
    assert got.count() >= batch.count() - 2 and got.filter(F.col("audit_status") == "FLAGGED").count() > 0


def test_taxonomy_export(spark, phrased, tmp_path):
    jobs.export_taxonomy(phrased, str(tmp_path / "t"), clusters=3, starts=1)
    assert spark.read.json(str(tmp_path / "t" / "intents")).count() == 11
    assert spark.read.json(str(tmp_path / "t" / "clusters")).select("cluster").distinct().count() == 3
    assert tuple(spark.read.json(str(tmp_path / "t" / "meta")).select("total_intents", "source_conversations").first()) == (11, phrased.count())


def test_own_classifier_fits_the_scoring_job(spark, phrased, index):
    class Always:
        def classify(self, messages, key, text):
            return messages.withColumns({"predicted_intent": F.lit(R.LOST), "intent_confidence": F.lit(0.9)})

    scored = jobs.score_messages(phrased, Always(), index)
    assert {r[0] for r in scored.select("predicted_intent").distinct().collect()} == {R.LOST}
