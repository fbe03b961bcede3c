"""The rule sets on the 29 phrases and on hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from carewise.functions import rulebook as R
from carewise.functions.cascade import found, guarded
from carewise.operators import audit, escalation, intent, judge, metrics, replies
from registry.inputs import PHRASES

SHORT = {
    "P": R.PICKUP, "F": R.FARE, "R": R.REFUND, "D": R.DRIVER, "L": R.LOST, "A": R.ACCOUNT,
    "Y": R.PAYMENT, "T": R.APP, "S": R.SAFETY, "O": R.ROUTE, "G": R.GENERAL, "-": None,
}
DECISIONS = {
    "E1": R.REASON_SAFETY, "E2": R.REASON_BILLING, "E3": R.REASON_ACCOUNT, "E4": R.REASON_CONDUCT,
    "E5": R.REASON_LOW_CONFIDENCE % "0.40", "A6p": R.REASON_PICKUP, "A6l": R.REASON_LOST, "A6r": R.REASON_ROUTINE,
}
# taxonomy, labeller, then decision and audit of intent and escalation on the keyword path and
# on the labeller path
EXPECTED = """
P P A6p PASS PASS A6p PASS PASS
- F E2 WARNING PASS E2 PASS PASS
F G E2 PASS PASS A6r PASS PASS
R R E2 PASS PASS E2 PASS PASS
D D E4 PASS PASS E4 PASS PASS
L L A6l PASS PASS A6l PASS PASS
A A E3 PASS PASS E3 PASS PASS
- A E5 PASS PASS E3 PASS PASS
Y Y A6r PASS PASS A6r PASS PASS
T G A6r FAIL FAIL A6r FAIL FAIL
S T E1 PASS PASS A6r FAIL FAIL
S G E1 PASS PASS E4 FAIL PASS
- S E1 PASS PASS E1 PASS PASS
O O A6r PASS PASS A6r PASS PASS
G G A6r PASS PASS A6r PASS PASS
- G E5 PASS PASS A6r PASS PASS
- G E5 PASS PASS A6r PASS PASS
A A E3 PASS PASS E3 PASS PASS
- G E5 PASS PASS A6r PASS PASS
P G A6p PASS PASS A6r PASS PASS
- T E5 PASS PASS A6r PASS PASS
S S E1 PASS PASS E1 PASS PASS
- A E3 PASS PASS E3 PASS PASS
D D E4 PASS PASS E4 PASS PASS
- G E2 WARNING PASS E2 WARNING PASS
- G E5 FAIL PASS A6r FAIL FAIL
L L E4 PASS WARNING E4 PASS WARNING
S S E1 PASS PASS E1 PASS PASS
S S E1 PASS PASS E1 PASS PASS
""".split("\n")[1:-1]


@pytest.fixture(scope="module")
def phrases(spark):
    return spark.createDataFrame(list(enumerate(PHRASES)), "i int, customer_message string")


def column(df, name):
    return [r[name] for r in df.orderBy("i").select(name).collect()]


def test_every_phrase_has_an_expectation():
    assert len(EXPECTED) == len(PHRASES)


def test_taxonomy_and_labeller(phrases):
    expected = [line.split() for line in EXPECTED]
    assert column(intent.with_rule_intent(phrases), "rule_intent") == [SHORT[e[0]] for e in expected]
    labelled = intent.label_conversations(phrases)
    assert column(labelled, "intent") == [SHORT[e[1]] for e in expected]
    by_intent = {rule.intent: rule for rule in R.label_rules()}
    for row in labelled.collect():
        rule = by_intent[row["intent"]]
        assert (row["escalation"], row["reply_keywords"], row["ground_truth_notes"]) == (rule.escalation, rule.reply_keywords, rule.notes)


@pytest.mark.parametrize("path, at", [("keyword", 2), ("labeller", 5)])
def test_escalation_and_audit_paths(phrases, path, at):
    if path == "keyword":
        classified = intent.keyword_baseline(phrases)
    else:
        classified = intent.label_conversations(phrases).select(
            "i", "customer_message", F.col("intent").alias("predicted_intent"), F.lit(0.85).alias("intent_confidence")
        )
    decided = escalation.escalate(classified)
    expected = [line.split()[at:at + 3] for line in EXPECTED]
    assert column(decided.select("i", "escalation.reason"), "reason") == [DECISIONS[e[0]] for e in expected]
    assert column(decided.select("i", "escalation.decision"), "decision") == [
        R.ESCALATE if e[0][0] == "E" else R.AUTO_HANDLE for e in expected
    ]
    audited = audit.audit_items(decided.withColumns({
        "conversation_id": F.col("i").cast("string"),
        "grounded_reply": F.lit("please ask our support team"),
        "influenced_by": F.array(F.lit("x")),
    }), keep=("i",))
    assert column(audited.select("i", "intent_review.status"), "status") == [e[1] for e in expected]
    assert column(audited.select("i", "escalation_review.status"), "status") == [e[2] for e in expected]


def test_alternatives_beside_non_word_characters(spark):
    """They need a word character on the other side, so plain uses do not match."""
    rows = spark.createDataFrame([(0, "service is 0* today"), (1, "service is 0*bad"), (2, "rated 10*x")], "i int, customer_message string")
    assert column(intent.label_conversations(rows), "intent") == [R.GENERAL, R.DRIVER, R.GENERAL]
    reply = spark.createDataFrame(
        [(0, "a $50 credit from our team"), (1, "US$50 credit from our team"), (2, "one free ride, our team says"), (3, "call 1-800 team now please")],
        "i int, reply string")
    reviewed = reply.select("i", audit.grounding_review(F.col("reply"), F.array(F.lit("x")))["status"].alias("s"))
    assert column(reviewed, "s") == ["PASS", "FAIL", "FAIL", "FAIL"]


def test_guard_keeps_every_match():
    patterns = [i.regex for i in R.taxonomy()] + [r.pattern for r in R.label_rules() if r.pattern]
    patterns += [getattr(R, name) for name in dir(R) if isinstance(getattr(R, name), str) and getattr(R, name).startswith(r"\b(")]
    assert sum(guarded(p) != p for p in patterns) > 20 and guarded(R.AUDIT_BANNED) == R.AUDIT_BANNED
    words = sorted({w for p in patterns for w in re.findall(r"[a-z0-9'$*-]+", p)} | {"$12", "20", "x", "über", "safetyx"})
    rng = random.Random(3)
    texts = list(PHRASES) + [" ".join(rng.choices(words, k=8)) for _ in range(3000)]
    texts += [alternative for p in patterns for alternative in re.sub(r"[()?\\b]", "", p).split("|")]
    for pattern in patterns:
        plain, quick = re.compile(pattern), re.compile(guarded(pattern))
        assert [bool(plain.search(t)) for t in texts] == [bool(quick.search(t)) for t in texts]


@pytest.mark.parametrize("pattern", [r"\b(a?b|c)\b", r"\b(a|(b|c)d)\b", r"\b(a|)\b", r"\b[ab]\b", "(?i)word", r"\b(a)|(b)\b", r"\b(a|\$5)\b"])
def test_guard_leaves_other_forms_alone(pattern):
    assert guarded(pattern) == pattern


def test_guard_form():
    assert guarded(r"\b(ab|c(d|e)?|a\|f)\b") == r"\b(?=[ac])(ab|c(d|e)?|a\|f)\b"


def test_word_edges_are_unicode(spark):
    rows = spark.createDataFrame([(0, "cafésafety first"), (1, "safety first"), (2, "SAFETY!")], "i int, customer_message string")
    assert column(intent.with_rule_intent(rows), "rule_intent") == [None, R.SAFETY, R.SAFETY]


def test_own_taxonomy(spark):
    own = (
        R.Intent("Billing", "d", ("bill",), r"\b(bill|invoice)\b", R.ESCALATE, "HIGH"),
        R.Intent("Other", "d", (), r"\b(bill)\b", R.AUTO_HANDLE, "LOW"),
    )
    assert intent.intents_from_table(intent.taxonomy_table(spark, own)) == own
    rows = spark.createDataFrame([(0, "my bill"), (1, "hello")], "i int, m string")
    matched = rows.select("i", intent.rule_intent(F.lower("m"), own, first="Other").alias("r"))
    assert column(matched, "r") == ["Other", None]


def test_brand_is_a_parameter():
    general = next(i for i in R.taxonomy("Acme") if i.name == R.GENERAL)
    assert "is acme available" in general.regex and "AcmeEats" in general.description


def test_escalation_cases(spark):
    cases = [
        ("he assaulted nobody but there was an accident", R.GENERAL, 0.98, 0.55, R.ESCALATE, "safety", 0.98),
        ("hello there", R.FARE, 0.9, 0.55, R.ESCALATE, "billing", 0.94),
        ("where is my driver", R.PICKUP, 0.88, 0.55, R.AUTO_HANDLE, "standard", 0.92),
        ("hm", R.GENERAL, 0.45, 0.60, R.ESCALATE, "low classification confidence (0.45)", 0.75),
        ("hm", R.GENERAL, 0.60, 0.60, R.AUTO_HANDLE, "workflows", 0.88),
        ("hm", "Unlisted", 0.9, 0.55, R.AUTO_HANDLE, "protocols", 0.80),
        ("he threatened me", R.LOST, 0.9, 0.55, R.ESCALATE, "conduct", 0.89),
        ("a threat", R.LOST, 0.9, 0.55, R.ESCALATE, "safety", 0.98),
    ]
    rows = spark.createDataFrame(cases, "customer_message string, predicted_intent string, intent_confidence double, t double, d string, r string, c double")
    for threshold in (0.55, 0.60):
        for row in escalation.escalate(rows.filter(F.col("t") == threshold), low_confidence=threshold).collect():
            got = row["escalation"]
            assert (got["decision"], got["confidence"]) == (row["d"], row["c"]) and row["r"] in got["reason"]


def test_replies(spark):
    hits = spark.createDataFrame(
        [("a", 1, "H1", 0.125, " Thanks, we will look "), ("a", 2, "H2", 0.1, "x"), ("b", 1, "H1", 0.55, "Done!"), ("c", 1, "H3", 0.5, "ok")],
        "conversation_id_asked string, rank int, conversation_id string, similarity_score double, support_reply string")
    rows = spark.createDataFrame(
        [("a", R.GENERAL, R.AUTO_HANDLE), ("b", R.PICKUP, R.AUTO_HANDLE), ("c", R.SAFETY, R.ESCALATE), ("d", R.GENERAL, None)],
        "conversation_id string, predicted_intent string, decision string",
    ).select("conversation_id", "predicted_intent", F.struct("decision").alias("escalation"))
    got = {r["conversation_id"]: r for r in replies.ground_replies(rows, hits).collect()}
    assert got["a"]["grounded_reply"] == "Thanks, we will look." and got["a"]["is_grounded"]
    assert [c["conversation_id"] for c in got["a"]["influenced_by"]] == ["H1", "H2"]
    assert got["a"]["grounding_rationale"].endswith("H1 (similarity score: 0.1250).")
    assert got["b"]["grounded_reply"] == R.REPLY_PICKUP and "H1 (sim: 0.55)" in got["b"]["grounding_rationale"]
    assert got["c"]["grounded_reply"] == R.REPLY_SAFETY
    assert not got["d"]["is_grounded"] and got["d"]["influenced_by"] == [] and "direct message" in got["d"]["grounded_reply"]


def scored_row(**changes):
    row = {
        "conversation_id": "1", "customer_message": "my driver never arrived", "predicted_intent": R.PICKUP, "intent_confidence": 0.9,
        "escalation": (R.AUTO_HANDLE, "r", 0.9), "grounded_reply": "We are sorry, please send us a DM.", "influenced_by": [("H", 0.5, "x...")],
        "grounding_rationale": "g", "is_grounded": True, "ground_truth_intent": R.PICKUP, "ground_truth_escalation": R.AUTO_HANDLE,
        "expected_reply_keywords": None,
    }
    row.update(changes)
    return tuple(row.values())


def scored(spark, *rows):
    from carewise.sources.schemas import SCORED

    return spark.createDataFrame(list(rows), SCORED)


def test_audit_item_and_defaults(spark):
    items = {r["conversation_id"]: r for r in audit.audit_items(scored(
        spark,
        scored_row(),
        scored_row(conversation_id="2", customer_message="the police came, i was assaulted", predicted_intent=R.GENERAL),
        scored_row(conversation_id=None, intent_confidence=None, escalation=None, influenced_by=None),
        scored_row(conversation_id="4", predicted_intent=None, grounded_reply=None),
    )).collect()}
    assert (items["1"]["item_verdict"], items["1"]["item_score"]) == ("PASS", 10.0)
    assert (items["2"]["item_verdict"], items["2"]["item_score"]) == ("FAIL", 3.7)
    assert items["2"]["escalation_review"]["status"] == "FAIL"
    assert items["UNKNOWN"]["intent_review"]["status"] == "PASS"
    assert items["UNKNOWN"]["grounding_review"]["reason"] == R.AUDIT_NO_CITATION and items["UNKNOWN"]["item_score"] == 8.95
    assert items["4"]["intent_review"]["reason"] == "Predicted intent '' is not in approved taxonomy."
    assert items["4"]["grounding_review"]["reason"] == R.AUDIT_NO_REPLY


def test_audit_rollup(spark):
    bad = scored_row(conversation_id="b", customer_message="an accident", predicted_intent=R.GENERAL)
    clean = [scored_row(conversation_id=str(i)) for i in range(19)]
    one_in_twenty = audit.audit_rollup(audit.audit_items(scored(spark, bad, *clean))).first()
    assert (one_in_twenty["audit_status"], one_in_twenty["discrepancies"], one_in_twenty["intent_review"]) == ("APPROVED", 1, "WARNING")
    assert one_in_twenty["overall_score"] == 9.7 and one_in_twenty["reviewer_notes"] == R.AUDIT_APPROVED_NOTE
    one_in_two = audit.audit_rollup(audit.audit_items(scored(spark, bad, clean[0]))).first()
    assert (one_in_two["audit_status"], one_in_two["escalation_review"], one_in_two["grounding_review"]) == ("FLAGGED", "FAIL", "PASS")
    assert one_in_two["reviewer_notes"] == R.AUDIT_FLAGGED_NOTE % 1
    empty = audit.audit_items(scored(spark, bad)).limit(0)
    assert audit.audit_rollup(empty, ["item_verdict"]).count() == 0
    with pytest.raises(Exception, match="empty review batch"):
        audit.audit_rollup(empty).collect()
    assert [r["conversation_id"] for r in audit.sample_audits(audit.audit_items(scored(spark, *clean))).collect()] == ["0", "1", "10", "11", "12"]


def test_judge(spark):
    rows = judge.judge_replies(scored(
        spark,
        scored_row(),
        scored_row(conversation_id="2", grounded_reply="Ok.", ground_truth_intent=R.LOST, influenced_by=[]),
        scored_row(conversation_id="3", customer_message="unsafetyish", grounded_reply="only an idiot calls 1-800 numbers at night"),
    ))
    got = {r["conversation_id"]: r for r in rows.collect()}
    assert [got["1"][c] for c in judge.CRITERIA] == [5.0] * 7 and got["1"]["average_score"] == 5.0
    assert [got["2"][c] for c in judge.CRITERIA] == [2.0, 3.5, 3.0, 5.0, 4.8, 5.0, 5.0] and got["2"]["average_score"] == 4.04
    assert [got["3"][c] for c in judge.CRITERIA] == [5.0, 5.0, 4.0, 1.0, 4.8, 2.0, 1.0]
    assert got["3"]["feedback"].startswith("Response demonstrates high professionalism (1.0/5) and strong groundedness (5.0/5).")
    means = judge.judge_means(rows).first()
    assert means["mean_correctness"] == 4.0 and means["mean_tone"] == 4.87


def test_failures(spark):
    rows = scored(
        spark,
        scored_row(),
        scored_row(conversation_id="2", ground_truth_intent=R.LOST),
        scored_row(conversation_id="3", ground_truth_escalation=R.ESCALATE),
        scored_row(conversation_id="4", ground_truth_intent=None, ground_truth_escalation=None),
        scored_row(conversation_id="5", predicted_intent=None),
    )
    got = {r["conversation_id"]: r["reason"] for r in metrics.failure_cases(rows).collect()}
    assert got == {"2": R.FAILURE_INTENT, "3": R.FAILURE_ESCALATION, "5": R.FAILURE_INTENT}
    assert [r["conversation_id"] for r in metrics.top_failures(rows, 2).collect()] == ["2", "3"]


@pytest.mark.parametrize("text", ["\u26a0\ufe0fpolice came", "police\ufe0f came", "\u200dpolice came", "e\u0301 police\u0301 came"])
def test_marks_and_joiners_are_word_edges(spark, text):
    one = spark.createDataFrame([(text,)], "t string").select(found(F.col("t"), R.ESCALATION_SAFETY).alias("hit"))
    assert one.first()["hit"]


def test_own_patterns_match_in_either_case(spark):
    one = spark.createDataFrame([("my bag is LOST".lower(),)], "t string")
    assert one.select(found(F.col("t"), r"\b(Bag|Case) is LOST\b").alias("hit")).first()["hit"]


def test_another_brand_has_its_own_rules(spark):
    messages = spark.createDataFrame([("1", "is acme available in town"), ("2", "charges from acme")], "conversation_id string, customer_message string")
    own = intent.KeywordModel(brand="Acme").classify(messages, "conversation_id", "customer_message").orderBy("conversation_id")
    assert own.first()["intent_confidence"] == 0.85
    assert intent.KeywordModel().classify(messages, "conversation_id", "customer_message").orderBy("conversation_id").first()["intent_confidence"] == 0.4
    labels = {r["conversation_id"]: r["intent"] for r in intent.label_conversations(messages, brand="Acme").collect()}
    assert labels["2"] == R.FARE != intent.label_conversations(messages).filter("conversation_id = '2'").first()["intent"]
