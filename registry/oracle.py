"""The same results in SQL for an independent engine.

Only the fixed values (patterns, texts, scores) are shared with the Spark side; every
query is stated again in SQL. The engine's regular expressions know word characters and
blanks as ASCII only, so word edges and spaces are written as explicit classes.
"""

from __future__ import annotations

from carewise.functions import rulebook as R
from carewise.functions.text import SPACES
from registry import training_sql
from registry.inputs import FAULTS, PHRASES, REPLY_FAULTS

SEED = 42
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def edged(pattern: str) -> str:
    """A pattern of the form \\b(...)\\b with explicit word edges."""
    assert pattern.startswith(r"\b(") and pattern.endswith(r")\b")
    return f"(^|{NOT_W}){pattern[2:-2]}($|{NOT_W})"


def found(text: str, pattern: str) -> str:
    """Whether a rule pattern occurs; alternatives next to non-word characters are spelt out."""
    if r"|0\*|" in pattern:  # an edge after the star needs a word character there
        return f"(regexp_matches({text}, {q(edged(pattern.replace('|0' + chr(92) + '*|', '|')))}) OR regexp_matches({text}, {q(f'(^|{NOT_W})0[*]{W}')}))"
    return f"regexp_matches({text}, {q(edged(pattern))})"


# Hand-written forms of the audit patterns: "x.*" reaches the end of its word at least, so it
# is a word beginning; the dollar amount needs a word character before it.
AUDIT_SAFETY = f"(^|{NOT_W})((safety|police|drunk|intoxicated|accident|danger|scared|emergency)($|{NOT_W})|threat|harass|assault|crash)"
AUDIT_BANNED = f"(^|{NOT_W})(1-800|free ride|guaranteed refund within 1 hour)($|{NOT_W})|{W}[$]50 credit($|{NOT_W})"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def clean(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(replace({text}, chr(65533), ''''), "
        f"'https?://[^{SPACES}]+', '', 'g'), '@[A-Za-z0-9_]+', '', 'g'), '[{SPACES}]+', ' ', 'g'))"
    )


PAIRS = f"""
pairs AS (
  SELECT CAST(a.conv_id * 100 + a.turn AS VARCHAR) AS conversation_id,
         u.conv_id * 100 + u.turn AS customer_tweet_id,
         a.conv_id * 100 + a.turn AS support_tweet_id,
         u.conv_id * 8 + u.turn AS number,
         {clean('u.text')} AS customer_message,
         {clean('a.text')} AS support_reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

VALID = (
    "length(customer_message) >= {n} AND length(support_reply) >= {n} "
    "AND regexp_matches(customer_message, '[a-zA-Z]{{3,}}') AND regexp_matches(support_reply, '[a-zA-Z]{{3,}}') "
    f"AND lower(customer_message) NOT IN ({listed(R.DENIED_MESSAGES)})"
)

PHRASED = PAIRS + f""",
phrased AS (
  SELECT conversation_id, customer_tweet_id, support_tweet_id,
         ([{listed(PHRASES)}])[number % {len(PHRASES)} + 1] || ' ' || customer_message AS customer_message,
         support_reply, number % {FAULTS} AS fault
  FROM pairs
)"""


def rule_case(low: str) -> str:
    rules = R.taxonomy()
    first = [i for i in rules if i.name == "Safety Concern"]
    arms = " ".join(f"WHEN {found(low, i.regex)} THEN {q(i.name)}" for i in first + list(rules))
    return f"CASE {arms} END"


def label_case(low: str, field: str) -> str:
    rules = R.label_rules()
    arms = " ".join(f"WHEN {found(low, r.pattern)} THEN {q(getattr(r, field))}" for r in rules if r.pattern)
    return f"CASE {arms} ELSE {q(getattr(rules[-1], field))} END"


def labelled(source: str, name: str = "labelled") -> str:
    low = "lower(customer_message)"
    return f"""
{name} AS (
  SELECT *, {label_case(low, 'intent')} AS intent, {label_case(low, 'escalation')} AS escalation,
         {label_case(low, 'reply_keywords')} AS reply_keywords, {label_case(low, 'notes')} AS ground_truth_notes
  FROM {source}
)"""


BILLING = listed(R.BILLING_INTENTS)


def escalation_arms() -> list[tuple[str, str, str, float]]:
    low = "lower(customer_message)"
    low_reason = "'Ambiguous customer inquiry with low classification confidence (' || printf('%.2f', intent_confidence) || ') requiring human clarification.'"
    return [
        (f"predicted_intent = 'Safety Concern' OR {found(low, R.ESCALATION_SAFETY)}", "ESCALATE", q(R.REASON_SAFETY), 0.98),
        (f"predicted_intent IN ({BILLING}) OR {found(low, R.ESCALATION_BILLING)}", "ESCALATE", q(R.REASON_BILLING), 0.94),
        (f"predicted_intent = 'Account Access / Security' OR {found(low, R.ESCALATION_ACCOUNT)}", "ESCALATE", q(R.REASON_ACCOUNT), 0.92),
        (f"predicted_intent = 'Driver Complaint' OR {found(low, R.ESCALATION_CONDUCT)}", "ESCALATE", q(R.REASON_CONDUCT), 0.89),
        ("intent_confidence < 0.55", "ESCALATE", low_reason, 0.75),
        ("predicted_intent = 'Pickup Problem'", "AUTO_HANDLE", q(R.REASON_PICKUP), 0.92),
        ("predicted_intent = 'Lost Item'", "AUTO_HANDLE", q(R.REASON_LOST), 0.93),
        (f"predicted_intent IN ({listed(R.ROUTINE_INTENTS)})", "AUTO_HANDLE", q(R.REASON_ROUTINE), 0.88),
        ("TRUE", "AUTO_HANDLE", q(R.REASON_OTHER), 0.80),
    ]


def escalated(source: str, name: str) -> str:
    """The arm's number first, so that each pattern is stated once."""
    arms = escalation_arms()
    number = "CASE " + " ".join(f"WHEN {cond} THEN {i}" for i, (cond, *_r) in enumerate(arms)) + " END"

    def pick(values) -> str:
        return "CASE arm " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    return f"""
{name}_arm AS (SELECT *, {number} AS arm FROM {source}),
{name} AS (
  SELECT * EXCLUDE (arm), {pick(q(a[1]) for a in arms)} AS decision, {pick(a[2] for a in arms)} AS reason,
         CAST({pick(a[3] for a in arms)} AS DOUBLE) AS decision_confidence
  FROM {name}_arm
)"""


DECIDED = PHRASED + f""",
blanked AS (
  SELECT * REPLACE (CASE WHEN fault BETWEEN 30 AND 32 THEN ' ' ELSE customer_message END AS customer_message) FROM phrased
),""" + labelled("blanked") + f""",
matched AS (
  SELECT conversation_id, support_tweet_id, customer_message, support_reply, fault,
         CASE WHEN fault NOT BETWEEN 33 AND 35 THEN intent END AS ground_truth_intent,
         CASE WHEN fault NOT BETWEEN 33 AND 35 THEN escalation END AS ground_truth_escalation,
         {rule_case('lower(customer_message)')} AS rule, trim(customer_message) = '' AS blank
  FROM labelled
),
classified AS (
  SELECT * EXCLUDE (rule, blank),
         CASE WHEN fault <= 2 THEN 'Unlisted' ELSE coalesce(rule, 'General Inquiry') END AS predicted_intent,
         CAST(CASE WHEN fault <= 2 THEN 0.85 WHEN blank THEN 0.5 WHEN rule IS NOT NULL THEN 0.85 ELSE 0.4 END AS DOUBLE) AS intent_confidence
  FROM matched
),""" + escalated("classified", "decided")


def rationale(text: str) -> str:
    """A fixed rationale as an SQL expression over best_id and best_score."""
    parts = q(R.for_brand(text))
    for mark, value in (("%1$s", "best_id"), ("%2$s", "printf('%.2f', best_score)"), ("%3$s", "printf('%.4f', best_score)")):
        parts = parts.replace(mark, f"' || {value} || '")
    return parts


def reply_arms() -> list[tuple[str, str, str]]:
    adapted = "CASE WHEN regexp_matches(best_reply, '[.!?]$') THEN best_reply ELSE best_reply || '.' END"

    def arm(cond: str, reply: str, text: str) -> tuple[str, str, str]:
        return cond, reply if reply is adapted else q(R.for_brand(reply)), rationale(text)

    handed = "decision = 'ESCALATE'"
    return [
        arm("best_id IS NULL", R.REPLY_NO_EVIDENCE, R.RATIONALE_NO_EVIDENCE),
        arm(f"{handed} AND predicted_intent = 'Safety Concern'", R.REPLY_SAFETY, R.RATIONALE_SAFETY),
        arm(f"{handed} AND predicted_intent IN ({BILLING})", R.REPLY_BILLING, R.RATIONALE_BILLING),
        arm(f"{handed} AND predicted_intent = 'Account Access / Security'", R.REPLY_ACCOUNT, R.RATIONALE_ACCOUNT),
        arm(handed, R.REPLY_ESCALATED, R.RATIONALE_ESCALATED),
        arm("predicted_intent = 'Pickup Problem'", R.REPLY_PICKUP, R.RATIONALE_PICKUP),
        arm("predicted_intent = 'Lost Item'", R.REPLY_LOST, R.RATIONALE_LOST),
        arm("predicted_intent = 'Payment Failure'", R.REPLY_PAYMENT, R.RATIONALE_PAYMENT),
        arm("predicted_intent = 'App Technical Issue'", R.REPLY_APP, R.RATIONALE_APP),
        arm("TRUE", adapted, R.RATIONALE_ADAPTED),
    ]


def replied(source: str, hits: str, name: str) -> str:
    """Replies from (query_id, rank, conversation_id, similarity_score, support_reply) hits."""
    arms = reply_arms()
    number = "CASE " + " ".join(f"WHEN {cond} THEN {i}" for i, (cond, *_r) in enumerate(arms)) + " END"

    def pick(at: int) -> str:
        return "CASE arm " + " ".join(f"WHEN {i} THEN {a[at]}" for i, a in enumerate(arms)) + " END"

    return f"""
{name}_hits AS (
  SELECT query_id, first(conversation_id ORDER BY rank) AS best_id, first(similarity_score ORDER BY rank) AS best_score,
         first(trim(support_reply) ORDER BY rank) AS best_reply, count(*) AS citations,
         string_agg(conversation_id, ',' ORDER BY rank) AS cited,
         string_agg(substr(support_reply, 1, 120) || '...', '|' ORDER BY rank) AS snippets
  FROM {hits} GROUP BY query_id
),
{name}_arm AS (
  SELECT d.*, h.* EXCLUDE (query_id), {number} AS arm FROM {source} d LEFT JOIN {name}_hits h ON h.query_id = d.conversation_id
),
{name} AS (
  SELECT * EXCLUDE (arm, cited, snippets, citations, best_score), {pick(1)} AS grounded_reply, {pick(2)} AS grounding_rationale,
         best_id IS NOT NULL AS is_grounded, coalesce(cited, '') AS cited, coalesce(snippets, '') AS snippets,
         coalesce(citations, 0) AS citations, coalesce(best_score, 0.0) AS best_score
  FROM {name}_arm
)"""


OWN_HITS = """
own_hits AS (
  SELECT conversation_id AS query_id, r AS rank, 'H' || conversation_id || '_' || r AS conversation_id,
         round(round(CAST(0.15 AS DOUBLE) + (length(support_reply) % 80) / CAST(100 AS DOUBLE), 4) / r, 4) AS similarity_score,
         support_reply
  FROM blanked, (SELECT unnest([1, 2]) AS r)
  WHERE (r = 1 OR support_tweet_id % 2 = 0) AND fault NOT BETWEEN 9 AND 11 AND fault NOT BETWEEN 30 AND 32
)"""

SCORED = DECIDED + "," + OWN_HITS + "," + replied("decided", "own_hits", "grounded") + f""",
scored AS (
  SELECT * REPLACE (
    CASE WHEN fault BETWEEN 3 AND 5 THEN 'AUTO_HANDLE' WHEN fault BETWEEN 27 AND 29 THEN lower(decision) ELSE decision END AS decision,
    CAST(CASE WHEN fault BETWEEN 6 AND 8 THEN 0.35 ELSE intent_confidence END AS DOUBLE) AS intent_confidence,
    CASE {' '.join(f'WHEN fault BETWEEN {a} AND {b} THEN {q(t)}' for a, b, t in REPLY_FAULTS)} ELSE grounded_reply END AS grounded_reply
  )
  FROM grounded
)"""

FLAT_SCORED = """SELECT conversation_id, customer_message, predicted_intent, intent_confidence, decision, reason,
  decision_confidence, grounded_reply, cited, snippets, best_score, grounding_rationale, is_grounded,
  ground_truth_intent, ground_truth_escalation FROM """


def _arm_table(name: str, source: str, arms: list[tuple[str, str, str, int]]) -> str:
    number = "CASE " + " ".join(f"WHEN {cond} THEN {i}" for i, (cond, *_r) in enumerate(arms)) + " END"

    def pick(values) -> str:
        return "CASE arm " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    return f"""
{name}_arm AS (SELECT *, {number} AS arm FROM {source}),
{name} AS (
  SELECT conversation_id, {pick(q(a[1]) for a in arms)} AS status, {pick(a[2] for a in arms)} AS reason, {pick(a[3] for a in arms)} AS tenths
  FROM {name}_arm
)"""


def around(before: str, value: str, after: str) -> str:
    return f"{q(before)} || {value} || {q(after)}"


_low = "lower(customer_message)"
_reply_low = "lower(grounded_reply)"
_safety = f"regexp_matches({_low}, {q(AUDIT_SAFETY)})"
_billing = f"(predicted_intent IN ({BILLING}) OR {found(_low, R.AUDIT_BILLING)})"
_safe_any = f"(predicted_intent = 'Safety Concern' OR {_safety})"

REVIEWS = _arm_table("intent_review", "scored", [
    (f"predicted_intent NOT IN ({listed(i.name for i in R.taxonomy())})", "FAIL",
     around("Predicted intent '", "predicted_intent", "' is not in approved taxonomy."), 0),
    (f"{_safety} AND predicted_intent <> 'Safety Concern'", "FAIL",
     around("Message contains high-risk safety signals but was classified as '", "predicted_intent", "'."), 20),
    (f"{found(_low, R.AUDIT_DISPUTE)} AND predicted_intent NOT IN ({BILLING})", "WARNING",
     around("Message expresses clear financial dispute but was labeled '", "predicted_intent", "'."), 60),
    ("intent_confidence < 0.40", "WARNING",
     around("Model exhibited very low confidence (", "printf('%.2f', intent_confidence)", ") on intent classification."), 65),
    ("TRUE", "PASS", q(R.AUDIT_INTENT_OK), 100),
]) + "," + _arm_table("escalation_review", "scored", [
    (f"upper(decision) <> 'ESCALATE' AND {_safe_any}", "FAIL", q(R.AUDIT_SAFETY_NOT_ESCALATED), 0),
    (f"upper(decision) <> 'ESCALATE' AND {_billing}", "FAIL", q(R.AUDIT_BILLING_NOT_ESCALATED), 30),
    (f"upper(decision) = 'ESCALATE' AND predicted_intent IN ('Lost Item', 'Pickup Problem') AND NOT {_safe_any} AND NOT {_billing}", "WARNING",
     around("Inquiry for ", "predicted_intent", " could have been auto-handled via standard self-service."), 75),
    ("TRUE", "PASS", q(R.AUDIT_ESCALATION_OK), 100),
]) + "," + _arm_table("grounding_review", "scored", [
    ("length(trim(grounded_reply)) < 15", "FAIL", q(R.AUDIT_NO_REPLY), 0),
    (f"regexp_matches({_reply_low}, {q(AUDIT_BANNED)})", "FAIL", q(R.AUDIT_PROMISE), 10),
    (f"NOT {found(_reply_low, R.AUDIT_HELPFUL)}", "WARNING", q(R.AUDIT_TONE), 60),
    ("citations = 0", "WARNING", q(R.AUDIT_NO_CITATION), 65),
    ("TRUE", "PASS", q(R.AUDIT_GROUNDING_OK), 100),
]) + """,
items AS (
  SELECT s.conversation_id, s.predicted_intent,
         CASE WHEN 'FAIL' IN (i.status, e.status, g.status) THEN 'FAIL'
              WHEN 'WARNING' IN (i.status, e.status, g.status) THEN 'WARNING' ELSE 'PASS' END AS item_verdict,
         CAST(((i.tenths * 35 + e.tenths * 35 + g.tenths * 30 + 5) // 10) / 100 AS DOUBLE) AS item_score,
         (i.tenths * 35 + e.tenths * 35 + g.tenths * 30 + 5) // 10 AS hundredths,
         i.status AS intent_status, e.status AS escalation_status, g.status AS grounding_status
  FROM scored s JOIN intent_review i USING (conversation_id) JOIN escalation_review e USING (conversation_id)
  JOIN grounding_review g USING (conversation_id)
)"""

AUDITED = SCORED + "," + REVIEWS


def rollup(source: str, by: str = "") -> str:
    """The acceptance report from (verdict, hundredths, three statuses)."""
    return f", {rollup_counts(source, by)} {report(by)}"


def rollup_counts(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
counts AS (
  SELECT {keys}count(*) AS total_reviewed, CAST(sum(hundredths) AS BIGINT) AS s,
         count(*) FILTER (item_verdict = 'FAIL') AS discrepancies,
         count(*) FILTER (intent_status = 'FAIL') AS intent_failures,
         count(*) FILTER (escalation_status = 'FAIL') AS escalation_failures,
         count(*) FILTER (grounding_status = 'FAIL') AS grounding_failures
  FROM {source} {group}
),
gated AS (
  SELECT *, (s * 2 + total_reviewed * 10) // (total_reviewed * 20) AS tenths FROM counts
)"""


def report(by: str = "") -> str:
    keys = f"{by}, " if by else ""

    def status(count: str, percent: int) -> str:
        return f"CASE WHEN {count} * 100 > total_reviewed * {percent} THEN 'FAIL' WHEN {count} > 0 THEN 'WARNING' ELSE 'PASS' END"

    return f"""
SELECT {keys}CASE WHEN tenths >= 85 AND discrepancies * 100 <= total_reviewed * 5 THEN 'APPROVED' ELSE 'FLAGGED' END AS audit_status,
       {status('intent_failures', 10)} AS intent_review, {status('grounding_failures', 5)} AS grounding_review,
       {status('escalation_failures', 5)} AS escalation_review, CAST(tenths / 10 AS DOUBLE) AS overall_score,
       discrepancies, total_reviewed,
       CASE WHEN tenths >= 85 AND discrepancies * 100 <= total_reviewed * 5 THEN {q(R.AUDIT_APPROVED_NOTE)}
            ELSE 'Auditor identified ' || discrepancies || ' critical discrepancies requiring policy calibration.' END AS reviewer_notes,
       intent_failures, escalation_failures, grounding_failures
FROM gated"""


_m, _r = "lower(customer_message)", "lower(grounded_reply)"
JUDGED = """
criteria AS (
  SELECT conversation_id, customer_message, grounded_reply,
    CASE WHEN length(grounded_reply) < 20 THEN 20 WHEN ground_truth_intent <> predicted_intent THEN 30 ELSE 50 END AS c,
    CASE WHEN citations > 0 THEN 50 ELSE 35 END AS g,
""" + f"""
    CASE WHEN {any_of(_r, R.JUDGE_ACTIONABLE)} THEN 50 WHEN length(grounded_reply) < 30 THEN 30 ELSE 40 END AS h,
    CASE WHEN {any_of(_r, R.JUDGE_INSULTS)} THEN 10 ELSE 50 END AS p,
    CASE WHEN {any_of(_r, R.JUDGE_WARM)} THEN 50 ELSE 48 END AS t,
    CASE WHEN {any_of(_m, R.JUDGE_EMERGENCY)} AND NOT {any_of(_r, R.JUDGE_SAFE_REPLY)} THEN 20 ELSE 50 END AS s,
    CASE WHEN {any_of(_r, R.JUDGE_INVENTED)} THEN 10 ELSE 50 END AS f
  FROM scored
),
judged AS (
  SELECT conversation_id, customer_message, grounded_reply, CAST(c / 10 AS DOUBLE) AS correctness, CAST(g / 10 AS DOUBLE) AS groundedness,
    CAST(h / 10 AS DOUBLE) AS helpfulness, CAST(p / 10 AS DOUBLE) AS professionalism, CAST(t / 10 AS DOUBLE) AS tone,
    CAST(s / 10 AS DOUBLE) AS safety, CAST(f / 10 AS DOUBLE) AS faithfulness,
    CAST(((c + g + h + p + t + s + f) * 20 + 7) // 14 / 100 AS DOUBLE) AS average_score,
    'Response demonstrates high professionalism (' || printf('%.1f', p / 10) || '/5) and strong groundedness (' || printf('%.1f', g / 10)
      || '/5). Actionable assistance provided via official support channels with zero observed hallucinations.' AS feedback
  FROM criteria
)"""

CRITERIA = ("correctness", "groundedness", "helpfulness", "professionalism", "tone", "safety", "faithfulness")


def mean_2dp(column: str, unit: int) -> str:
    units = f"CAST(sum(CAST(round({column} * {unit}) AS BIGINT)) AS BIGINT)"
    return f"CAST(({units} * 200 + count({column}) * {unit}) // (count({column}) * {2 * unit}) / 100 AS DOUBLE)"


JUDGE_MEANS = ", ".join(f"{mean_2dp(c, 10)} AS mean_{c}" for c in CRITERIA) + f", {mean_2dp('average_score', 100)} AS average_overall_score"

RATED = AUDITED + "," + JUDGED + """,
rated AS (
  SELECT j.conversation_id, j.customer_message, j.grounded_reply, item_score / 2 AS audit_score, average_score AS judge_score
  FROM judged j JOIN items USING (conversation_id)
)"""
AGREEMENT = """SELECT count(*) AS sample_size, round(avg(audit_score), 2) AS mean_first, round(avg(judge_score), 2) AS mean_second,
  round(avg(abs(audit_score - judge_score)), 3) AS mean_absolute_difference,
  round(avg(CASE WHEN abs(audit_score - judge_score) <= 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END) * 100, 1) AS agreement_percentage FROM rated"""
PEARSON = """SELECT CASE WHEN min(audit_score) < max(audit_score) AND min(judge_score) < max(judge_score)
  THEN round(corr(audit_score, judge_score), 3) END AS pearson, count(*) AS sample_size FROM rated"""
SPEARMAN = """SELECT CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 3) END AS spearman, count(*) AS sample_size
FROM (SELECT rank() OVER (ORDER BY audit_score) + (count(*) OVER (PARTITION BY audit_score) - 1) / 2 AS ra,
             rank() OVER (ORDER BY judge_score) + (count(*) OVER (PARTITION BY judge_score) - 1) / 2 AS rb FROM rated)"""

LABEL_PAIRS = """
answers AS (
  SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS truth, CASE WHEN n_chars < 200 THEN 'toxic' ELSE 'clean' END AS predicted
  FROM labels JOIN documents USING (doc_id)
)"""
LINE_FLAGS = "answers AS (SELECT l_returnflag AS truth, CASE WHEN l_orderkey % 11 <> 0 THEN (['A', 'N', 'R', 'X'])[l_linenumber % 4 + 1] END AS predicted FROM lineitem)"
INTENT_ANSWERS = "answers AS (SELECT ground_truth_intent AS truth, predicted_intent AS predicted FROM scored WHERE ground_truth_intent IS NOT NULL)"


def per_class(source: str = "answers", name: str = "per_class", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""
{name}_labels AS (SELECT {keys}truth AS label FROM {source} UNION SELECT {keys}predicted FROM {source} WHERE predicted IS NOT NULL),
{name}_hits AS (
  SELECT {'l.' + by + ', ' if by else ''}label, count(*) FILTER (truth = label) AS support, count(*) FILTER (predicted = label) AS called,
         count(*) FILTER (truth = label AND predicted = label) AS hits
  FROM {name}_labels l JOIN {source} a ON (a.truth = label OR a.predicted = label) {'AND a.' + by + ' = l.' + by if by else ''}
  GROUP BY ALL
),
{name}_pr AS (
  SELECT *, CASE WHEN called = 0 THEN CAST(0 AS DOUBLE) ELSE hits / called END AS "precision",
            CASE WHEN support = 0 THEN CAST(0 AS DOUBLE) ELSE hits / support END AS recall
  FROM {name}_hits
),
{name} AS (
  SELECT {keys}label, "precision", recall,
         CASE WHEN "precision" + recall = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1, support
  FROM {name}_pr
)"""


def six(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


MACRO = 'SELECT round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM per_class'
WEIGHTED = 'SELECT round(sum("precision" * support) / sum(support), 6) AS "precision", round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM per_class'
ACCURACY = "SELECT round(avg(CASE WHEN truth = predicted THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy, count(*) AS support FROM answers"

# The random baseline on a key: class and confidence from two slices of a hash.
_names = listed(i.name for i in R.taxonomy())
_k = len(R.TAXONOMY)


def random_columns(key: str) -> str:
    digest = f"md5('{SEED}|' || {key})"
    return (
        f"([{_names}])[CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % {_k} + 1] AS predicted_intent, "
        f"round(CAST({0.8 / _k!r} AS DOUBLE) + CAST('0x' || substr({digest}, 9, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) "
        f"* CAST({1.5 / _k - 0.8 / _k!r} AS DOUBLE), 2) AS intent_confidence"
    )


MODELS = INTENT_ANSWERS + f""",
three AS (
  SELECT conversation_id, ground_truth_intent AS truth, predicted_intent AS main, coalesce({rule_case(_m)}, 'General Inquiry') AS kw,
         ([{_names}])[CAST('0x' || substr(md5('{SEED}|' || conversation_id), 1, 8) AS BIGINT) % {_k} + 1] AS rnd
  FROM scored WHERE ground_truth_intent IS NOT NULL
),
model_answers AS (
  SELECT 'main_agent' AS model, truth, main AS predicted FROM three
  UNION ALL SELECT 'baseline_1_random', truth, rnd FROM three
  UNION ALL SELECT 'baseline_2_keyword', truth, kw FROM three
),""" + per_class("model_answers", "per_model", "model") + """,
model_table AS (
  SELECT model, a.accuracy, m.macro_f1
  FROM (SELECT model, round(avg(CASE WHEN truth = predicted THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS accuracy FROM model_answers GROUP BY model) a
  JOIN (SELECT model, round(avg(f1), 4) AS macro_f1 FROM per_model GROUP BY model) m USING (model)
)"""


def seeded(key: str, seed: int = SEED) -> str:
    return f"md5('{seed}|' || {key})"


def balanced(source: str, size: int, stratum: str, classes, key: str, top_up: bool = True) -> str:
    share, extra = divmod(size, len(classes))
    quota = "CASE " + " ".join(f"WHEN {stratum} = {q(c)} THEN {share + (1 if i < extra else 0)}" for i, c in enumerate(classes)) + " ELSE 0 END"
    first = f"""
drawn AS (
  SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {stratum} ORDER BY {seeded(key)}, {key}) <= {quota}
)"""
    if not top_up:
        return first
    return first + f""",
chosen AS (
  SELECT * FROM drawn UNION ALL (
    SELECT * FROM {source} WHERE {key} NOT IN (SELECT {key} FROM drawn)
    ORDER BY {seeded(key)}, {key} LIMIT greatest(0, {size} - (SELECT count(*) FROM drawn))
  )
)"""


LANGUAGES = ("de", "en", "es", "fr")
GOLDEN = PHRASED + "," + labelled("phrased") + "," + balanced("labelled", 100, "intent", [i.name for i in R.taxonomy()], "conversation_id")


def terms(source: str, key: str, text: str, name: str, bigrams: bool = True) -> str:
    stops = listed(R.STOP_WORDS)
    pairs_of_words = f"""
  UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words""" if bigrams else ""
    return f"""
{name}_words AS MATERIALIZED (
  SELECT {key}, list_filter(regexp_extract_all(strip_accents(lower({text})), '{W}{{2,}}'), lambda x: x NOT IN ({stops})) AS w FROM {source}
),
{name} AS (
  SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(w) AS term FROM {name}_words{pairs_of_words})
  GROUP BY {key}, term
)"""


def vectors(counts: str, key: str, name: str) -> str:
    return f"""
{name}_raw AS (
  SELECT {key}, term, (1 + ln(tf)) * idf AS raw FROM {counts} JOIN vocab USING (term)
),
{name} AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)"""


INDEX = """
docs AS (SELECT conversation_id AS doc_id, customer_message || ' ' || support_reply AS doc_text FROM pairs),""" + terms("docs", "doc_id", "doc_text", "doc_terms") + """,
vocab AS MATERIALIZED (
  SELECT term, df, ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM doc_terms GROUP BY term ORDER BY cf DESC, term LIMIT 5000)
),""" + vectors("doc_terms", "doc_id", "postings")


def search(queries: str, name: str, extra: str = "") -> str:
    return terms(queries, "query_id", "query", f"{name}_terms") + "," + vectors(f"{name}_terms", "query_id", f"{name}_vectors") + f""",
{name} AS (
  SELECT query_id, rank, doc_id AS conversation_id, round(score, 4) AS similarity_score, support_reply
  FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, sum(v.weight * p.weight) AS score FROM {name}_vectors v JOIN postings p USING (term) GROUP BY query_id, doc_id)
    WHERE score >= 0.15 {extra}
  ) JOIN pairs ON pairs.conversation_id = doc_id
  WHERE rank <= 3
)"""


ASKED = "asked AS (SELECT conversation_id AS query_id, customer_message AS query, fault FROM phrased)"
HITS = "SELECT query_id, CAST(rank AS INTEGER) AS rank, conversation_id, similarity_score, CAST(length(support_reply) AS INTEGER) AS reply_length FROM hits"
TOPK = f"WITH {PHRASED}, {INDEX}, {ASKED}, {search('asked', 'hits')} {HITS}"

TWEET_COLUMNS = """conv_id * 100 + turn AS tweet_id, CASE WHEN role = 'assistant' THEN 'brand_support' ELSE CAST(conv_id AS VARCHAR) END AS author_id,
  role = 'user' AS inbound, text,
  CASE WHEN role = 'assistant' AND turn > 0 THEN conv_id * 100 + turn - 1 ELSE -1 END AS in_response_to_tweet_id"""
PAIR_COLUMNS = """conversation_id, customer_tweet_id, support_tweet_id, customer_message, support_reply,
  CAST(length(customer_message) AS INTEGER) AS char_length_customer, CAST(length(support_reply) AS INTEGER) AS char_length_reply"""
def unique(source: str) -> str:
    return f"""
conversations_kept AS (
  SELECT * FROM {source} WHERE {VALID.format(n=20)}
  QUALIFY row_number() OVER (PARTITION BY lower(customer_message) ORDER BY support_tweet_id) = 1
)"""


UNIQUE = PAIRS + "," + unique("pairs")


def long_rows(source: str, section: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {q(section)} AS section, {q(metric)} AS metric, CAST({column} AS DOUBLE) AS value FROM {source}" for column, metric in names.items()
    )


def _metrics_summary() -> str:
    esc = "escalations AS (SELECT ground_truth_escalation AS truth, decision AS predicted FROM scored WHERE ground_truth_escalation IS NOT NULL)"
    one_label = """
one_label AS (SELECT h / c AS p, h / s AS r FROM (SELECT count(*) FILTER (truth = 'ESCALATE' AND predicted = 'ESCALATE') AS h,
  count(*) FILTER (predicted = 'ESCALATE') AS c, count(*) FILTER (truth = 'ESCALATE') AS s FROM escalations))"""
    parts = [
        "SELECT 'dataset' AS section, 'eval_size' AS metric, CAST(count(*) AS DOUBLE) AS value FROM scored",
        long_rows("(SELECT round(avg(CASE WHEN truth = predicted THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS v FROM answers)", "main_agent", {"v": "accuracy"}),
        long_rows('(SELECT round(avg("precision"), 4) AS p, round(avg(recall), 4) AS r, round(avg(f1), 4) AS f, round(sum(f1 * support) / sum(support), 4) AS w FROM per_class)',
                  "main_agent", {"p": "macro_precision", "r": "macro_recall", "f": "macro_f1", "w": "weighted_f1"}),
        long_rows("(SELECT round(avg(CASE WHEN truth = predicted THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS v FROM escalations)", "escalation_policy", {"v": "accuracy"}),
        long_rows("(SELECT round(p, 4) AS p, round(r, 4) AS r, round(2 * p * r / (p + r), 4) AS f FROM one_label)", "escalation_policy",
                  {"p": "precision_escalate", "r": "recall_escalate", "f": "f1_escalate"}),
        long_rows(f"(SELECT {JUDGE_MEANS} FROM judged)", "judge", {"average_overall_score": "average_overall_score", **{f"mean_{c}": c for c in CRITERIA}}),
        "SELECT model AS section, 'accuracy' AS metric, accuracy AS value FROM model_table WHERE model <> 'main_agent'",
        "SELECT model AS section, 'macro_f1' AS metric, macro_f1 AS value FROM model_table WHERE model <> 'main_agent'",
        long_rows(f"({AGREEMENT})", "rater_agreement", {"sample_size": "sample_size", "agreement_percentage": "agreement_pct_within_0_5", "mean_absolute_difference": "mean_abs_difference"}),
        long_rows(f"({PEARSON})", "rater_agreement", {"pearson": "pearson_correlation"}),
        long_rows(f"({SPEARMAN})", "rater_agreement", {"spearman": "spearman_correlation"}),
    ]
    return f"WITH {RATED}, {MODELS}, {esc}, {one_label}, {per_class()} " + " UNION ALL ".join(parts)


DIRTY = """
dirty AS (
  SELECT conv_id, turn, (['', '@user_1 ', 'see http://t.co/x1 ', '  ' || chr(10) || ' don' || chr(65533) || 't '])[conv_id % 4 + 1] || text || ' ' || chr(9) AS raw
  FROM conversations
)"""

# The entities that occur in the pages; the ampersand last, so that nothing is unescaped twice.
PLAIN_PAGES = """
plain_pages AS (
  SELECT page_id, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS plain
  FROM pages
)"""

EVENT_ITEMS = """
items AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
         CASE WHEN event_type = 'error' OR value < 1 THEN 'FAIL' ELSE 'PASS' END AS item_verdict,
         CASE WHEN event_type = 'error' THEN 650 WHEN value < 1 THEN 730 ELSE 1000 END AS hundredths,
         CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS intent_status,
         CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'FAIL' ELSE 'PASS' END AS escalation_status,
         CASE WHEN value < 1 THEN 'FAIL' ELSE 'PASS' END AS grounding_status
  FROM events
)"""


def _stream_score() -> str:
    """What the stream writes: every customer turn scored by keywords and audited."""
    return f"""WITH {PAIRS}, {INDEX},
messages AS (
  SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS conversation_id,
         ([{listed(PHRASES)}])[(conv_id * 8 + turn) % {len(PHRASES)} + 1] || ' ' || {clean('text')} AS customer_message
  FROM conversations WHERE role = 'user'
),
asked AS (SELECT conversation_id AS query_id, customer_message AS query FROM messages), {search('asked', 'hits')},
keyword AS ({_keyword('messages')}),
classified AS (SELECT k.*, m.customer_message FROM keyword k JOIN messages m USING (conversation_id)),
{escalated('classified', 'decided')}, {replied('decided', 'hits', 'scored')}, {REVIEWS}
SELECT conversation_id, s.predicted_intent, intent_confidence, decision, is_grounded, item_verdict, item_score FROM scored s JOIN items USING (conversation_id)"""


def _keyword(source: str) -> str:
    return f"""SELECT conversation_id, coalesce(rule, 'General Inquiry') AS predicted_intent,
  CAST(CASE WHEN rule IS NULL THEN 0.4 ELSE 0.85 END AS DOUBLE) AS intent_confidence
  FROM (SELECT *, {rule_case(_m)} AS rule FROM {source})"""


def _failures() -> str:
    intent = "(ground_truth_intent IS NOT NULL AND predicted_intent <> ground_truth_intent)"
    other = "(ground_truth_escalation IS NOT NULL AND decision <> ground_truth_escalation)"
    return f"""
failures AS (
  SELECT conversation_id, customer_message, predicted_intent, ground_truth_intent, decision AS predicted_escalation, ground_truth_escalation,
         intent_confidence AS confidence, CASE WHEN {intent} THEN {q(R.FAILURE_INTENT)} ELSE {q(R.FAILURE_ESCALATION)} END AS reason,
         {q(R.FAILURE_CAUSE)} AS root_cause, {q(R.FAILURE_REMEDY)} AS possible_improvement
  FROM scored WHERE {intent} OR {other}
)"""


def _taxonomy_rows() -> str:
    rows = ", ".join(
        f"({q(i.name)}, {n}, {q(i.description)}, {q(', '.join(i.keywords))}, {q(i.default_escalation)}, {q(i.priority)})" for n, i in enumerate(R.taxonomy())
    )
    return f"taxonomy(intent, ord, description, keywords, default_escalation, priority) AS (VALUES {rows})"


def _training_queries() -> dict[str, str]:
    model = training_sql.trained(PHRASED, labelled("phrased"), balanced, terms)
    predicted = training_sql.classified("phrased", "predicted", terms, rule_case(_m))
    tested = training_sql.classified("chosen", "tested", terms, rule_case(_m))
    classify = f"WITH {model}, {predicted} SELECT conversation_id, predicted_intent, intent_confidence FROM predicted"
    return {
        "train_classifier": f"""WITH RECURSIVE {training_sql.fitted(PHRASED, labelled("phrased"), balanced, terms)}
SELECT term, intent AS label, CASE WHEN round(c, 3) = 0 THEN CAST(0 AS DOUBLE) ELSE round(c, 3) END AS coefficient FROM model JOIN classes USING (k) WHERE term <> ''""",
        "train_eval_report": f"""WITH {model}, {tested},
answers AS (SELECT intent AS truth, predicted_intent AS predicted FROM chosen JOIN tested USING (conversation_id)), {per_class()}
SELECT (SELECT round(avg(CASE WHEN truth = predicted THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) FROM answers) AS accuracy,
       (SELECT round(avg(f1), 4) FROM per_class) AS macro_f1, (SELECT count(*) FROM training) AS train_size, (SELECT count(*) FROM chosen) AS test_size""",
        "classify": classify,
        "classifier_roundtrip": classify,
        "class_distribution": f"""WITH {model}, {training_sql.shares('phrased', 'predicted', terms)}
SELECT conversation_id, intent AS label, round(p, 4) AS probability FROM predicted JOIN classes USING (k)""",
        "score_batch": f"""WITH {model}, {predicted}, {INDEX}, {ASKED}, {search('asked', 'hits')},
classified AS (
  SELECT conversation_id, l.customer_message, l.intent AS ground_truth_intent, l.escalation AS ground_truth_escalation, p.predicted_intent, p.intent_confidence
  FROM labelled l JOIN predicted p USING (conversation_id)
), {escalated('classified', 'decided')}, {replied('decided', 'hits', 'grounded')} {FLAT_SCORED} grounded""",
    }


def oracle_sql() -> dict[str, str]:
    keyword_scored = f"""WITH {PHRASED}, {INDEX}, {ASKED}, {search('asked', 'hits')}, {labelled('phrased')},
matched AS (SELECT *, {rule_case(_m)} AS rule FROM labelled),
classified AS (
  SELECT conversation_id, customer_message, intent AS ground_truth_intent, escalation AS ground_truth_escalation,
         coalesce(rule, 'General Inquiry') AS predicted_intent, CAST(CASE WHEN rule IS NULL THEN 0.4 ELSE 0.85 END AS DOUBLE) AS intent_confidence
  FROM matched
), {escalated('classified', 'decided')}, {replied('decided', 'hits', 'grounded')} {FLAT_SCORED} grounded"""
    return {
        "intent_decisions": f"""WITH {PHRASED}, {unique('phrased')}, matched AS ({_keyword('conversations_kept')}),
classified AS (SELECT m.*, k.customer_message FROM matched m JOIN conversations_kept k USING (conversation_id)),
{escalated('classified', 'decided')} SELECT predicted_intent AS intent, decision, count(*) AS n FROM decided GROUP BY ALL""",
        "scan_tweets_csv": f"SELECT {TWEET_COLUMNS} FROM conversations",
        "roundtrip_conversations": f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs",
        "roundtrip_scored_json": f"WITH {SCORED} {FLAT_SCORED} scored",
        "review_manifest": f"WITH {SCORED} SELECT 'Primary Agent' AS source, count(*) AS records_count FROM scored",
        "taxonomy_table": f"""WITH {PHRASED}, {_taxonomy_rows()}, matched AS (SELECT {rule_case(_m)} AS rule FROM phrased)
SELECT intent, ord, description, keywords, default_escalation, priority, (SELECT count(*) FROM matched WHERE rule = intent) AS matched,
       (SELECT count(*) FROM phrased) AS source_conversations FROM taxonomy""",
        "clean_text": f"WITH {DIRTY}, c AS (SELECT conv_id, turn, {clean('raw')} AS cleaned FROM dirty) SELECT conv_id, turn, cleaned, CAST(length(cleaned) AS INTEGER) AS length FROM c",
        "clean_unescape": f"WITH {PLAIN_PAGES} SELECT page_id, {clean('plain')} AS cleaned FROM plain_pages",
        "valid_conversations": f"WITH {PAIRS} SELECT conversation_id, {VALID.format(n=150)} AS valid_150, {VALID.format(n=20)} AS valid_20 FROM pairs",
        "paired_replies": f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs",
        "conversation_pairs": f"WITH {UNIQUE} SELECT {PAIR_COLUMNS} FROM conversations_kept",
        "conversation_sample": f"""WITH {UNIQUE}, s AS (SELECT * FROM conversations_kept ORDER BY {seeded('conversation_id')}, support_tweet_id LIMIT 100)
SELECT 'CONV_' || printf('%04d', row_number() OVER (ORDER BY {seeded('conversation_id', SEED + 1)}, support_tweet_id)) AS conversation_id, support_tweet_id,
  CAST(length(customer_message) AS INTEGER) AS char_length_customer, CAST(length(support_reply) AS INTEGER) AS char_length_reply FROM s""",
        "dedup_messages": f"""WITH {PAIRS} SELECT support_tweet_id, customer_message FROM pairs
QUALIFY row_number() OVER (PARTITION BY lower(customer_message) ORDER BY support_tweet_id) = 1""",
        "rule_intent": f"WITH {PHRASED} SELECT conversation_id, {rule_case(_m)} AS rule_intent FROM phrased",
        "label_conversations": f"WITH {PHRASED}, {labelled('phrased')} SELECT conversation_id, intent, escalation, reply_keywords, ground_truth_notes FROM labelled",
        "escalate": f"WITH {DECIDED} SELECT conversation_id, predicted_intent, intent_confidence, decision, reason, decision_confidence AS confidence FROM decided",
        "grounded_reply": f"WITH {SCORED} SELECT conversation_id, grounded_reply, grounding_rationale, is_grounded FROM scored",
        "influenced_by": f"""WITH {PHRASED}, blanked AS (SELECT * FROM phrased), {OWN_HITS}
SELECT query_id, CAST(rank AS INTEGER) AS rank, conversation_id, similarity_score, substr(support_reply, 1, 120) || '...' AS historical_snippet FROM own_hits""",
        "audit_intent": f"WITH {AUDITED} SELECT conversation_id, status, reason FROM intent_review",
        "audit_escalation": f"WITH {AUDITED} SELECT conversation_id, status, reason FROM escalation_review",
        "audit_grounding": f"WITH {AUDITED} SELECT conversation_id, status, reason FROM grounding_review",
        "audit_items": f"WITH {AUDITED} SELECT conversation_id, item_verdict, item_score FROM items",
        "audit_sample": f"WITH {AUDITED} SELECT conversation_id, item_verdict, item_score FROM items ORDER BY conversation_id LIMIT 5",
        "audit_rollup": f"WITH {AUDITED} {rollup('items')}",
        "audit_rollup_by_intent": f"WITH {AUDITED} {rollup('items', 'predicted_intent')}",
        "judge_replies": f"WITH {SCORED}, {JUDGED} SELECT * EXCLUDE (customer_message, grounded_reply) FROM judged",
        "judge_means": f"WITH {SCORED}, {JUDGED} SELECT {JUDGE_MEANS} FROM judged",
        "failure_cases": f"WITH {SCORED}, {_failures()} SELECT * FROM failures",
        "top_failures": f"WITH {SCORED}, {_failures()} SELECT conversation_id, reason FROM failures ORDER BY conversation_id LIMIT 5",
        "label_counts": f"WITH {PHRASED}, {labelled('phrased')} SELECT intent AS label, count(*) AS n FROM labelled GROUP BY intent",
        "accuracy": f"WITH {LINE_FLAGS} {ACCURACY}",
        "classification_report": f"""WITH {SCORED}, {INTENT_ANSWERS}, {per_class()}
SELECT label, {six('precision', 'recall', 'f1')}, support FROM per_class
UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, support FROM ({ACCURACY})
UNION ALL SELECT 'macro avg', * FROM ({MACRO}) UNION ALL SELECT 'weighted avg', * FROM ({WEIGHTED})""",
        "macro_prf": f"WITH {LINE_FLAGS}, {per_class()} {MACRO}",
        "weighted_prf": f"WITH {LINE_FLAGS}, {per_class()} {WEIGHTED}",
        "binary_prf": f"WITH {LABEL_PAIRS}, {per_class()} SELECT {six('precision', 'recall', 'f1')}, support FROM per_class WHERE label = 'toxic'",
        "confusion_matrix": f"""WITH {SCORED}, {INTENT_ANSWERS}, l AS (SELECT truth AS label FROM answers UNION SELECT predicted FROM answers)
SELECT t.label AS truth, p.label AS predicted, (SELECT count(*) FROM answers a WHERE a.truth = t.label AND a.predicted = p.label) AS n FROM l t, l p""",
        "baseline_comparison": f"WITH {SCORED}, {MODELS} SELECT * FROM model_table",
        "rater_agreement": f"WITH {RATED} {AGREEMENT}",
        "rater_comparisons": f"""WITH {RATED} SELECT conversation_id, substr(customer_message, 1, 75) || '...' AS customer_message,
substr(grounded_reply, 1, 75) || '...' AS grounded_reply, audit_score, judge_score, round(abs(audit_score - judge_score), 2) AS absolute_diff FROM rated""",
        "pearson": f"WITH {RATED} {PEARSON}",
        "spearman": f"WITH {RATED} {SPEARMAN}",
        "metrics_summary": _metrics_summary(),
        "metrics_roundtrip": _metrics_summary(),
        "sample_n": f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {seeded('doc_id')}, doc_id LIMIT 250",
        "stratified_sample": f"WITH {balanced('documents', 501, 'lang', LANGUAGES, 'doc_id', False)} SELECT doc_id, lang FROM drawn",
        "balanced_sample": f"WITH {balanced('documents', 501, 'lang', LANGUAGES, 'doc_id')} SELECT doc_id, lang FROM chosen",
        "golden_sample": f"""WITH {GOLDEN} SELECT 'GOLDEN_' || printf('%03d', row_number() OVER (ORDER BY {seeded('conversation_id', SEED + 1)}, conversation_id)) AS conversation_id,
  customer_message, intent, escalation, reply_keywords, ground_truth_notes FROM chosen""",
        "train_disjoint": f"""WITH {GOLDEN} SELECT conversation_id, intent FROM labelled
WHERE lower(trim(customer_message)) NOT IN (SELECT lower(trim(customer_message)) FROM chosen)""",
        "term_stats": f"WITH {terms('documents', 'doc_id', 'text', 't', False)} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM t GROUP BY term",
        "tfidf_index": f"WITH {PAIRS}, {INDEX} SELECT doc_id AS conversation_id, term, df, round(idf, 6) AS idf, round(weight, 6) AS weight FROM postings JOIN vocab USING (term)",
        "retrieve_topk": TOPK,
        "retrieve_topk_noself": f"WITH {PHRASED}, {INDEX}, {ASKED}, {search('asked', 'hits', 'AND query_id <> doc_id')} {HITS}",
        "index_roundtrip": TOPK,
        "blank_queries": f"""WITH {PHRASED}, {INDEX}, asked AS (SELECT conversation_id AS query_id, conversation_id, fault,
  CASE WHEN fault < 10 THEN ' ' ELSE customer_message END AS customer_message, CASE WHEN fault < 10 THEN ' ' ELSE customer_message END AS query FROM phrased),
{search('asked', 'hits')}, k AS ({_keyword('asked')}), n AS (SELECT query_id, count(*) AS hits FROM hits GROUP BY query_id)
SELECT a.query_id, predicted_intent, CASE WHEN fault < 10 THEN CAST(0.5 AS DOUBLE) ELSE intent_confidence END AS intent_confidence, coalesce(n.hits, 0) AS hits
FROM asked a JOIN k USING (conversation_id) LEFT JOIN n ON n.query_id = a.query_id""",
        "class_weights": f"""WITH {PHRASED}, {labelled('phrased')}, c AS (SELECT intent AS label, count(*) AS n FROM labelled GROUP BY intent)
SELECT label, n, round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
        "calibrate_confidence": """WITH e AS (SELECT event_id, (CAST(floor(value * 100) AS BIGINT) % 1000) / CAST(1000 AS DOUBLE) AS p FROM events)
SELECT event_id, round(least(CAST(0.96 AS DOUBLE), greatest(CAST(0.88 AS DOUBLE), p * 2 + CAST(0.4 AS DOUBLE))), 2) AS by_rule,
       round(least(CAST(0.92 AS DOUBLE), greatest(CAST(0.45 AS DOUBLE), p * CAST(1.8 AS DOUBLE))), 2) AS by_model FROM e""",
        "keyword_baseline": f"WITH {PHRASED} {_keyword('phrased')}",
        "random_baseline": f"SELECT doc_id, {random_columns('doc_id')} FROM documents",
        "intent_priority_rollup": f"""WITH {PHRASED}, {labelled('phrased')}, {_taxonomy_rows()},
c AS (SELECT intent, count(*) AS n FROM labelled GROUP BY intent)
SELECT priority, default_escalation, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n, count(*) AS intents FROM taxonomy LEFT JOIN c USING (intent) GROUP BY ALL""",
        "score_batch_keywords": keyword_scored,
        "score_batch_limit": f"SELECT * FROM ({keyword_scored}) ORDER BY conversation_id LIMIT 25",
        "stream_score": _stream_score(),
        "stream_audit_window": f"""WITH {EVENT_ITEMS}, {rollup_counts('items', 'window_start, window_end')},
reports AS ({report('window_start, window_end')}) SELECT * FROM reports WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
        "audit_window": f"WITH {EVENT_ITEMS} {rollup('items', 'window_start, window_end')}",
    } | _training_queries()
