"""The training of the classifier in SQL, up to the optimum or step by step, and the queries that use its model."""

from __future__ import annotations

from carewise.functions import rulebook as R
from carewise.operators.descent import COEFFICIENT_UNIT, ERROR_UNIT, FEATURE_UNIT, RATE, STEEPEST, TINY
from carewise.operators.intent import CLASSIFIER_TERMS, INVERSE_REGULARISATION
from registry.inputs import TRAINING_STEPS

GOLDEN_SIZE = 20
MOMENTUM = 0.9


def number(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _step(n: int) -> str:
    """Errors of every row and class by the coefficients of the step before, then new coefficients."""
    return f"""
errors_{n} AS MATERIALIZED (
  SELECT conversation_id, k, CAST(round(weight * (power / sum(power) OVER (PARTITION BY conversation_id) - CASE WHEN k = label THEN 1 ELSE 0 END) * {number(ERROR_UNIT)}) AS BIGINT) AS e
  FROM (
    SELECT conversation_id, k, exp(m - max(m) OVER (PARTITION BY conversation_id)) AS power
    FROM (SELECT conversation_id, k, CAST(sum(x * c) AS DOUBLE) / {number(FEATURE_UNIT * COEFFICIENT_UNIT)} AS m FROM train_x JOIN state_{n - 1} USING (term) GROUP BY ALL)
  ) JOIN train_rows USING (conversation_id)
),
state_{n} AS MATERIALIZED (
  SELECT term, k, CAST(round((value - {number(RATE)} * slope / (sqrt(seen) + {number(TINY)})) * {number(COEFFICIENT_UNIT)}) AS BIGINT) AS c, seen
  FROM (
    SELECT *, before + slope * slope AS seen
    FROM (
      SELECT term, k, s.seen AS before, c / {number(COEFFICIENT_UNIT)} AS value,
             CAST(g AS DOUBLE) / ({number(FEATURE_UNIT * ERROR_UNIT)} * total) + CASE WHEN term = '' THEN 0 ELSE 1 / ({number(INVERSE_REGULARISATION)} * total) END * (c / {number(COEFFICIENT_UNIT)}) AS slope
      FROM state_{n - 1} s JOIN (SELECT term, k, sum(x * e) AS g FROM train_x JOIN errors_{n} USING (conversation_id) GROUP BY ALL) USING (term, k), train_total
    )
  )
)"""


def _training(phrased: str, labelled: str, balanced, terms) -> str:
    """CTEs up to ``train_raw``, the terms of the training texts."""
    golden = balanced("labelled", GOLDEN_SIZE, "intent", [i.name for i in R.taxonomy()], "conversation_id")
    return f"""{phrased}, {labelled}, {golden},
training AS MATERIALIZED (
  SELECT conversation_id, customer_message, intent FROM labelled
  WHERE lower(trim(customer_message)) NOT IN (SELECT lower(trim(customer_message)) FROM chosen)
),
train_total AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM training),
classes AS MATERIALIZED (
  SELECT intent, CAST(row_number() OVER (ORDER BY intent) AS INTEGER) - 1 AS k, total / (count(*) OVER () * n) AS weight
  FROM (SELECT intent, count(*) AS n FROM training GROUP BY intent), train_total
),
train_rows AS MATERIALIZED (SELECT conversation_id, k AS label, weight FROM training JOIN classes USING (intent)),
{terms('training', 'conversation_id', 'customer_message', 'train_terms')},
train_vocab AS MATERIALIZED (
  SELECT term, ln((1 + (SELECT count(*) FROM training)) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM train_terms GROUP BY term ORDER BY cf DESC, term LIMIT {CLASSIFIER_TERMS})
),
train_raw AS (SELECT conversation_id, term, (1 + ln(tf)) * idf AS raw FROM train_terms JOIN train_vocab USING (term))"""


def trained(phrased: str, labelled: str, balanced, terms, steps: int = TRAINING_STEPS) -> str:
    """CTEs up to ``model`` (term, k, c); the intercept is the term without letters."""
    return f"""{_training(phrased, labelled, balanced, terms)},
train_x AS MATERIALIZED (
  SELECT conversation_id, term, CAST(round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY conversation_id)) * {number(FEATURE_UNIT)}) AS BIGINT) AS x FROM train_raw
  UNION ALL SELECT conversation_id, '', {FEATURE_UNIT} FROM training
),
state_0 AS MATERIALIZED (
  SELECT term, k, CAST(0 AS BIGINT) AS c, CAST(0 AS DOUBLE) AS seen FROM (SELECT term FROM train_vocab UNION ALL SELECT ''), classes
),{",".join(_step(n) for n in range(1, steps + 1))},
model AS MATERIALIZED (SELECT term, k, c / {number(COEFFICIENT_UNIT)} AS c FROM state_{steps})"""


def fitted(phrased: str, labelled: str, balanced, terms) -> str:
    """Recursive CTEs up to ``model`` (term, k, c) at the optimum, by steps with momentum until no slope is
    above ``STEEPEST``. A term's steps go by a bound of its second derivatives."""
    return f"""{_training(phrased, labelled, balanced, terms)},
train_numbers AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) AS term_id FROM train_vocab UNION ALL SELECT '', 0),
train_values AS MATERIALIZED (
  SELECT row_id, term_id, x, sum(x) OVER (PARTITION BY row_id) AS length, label, weight
  FROM (
    SELECT conversation_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY conversation_id)) AS x FROM train_raw
    UNION ALL SELECT conversation_id, '', 1 FROM training
  )
  JOIN train_numbers USING (term) JOIN (SELECT *, row_number() OVER (ORDER BY conversation_id) AS row_id FROM train_rows) USING (conversation_id)
),
train_bounds AS MATERIALIZED (
  SELECT term_id, ridge, sum(weight * x * length) / (2 * any_value(total)) + ridge AS most
  FROM (SELECT *, CASE WHEN term_id = 0 THEN 0 ELSE 1 / ({number(INVERSE_REGULARISATION)} * total) END AS ridge FROM train_values, train_total) GROUP BY term_id, ridge
),
optimum(term_id, k, c, ahead, steepest) USING KEY (term_id, k) AS (
  SELECT term_id, k, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM train_bounds, classes
  UNION
  SELECT term_id, k, ahead - slope / most, ahead - slope / most + {number(MOMENTUM)} * (ahead - slope / most - c), max(abs(slope)) OVER ()
  FROM (
    SELECT o.*, most, g + ridge * ahead AS slope
    FROM optimum o JOIN train_bounds USING (term_id) JOIN (
      SELECT term_id, k, sum(x * error) / any_value(total) AS g
      FROM train_values JOIN (
        SELECT row_id, k, weight * (power / sum(power) OVER (PARTITION BY row_id) - CASE WHEN k = label THEN 1 ELSE 0 END) AS error
        FROM (
          SELECT *, exp(m - max(m) OVER (PARTITION BY row_id)) AS power
          FROM (SELECT row_id, label, weight, k, sum(x * ahead) AS m FROM train_values JOIN optimum USING (term_id) GROUP BY ALL)
        )
      ) USING (row_id), train_total GROUP BY term_id, k
    ) USING (term_id, k)
    WHERE steepest > {number(STEEPEST)}
  )
),
model AS MATERIALIZED (SELECT term, k, c FROM optimum JOIN train_numbers USING (term_id))"""


def shares(source: str, name: str, terms) -> str:
    """(conversation_id, k, p) of the messages of ``source``."""
    return f"""{terms(source, 'conversation_id', 'customer_message', f'{name}_terms')},
{name}_raw AS (SELECT conversation_id, term, (1 + ln(tf)) * idf AS raw FROM {name}_terms JOIN train_vocab USING (term)),
{name}_x AS (
  SELECT conversation_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY conversation_id)) AS x FROM {name}_raw
  UNION ALL SELECT conversation_id, '', 1 FROM {source}
),
{name} AS MATERIALIZED (
  SELECT conversation_id, k, power / sum(power) OVER (PARTITION BY conversation_id) AS p
  FROM (
    SELECT conversation_id, k, exp(m - max(m) OVER (PARTITION BY conversation_id)) AS power
    FROM (SELECT conversation_id, k, sum(x * c) AS m FROM {name}_x JOIN model USING (term) GROUP BY ALL)
  )
)"""


def classified(source: str, name: str, terms, rule: str) -> str:
    """(conversation_id, predicted_intent, intent_confidence): a rule on a trained class decides."""
    return f"""{shares(source, f'{name}_shares', terms)},
{name} AS MATERIALIZED (
  SELECT r.conversation_id, coalesce(ruled.intent, best.intent) AS predicted_intent,
         round(CASE WHEN ruled.intent IS NULL THEN least({number(0.92)}, greatest({number(0.45)}, b.p * {number(1.8)}))
                    ELSE least({number(0.96)}, greatest({number(0.88)}, own.p * 2 + {number(0.4)})) END, 2) AS intent_confidence
  FROM (SELECT conversation_id, {rule} AS rule FROM {source}) r
  JOIN (SELECT * FROM {name}_shares QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY p DESC, k) = 1) b USING (conversation_id)
  JOIN classes best ON best.k = b.k
  LEFT JOIN classes ruled ON ruled.intent = r.rule
  LEFT JOIN {name}_shares own ON own.conversation_id = r.conversation_id AND own.k = ruled.k
)"""
