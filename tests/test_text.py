import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carewise.functions import text as X


def one_column(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


CLEANER_CASES = [
    ("@one @Two_2 see https://t.co/abc lost &amp; found, please call", "see lost & found, please call"),
    ("my  ride\n\n was\tlate   ", "my ride was late"),
    ("can�t open it", "can't open it"),
    ("ﬁrst ｆｕｌｌ width", "first full width"),
    ("e\u0301clair", "éclair"),
    ("&amp;lt; stays once", "&lt; stays once"),
    ("no\u00a0break\u2003em\u2028line", "no break em line"),
    ("@usér keeps a handle that runs into a letter", "@usér keeps a handle that runs into a letter"),
    ("http://a.b/c?d=é,f end", "end"),
    ("&#64;joe escaped handle", "escaped handle"),
    ("café “quoted” — dash", "café “quoted” — dash"),
    ("", ""),
    (None, ""),
]


def test_cleaner_cases(spark):
    assert one_column(spark, [c[0] for c in CLEANER_CASES], X.clean_text) == [c[1] for c in CLEANER_CASES]


def test_rows_that_skip_python_cannot_change():
    """Characters outside the trigger class are stable under NFKC and never combine."""
    trigger = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), X.MAY_CHANGE))
    for code in range(0x110000):
        char = chr(code)
        if not trigger.search(char):
            assert unicodedata.normalize("NFKC", char) == char and not unicodedata.combining(char), hex(code)


def test_spaces_are_the_unicode_blanks():
    spaces = {chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "Z"}
    spaces |= {chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85]}
    assert spaces == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_small_text_helpers(spark):
    assert one_column(spark, ["x" * 130, "ab", None], X.snippet) == ["x" * 120 + "...", "ab...", "..."]
    assert one_column(spark, ["done", "done.", "why?", "go!", "line\n"], X.end_sentence) == ["done.", "done.", "why?", "go!", "line\n."]
    assert one_column(spark, [" A b\u00a0", "x"], X.comparison_key) == ["a b", "x"]
    assert one_column(spark, ["", " \n\u2003", None, "a"], X.is_blank) == [True, True, True, False]
    assert one_column(spark, ["0.125", "0.375", "0.345", "5"], lambda c: X.fixed(c.cast("double"), 2)) == ["0.12", "0.38", "0.34", "5.00"]


def test_fold_accents(spark):
    assert one_column(spark, ["ÉCLAIR naïve Ångström", "ộ", "がき", "plain", "e\u0301"], X.fold_accents) == [
        "ECLAIR naive Angstrom", "o", "かき", "plain", "e"
    ]


def test_tokens_and_ngrams(spark):
    words = one_column(spark, ["The app's fare, a_b x 42 é naïve"], lambda c: X.tokens(c, ("the",)))
    assert words == [["app", "fare", "a_b", "42", "naive"]]
    runs = one_column(spark, ["one two three", "one", ""], lambda c: X.ngrams(X.tokens(c), 1, 3))
    assert runs == [["one", "two", "three", "one two", "two three", "one two three"], ["one"], []]
    bigrams = one_column(spark, ["one two three"], lambda c: X.ngrams(X.tokens(c), 2, 2))
    assert bigrams == [["one two", "two three"]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab@_:/ht ps.&;é\u0301\u00a0\n1"), max_size=40), min_size=1, max_size=60))
def test_cleaner_leaves_nothing_to_clean(spark, texts):
    """No blanks at the ends or in a row, and no complete link or handle is left. Texts are normalised
    before links and handles go, so only those without any stay normalised for certain."""
    for text, out in zip(texts, one_column(spark, texts, X.clean_text)):
        assert out == out.strip() and not re.search(r"\s\s", out)
        assert "@" in text or "h" in text or "&" in text or unicodedata.is_normalized("NFKC", out)
        assert not re.search(r"https?://[^\s]", out) or "://" in out
