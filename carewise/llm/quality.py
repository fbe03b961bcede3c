"""Quality of documents by hierarchical empirical Bayes over text, host and path.

A logistic model on the shape of a text gives each document its own evidence. Grouped sums of
that evidence give the rate of good documents per host and per path of a host. Both rates are
shrunk: a path's towards its host's, a host's towards the global rate, by a prior strength that
is estimated from the spread between groups, so that sites with few documents stay near the
prior. A document's own part is taken out of its groups before they speak for it.

Defined cases: a null text counts as empty; a document without a site has the global rate; of
several sites of one id the smallest (host, path) counts, of several labels the lowest; without
labels of both classes every text has even odds; an empty table gives an empty result; rows that
repeat an id are judged one by one; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.llm.common import sliced
from carewise.session import stored

# The text model is fitted on about this many labelled documents, chosen by a hash of the id.
FIT_ROWS = 20_000
# The hash range in which that share is taken; fine enough for any number of documents.
RANGE = 1 << 40
FEATURES = (
    "log_words", "word_length", "distinct_words", "same_as_before", "commonest_word", "capitals", "digits", "marks", "odd_marks",
    "stops", "line_length", "distinct_lines", "capital_words", "long_words", "short_words", "marked_words",
)
MOST_LOGIT = 12.0


def shape(text: str) -> tuple[float, ...]:
    """The features of one text, in the order of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = text.split()
    n, size = max(len(words), 1), max(len(data), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [line for line in text.split("\n") if line]
    stops = int(byte[[46, 44]].sum())
    marks = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    letters = max(int(byte[65:91].sum() + byte[97:123].sum()), 1)
    return (
        float(np.log1p(len(words))),
        float(lengths.mean()) if len(words) else 0.0,
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        int(byte[65:91].sum()) / letters,
        int(byte[48:58].sum()) / size,
        marks / size,
        (marks - stops) / size,
        stops / n,
        float(np.log1p(size / max(len(lines), 1))),
        len(set(lines)) / max(len(lines), 1),
        sum(map(str.isupper, words)) / n,
        float((lengths > 20).sum()) / n,
        float((lengths < 3).sum()) / n,
        sum(not w[-1].isalnum() for w in words) / n,
    )


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, features...) per row."""

    def work(batches):
        for part in sliced(batches):
            rows = [shape(t) for t in part.column("text").to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *columns], ["doc_id", "text_key", *FEATURES])

    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(plain).alias("text_key"), plain.alias("text"))
    return rows.mapInArrow(work, "doc_id long, text_key long, " + ", ".join(f"{f} double" for f in FEATURES))


def fit_text_model(features: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 17) -> tuple[list[float], float]:
    """Coefficients and intercept from labelled documents (doc_id, good)."""
    labelled = features.join(labels, "doc_id")
    counts = {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    if len(counts) < 2:
        return [0.0] * len(FEATURES), 0.0
    share = min(RANGE, max(1, -(-rows * RANGE // sum(counts.values()))))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(RANGE)) < share)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(stored(chosen, "labelled"))
    fitted = LogisticRegression(featuresCol="x", labelCol="good", regParam=1e-4, maxIter=30).fit(vectors)
    return [float(c) for c in fitted.coefficients], float(fitted.intercept)


def logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(bounded / (1 - bounded))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-MOST_LOGIT), F.least(F.lit(MOST_LOGIT), x))))


def prior_strength(groups: DataFrame, mean: Column) -> float:
    """How many documents the prior of a group weighs, from groups (n, s, q) with sums of p and p²
    and the mean that each is expected to have: the method of moments for a beta prior."""
    rate = F.col("s") / F.col("n")
    sums = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(rate - mean, 2)).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("spread"),
    ).first()
    if not sums["n"] or sums["g"] < 2 or sums["n"] <= sums["g"]:
        return 1.0
    noise = sums["within"] / (sums["n"] - sums["g"])
    excess = (sums["between"] - (sums["g"] - 1) * noise) / (sums["n"] - sums["n2"] / sums["n"])
    if excess <= 0:
        return 1e6  # groups differ no more than by chance
    return min(1e6, max(1.0, sums["spread"] / sums["n"] / excess - 1))


def quality(docs: DataFrame, labels: DataFrame, sites: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text_key, host, path, p_text, p_site, p_good) per row of ``docs``.

    ``labels`` has (doc_id, quality 0 or 1), ``sites`` (doc_id, host, path) for some documents.
    """
    features = stored(text_features(docs, text), "features")
    good = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("double")).alias("good")
    )
    weights, intercept = fit_text_model(features, stored(good, "labels"), fit_rows)
    score = F.lit(intercept)
    for name, weight in zip(FEATURES, weights):
        score = score + F.lit(weight) * F.col(name)
    site = sites.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct("host", "path")).alias("site"))
    judged = features.select("doc_id", "text_key", sigmoid(score).alias("p")).join(stored(site, "sites"), "doc_id", "left").select(
        "doc_id", "text_key", "p", "site.host", "site.path"
    )
    judged = stored(judged, "evidence")

    overall = judged.agg(F.coalesce(F.avg("p"), F.lit(0.5)).alias("p")).first()["p"]
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = stored(judged.filter("host is not null").groupBy("host", "path").agg(*sums), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "hosts")
    host_strength = prior_strength(hosts, F.lit(overall))
    host_rate = (F.col("s") + host_strength * overall) / (F.col("n") + host_strength)
    within = paths.join(hosts.select("host", host_rate.alias("rate")), "host")
    path_strength = prior_strength(within, F.col("rate"))

    both = stored(
        paths.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")).join(
            hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host"
        ),
        "site-sums",
    )
    known = judged.join(both, judged["host"].eqNullSafe(both["host"]) & judged["path"].eqNullSafe(both["path"]), "left").select(
        "doc_id", "text_key", judged["host"], judged["path"], "p", "host_n", "host_s", "path_n", "path_s"
    )
    at_host = (F.col("host_s") - F.col("p") + host_strength * overall) / (F.col("host_n") - 1 + host_strength)
    at_path = (F.col("path_s") - F.col("p") + path_strength * at_host) / (F.col("path_n") - 1 + path_strength)
    p_site = F.coalesce(at_path, F.lit(overall))
    return known.select(
        "doc_id", "text_key", "host", "path", F.col("p").alias("p_text"), p_site.alias("p_site"),
        sigmoid(logit(F.col("p")) + logit(p_site) - logit(F.lit(overall))).alias("p_good"),
    )


def page_sites(pages: DataFrame) -> DataFrame:
    """(doc_id, host, path) from page addresses that end in the number of a document; A-Z of hosts
    are lower-cased, so that a site is one site."""
    url = F.col("url")
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2)
    return pages.select(
        F.regexp_extract(rest, r"/([0-9]+)(/|[.][a-z]+)?$", 1).try_cast("long").alias("doc_id"),
        host.alias("host"),
        F.regexp_extract(rest, r"^(/[^/]*/)", 1).alias("path"),
    ).filter(F.col("doc_id").isNotNull()).select("doc_id", "host", "path")
