"""Topic discovery: clusters of TF-IDF vectors and their leading terms."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.operators.tfidf import TfidfSettings, fit_vocabulary, vector_rows, weigh

CLUSTERS = 11
TERMS_PER_CLUSTER = 8


def topic_settings() -> TfidfSettings:
    return TfidfSettings(max_features=2500, min_df=3, sublinear_tf=False, strip_accents=False)


def discover_topics(
    docs: DataFrame,
    key: str = "conversation_id",
    text: str = "customer_message",
    clusters: int = CLUSTERS,
    terms: int = TERMS_PER_CLUSTER,
    starts: int = 10,
    seed: int = 42,
    settings: TfidfSettings | None = None,
) -> DataFrame:
    """(cluster, rank, term, weight) for the heaviest terms of each centroid; the best of
    ``starts`` runs is taken."""
    settings = settings or topic_settings()
    vocab = fit_vocabulary(docs, text, settings)
    table = vector_rows(docs, key, weigh(docs, key, text, vocab, settings), vocab.count())
    models = [KMeans(k=clusters, seed=seed + i, featuresCol="features").fit(table) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = [(f"Cluster_{i + 1}", [float(x) for x in centre]) for i, centre in enumerate(best.clusterCenters())]
    weights = docs.sparkSession.createDataFrame(centres, "cluster string, weights array<double>").select(
        "cluster", F.posexplode("weights").alias("term_id", "weight")
    )
    heaviest = W.partitionBy("cluster").orderBy(F.col("weight").desc(), "term")
    return (
        weights.join(vocab.select("term_id", "term"), "term_id")
        .withColumn("rank", F.row_number().over(heaviest))
        .filter(F.col("rank") <= terms)
        .select("cluster", "rank", "term", "weight")
    )
