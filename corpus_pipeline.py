"""The corpus pipeline: documents through five operators, each reading what the last one wrote.

Rows are judged by id and text together, so documents that repeat an id stay apart. Texts change
in the stages of line dedup and secrets; n_chars follows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carewise.llm.line_dedup import LineIndex
from carewise.llm.ngram_join import similar_components
from carewise.llm.packing import pack_documents
from carewise.llm.quality import page_sites, quality
from carewise.llm.queries import GOOD, LINE_LIMIT
from carewise.llm.secrets_crf import learn, redact
from carewise.session import broadcast_if_small, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near duplicates share this part of their word 5-grams.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with the given text and its length."""
    size = F.char_length(text).cast("long")
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.coalesce(size, F.lit(0).cast("long")).alias("n_chars"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents without the rows of ``rejected`` (doc_id, text_key)."""
    gone, _ = broadcast_if_small(stored(rejected.distinct(), "rejected"))
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["_key"] == gone["text_key"])
    return keyed.join(gone, same, "left_anti").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely bad than good go."""
    labels, pages = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("labels", "pages"))
    rated = quality(docs, labels, page_sites(pages))
    return _without(docs, rated.filter(F.col("p_good") < GOOD).select("doc_id", "text_key"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many of these documents go from all of them."""
    return _documents(LineIndex.build(docs, LINE_LIMIT).drop_lines(docs), "kept_text")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, by the smallest id and then a hash of the text; null is the smallest id.

    Rows are numbered when they are stored, so that rows that repeat an id or are null stay apart.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = similar_components(numbered.select(F.col("_row").alias("doc_id"), "text"), width=NEAR_WIDTH, percent=NEAR_PERCENT)
    members = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    near = stored(groups.join(members, "component_id").select(F.col("doc_id").alias("_row"), "component_id"), "near-copies")
    sent, _ = broadcast_if_small(near)
    text = F.coalesce("text", F.lit(""))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64(text), F.xxhash64(text, F.lit(1)), "_row")
    ranked = numbered.join(sent, "_row").select("component_id", order.alias("order"))
    first = ranked.groupBy("component_id").agg(F.min("order")["_row"].alias("_row"))
    gone = stored(near.join(first, "_row", "left_anti").select("_row"), "gone")
    marked, _ = broadcast_if_small(gone)
    return numbered.join(marked, "_row", "left_anti").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _documents(redact(docs, learn(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

# The first and the fourth stage are trained models, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
