"""TF-IDF vectors as long tables (id, term_id, weight)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carewise.functions.rulebook import STOP_WORDS
from carewise.functions.text import ngrams, tokens
from carewise.operators.termcount import COUNT_SCHEMA, counter
from carewise.session import broadcast_if_small, new_folder, stored


# Terms that a summary keeps for each one that the vocabulary wants.
SUMMARY_TERMS = 20


@dataclass(frozen=True)
class TfidfSettings:
    """What counts as a term and how terms are weighted."""

    max_features: int = 5000
    low: int = 1
    high: int = 2
    min_df: int = 1
    sublinear_tf: bool = True
    strip_accents: bool = True
    stop_words: Sequence[str] = STOP_WORDS


def document_text(message: Column, reply: Column) -> Column:
    return F.concat(F.coalesce(message, F.lit("")), F.lit(" "), F.coalesce(reply, F.lit("")))


def _counted(docs: DataFrame, text: str, settings: TfidfSettings, capacity: int | None = None) -> DataFrame:
    words = docs.select(tokens(F.col(text), (), settings.strip_accents).alias("words"))
    return words.mapInArrow(counter(settings.low, settings.high, tuple(settings.stop_words), capacity), COUNT_SCHEMA)


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_stats(docs: DataFrame, text: str, settings: TfidfSettings) -> DataFrame:
    """Document frequency and corpus frequency per term.

    Words are found by the engine and counted batch by batch; only sums per term are shuffled,
    neither texts nor (document, term) pairs.
    """
    return _added_up(_counted(docs, text, settings))


@dataclass(frozen=True)
class FrequentTerms:
    """Statistics in which the most frequent terms are exact, and how that is known.

    ``error`` bounds what the summaries can have missed of any term, ``least`` is the smallest count
    that is certain for the wanted number of terms, ``candidates`` how many terms may reach it.
    ``certified`` says that no other term can; if not, all terms were counted.
    """

    stats: DataFrame
    error: int
    least: int
    candidates: int | None
    certified: bool


def frequent_terms(docs: DataFrame, text: str, settings: TfidfSettings, capacity: int | None = None) -> FrequentTerms:
    """The statistics of at least the ``max_features`` most frequent terms.

    Every task sums up its documents in a summary of ``capacity`` terms, so that no more than that leaves
    it however many different terms there are. If no task had to drop a term, these sums are exact.
    Otherwise the terms that may be among the most frequent ones are counted again, exactly.
    """
    capacity = capacity or SUMMARY_TERMS * settings.max_features
    summed = _counted(docs, text, settings, capacity).groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.sum("error").alias("error"))
    summary = stored(summed, "term-summary")
    error = summary.agg(F.coalesce(F.sum("error"), F.lit(0)).alias("e")).first()["e"]
    terms = summary.filter("term IS NOT NULL").select("term", "df", "cf")
    if not error:
        return FrequentTerms(terms, 0, 0, None, True)
    sure = terms.filter(F.col("df") >= settings.min_df).orderBy(F.col("cf").desc()).limit(settings.max_features)
    row = sure.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("least")).first()
    least = row["least"] if row["n"] == settings.max_features else 0
    if least <= error:
        return FrequentTerms(term_stats(docs, text, settings), error, least, None, False)
    able = stored(terms.filter(F.col("cf") + error >= least).select("term"), "candidates")
    wanted, _ = broadcast_if_small(able)
    again = _added_up(_counted(docs, text, settings).join(wanted, "term", "left_semi"))
    return FrequentTerms(again, error, least, able.count(), True)


def document_terms(docs: DataFrame, key: str, text: str, settings: TfidfSettings, tasks: int | None = None) -> DataFrame:
    """(key, term, tf) for every term of ``docs``.

    The texts are shuffled once by key; counting, and every later step per document, then
    runs where the document is. Spark sizes the tasks, unless their number is given for a
    large table, whose texts grow many times when they are cut into terms.
    """
    texts = docs.select(F.col(key), F.col(text).alias("_text"))
    placed = texts.repartition(F.col(key)) if tasks is None else texts.repartition(tasks, F.col(key))
    words = placed.select(
        F.col(key), tokens(F.col("_text"), settings.stop_words, settings.strip_accents).alias("_words")
    )
    terms = words.select(F.col(key), F.explode(ngrams(F.col("_words"), settings.low, settings.high)).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def stats_of(counts: DataFrame) -> DataFrame:
    """The statistics of ``term_stats`` from counted documents; those of several tables add up."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def vocabulary(docs: DataFrame, text: str, settings: TfidfSettings) -> DataFrame:
    """The most frequent terms with their inverse document frequency, numbered by term.

    Ties are cut by term, so the table does not depend on partitioning. It has
    ``max_features`` rows at most.
    """
    return vocabulary_of(frequent_terms(docs, text, settings).stats, docs.agg(F.count(F.lit(1))).scalar(), settings)


def vocabulary_of(stats: DataFrame, total: Column, settings: TfidfSettings) -> DataFrame:
    """The vocabulary of ``total`` documents with these statistics."""
    kept = stats.filter(F.col("df") >= settings.min_df).orderBy(F.col("cf").desc(), "term").limit(settings.max_features)
    return kept.select(
        "term",
        (F.row_number().over(W.orderBy("term")) - 1).alias("term_id"),
        "df",
        "cf",
        total.alias("n_docs"),
        (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
    )


def weigh(
    docs: DataFrame, key: str, text: str, vocab: DataFrame, settings: TfidfSettings, tasks: int | None = None
) -> DataFrame:
    """Unit-length vectors of ``docs`` over ``vocab``; terms outside it are ignored."""
    return weigh_counts(document_terms(docs, key, text, settings, tasks), key, vocab, settings)


def weigh_counts(counts: DataFrame, key: str, vocab: DataFrame, settings: TfidfSettings) -> DataFrame:
    """The same from counted documents. Terms are counted before the vocabulary is joined, so that a
    join by term moves no repeated terms."""
    counts = counts.join(vocab.select("term", "term_id", "idf"), "term").drop("term")
    tf = F.lit(1.0) + F.log(F.col("tf").cast("double")) if settings.sublinear_tf else F.col("tf").cast("double")
    raw = counts.select(F.col(key), "term_id", (tf * F.col("idf")).alias("_raw"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy(key)))
    return raw.select(F.col(key), "term_id", (F.col("_raw") / norm).alias("weight"))


def fit_vocabulary(docs: DataFrame, text: str, settings: TfidfSettings) -> DataFrame:
    """The vocabulary as a stored table, marked for broadcast if its measured size allows."""
    return broadcast_if_small(stored(vocabulary(docs, text, settings), "vocabulary"))[0]


def vector_rows(
    docs: DataFrame, key: str, vectors: DataFrame, size: int, columns: Sequence[str] = ()
) -> DataFrame:
    """One MLlib vector per row of ``docs``; rows without a known term get the zero vector.

    The sparse struct is written as a table and read back with the vector type, which
    turns native columns into vectors and cuts the lineage before iterative training.
    """
    grouped = vectors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("_terms"))
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.coalesce(F.col("_terms.term_id"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.col("_terms.weight"), F.array().cast("array<double>")).alias("values"),
    )
    table = docs.select(key, *columns).join(grouped, key, "left").select(key, *columns, sparse.alias("features"))
    path = new_folder(docs.sparkSession, "vectors")
    table.write.parquet(path)
    schema = T.StructType(
        [f if f.name != "features" else T.StructField("features", VectorUDT()) for f in table.schema.fields]
    )
    return docs.sparkSession.read.schema(schema).parquet(path)
