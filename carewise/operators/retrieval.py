"""Similarity top-k join of messages with historical conversations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.functions.text import is_blank
from carewise.operators.tfidf import (
    TfidfSettings,
    document_terms,
    document_text,
    fit_vocabulary,
    stats_of,
    vocabulary_of,
    weigh,
    weigh_counts,
)
from carewise.operators.topk import BLOCK_SCHEMA, GROUP_QUERIES, best_hits, blocks_of, part_count
from carewise.session import broadcast_if_small, shuffle_tasks, stored

TOP_K = 3
THRESHOLD = 0.15


class Retriever(Protocol):
    """What the scoring job needs from an index; users may bring another one."""

    def search(self, queries: DataFrame, key: str, text: str, top_k: int, threshold: float) -> DataFrame: ...

    def save(self, path: str) -> None: ...


@dataclass(frozen=True)
class ConversationIndex:
    """A fitted index: vocabulary, unit vectors and the conversations themselves.

    For searches it is laid out in parts of documents, each with a block of postings per term.
    A saved index keeps its blocks as a table that is bucketed by part and sorted by term, so that
    a search reads them in place, and the term counts of its documents, from which ``append``
    makes the index of more documents.
    """

    vocab: DataFrame
    postings: DataFrame  # (doc_id, term_id, weight)
    corpus: DataFrame  # (doc_id, customer_message, support_reply)
    settings: TfidfSettings
    scratch: str | None = None  # where searches keep their tables; by default each in a new folder
    counts: DataFrame | None = None  # (doc_id, term, tf) of all terms
    parts: int = 0
    blocks: DataFrame | None = None  # (part, term_id, documents, weights, most)
    places: DataFrame | None = None  # (part, number, doc_id)

    @classmethod
    def fit(cls, conversations: DataFrame, settings: TfidfSettings | None = None, key: str = "conversation_id") -> ConversationIndex:
        settings = settings or TfidfSettings()
        corpus = _corpus(conversations, key)
        docs = _documents(corpus)
        vocab = fit_vocabulary(docs, "doc_text", settings)
        postings = weigh(docs, "doc_id", "doc_text", vocab, settings, shuffle_tasks(corpus.sparkSession))
        return cls(vocab, postings, corpus, settings)

    @classmethod
    def _of_counts(cls, counts: DataFrame, corpus: DataFrame, settings: TfidfSettings) -> ConversationIndex:
        total = corpus.agg(F.count(F.lit(1))).scalar()
        vocab, _ = broadcast_if_small(stored(vocabulary_of(stats_of(counts), total, settings), "vocabulary"))
        return cls(vocab, weigh_counts(counts, "doc_id", vocab, settings), corpus, settings, counts=counts)

    def append(self, conversations: DataFrame, key: str = "conversation_id") -> ConversationIndex:
        """The index of these conversations too, equal to one that is fitted on all of them.

        Only the texts of new conversations are cut into terms; vocabulary, document frequencies and
        weights follow from the counts of all. Conversations whose key is there already are left out.
        """
        corpus = _corpus(conversations, key).join(self.corpus.select("doc_id"), "doc_id", "left_anti")
        corpus = stored(corpus.dropDuplicates(["doc_id"]), "appended")
        counts = self._counts().unionByName(document_terms(_documents(corpus), "doc_id", "doc_text", self.settings))
        return self._of_counts(stored(counts, "counts"), self.corpus.unionByName(corpus), self.settings)

    def _counts(self) -> DataFrame:
        if self.counts is not None:
            return self.counts
        tasks = shuffle_tasks(self.corpus.sparkSession)
        return document_terms(_documents(self.corpus), "doc_id", "doc_text", self.settings, tasks)

    def laid_out(self) -> ConversationIndex:
        """The same index with its blocks as stored tables, for several searches in one session."""
        if self.blocks is not None:
            return self
        postings = stored(self.postings, "postings", self.scratch)
        parts = part_count(self.corpus.count(), postings.count(), shuffle_tasks(self.corpus.sparkSession))
        blocks, places = blocks_of(postings, parts)
        return replace(
            self, postings=postings, parts=parts,
            blocks=stored(blocks, "blocks", self.scratch), places=broadcast_if_small(stored(places, "places", self.scratch))[0],
        )

    def save(self, path: str) -> None:
        """Write the index. Its blocks are written by part, one file each, sorted by term."""
        spark = self.corpus.sparkSession
        own = self.laid_out()
        own.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        own.postings.write.mode("overwrite").parquet(f"{path}/postings")
        own.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        own._counts().write.mode("overwrite").parquet(f"{path}/counts")
        own.places.write.mode("overwrite").parquet(f"{path}/places")
        name = _table_name(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        lying = own.blocks.repartition(own.parts, "part").write.bucketBy(own.parts, "part").sortBy("part", "term_id")
        lying.option("path", f"{path}/blocks").mode("overwrite").format("parquet").saveAsTable(name)
        s = self.settings
        spark.range(1).select(
            F.lit(own.parts).alias("parts"),
            F.lit(s.max_features).alias("max_features"),
            F.lit(s.low).alias("low"),
            F.lit(s.high).alias("high"),
            F.lit(s.min_df).alias("min_df"),
            F.lit(s.sublinear_tf).alias("sublinear_tf"),
            F.lit(s.strip_accents).alias("strip_accents"),
            F.lit(list(s.stop_words)).cast("array<string>").alias("stop_words"),
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ConversationIndex:
        """Read a saved index; a path without one is an error."""
        row = spark.read.parquet(f"{path}/settings").first().asDict()
        parts = row.pop("parts")
        settings = TfidfSettings(**{**row, "stop_words": tuple(row["stop_words"])})
        vocab, _ = broadcast_if_small(spark.read.parquet(f"{path}/vocab"))
        places, _ = broadcast_if_small(spark.read.parquet(f"{path}/places"))
        return cls(
            vocab, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"), settings,
            counts=spark.read.parquet(f"{path}/counts"), parts=parts, blocks=_bucketed(spark, path, parts), places=places,
        )

    def search(
        self,
        queries: DataFrame,
        key: str = "query_id",
        text: str = "query",
        top_k: int = TOP_K,
        threshold: float = THRESHOLD,
        exclude_self: bool = False,
        group_queries: int = GROUP_QUERIES,
    ) -> DataFrame:
        """The ``top_k`` most similar conversations per query, ranked from 1.

        Columns: the query key, rank, conversation_id, customer_message, support_reply,
        similarity_score (4 places). Ties go to the smaller id. Blank queries give no rows.
        A query key must be unique, as must the key of a document.

        Every part of the index meets every group of queries once, in one shuffle of the queries;
        its best ``top_k`` rows per query are all that leaves a part.
        """
        index = self.laid_out()
        asked = queries.select(F.col(key).alias("query_id"), F.col(text).alias("query_text"))
        asked = asked.filter(~is_blank(F.col("query_text")))
        vectors = weigh(asked, "query_id", "query_text", self.vocab, self.settings)
        wanted = stored(vectors, "query-vectors", self.scratch)
        found = best_hits(index.blocks, index.places, wanted, index.parts, top_k, threshold, exclude_self, group_queries)
        hits = _ranked(found, top_k)
        if threshold <= 0:
            hits = _ranked(hits.drop("rank").unionByName(self._fillers(asked, hits, top_k, exclude_self)), top_k)
        else:
            hits, _ = broadcast_if_small(stored(hits, "hits", self.scratch))
        return self.corpus.join(hits, "doc_id").select(
            F.col("query_id").alias(key),
            "rank",
            F.col("doc_id").alias("conversation_id"),
            "customer_message",
            "support_reply",
            F.round("score", 4).alias("similarity_score"),
        )

    def _fillers(self, asked: DataFrame, hits: DataFrame, top_k: int, exclude_self: bool) -> DataFrame:
        """Documents of score 0 for queries short of hits, smallest ids first. A query has fewer
        than ``top_k`` hits, so the smallest 2 * top_k + 1 ids always hold enough others."""
        spares = [r[0] for r in self.corpus.select("doc_id").orderBy("doc_id").limit(2 * top_k + 1).collect()]
        offered = asked.select("query_id", F.explode(F.lit(spares)).alias("doc_id"))
        if exclude_self:
            offered = offered.filter(F.col("query_id") != F.col("doc_id"))
        return offered.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn(
            "score", F.lit(0.0)
        )


def _ranked(scores: DataFrame, top_k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def _corpus(conversations: DataFrame, key: str) -> DataFrame:
    return conversations.select(F.col(key).alias("doc_id"), "customer_message", "support_reply")


def _documents(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", document_text(F.col("customer_message"), F.col("support_reply")).alias("doc_text"))


def _table_name(path: str) -> str:
    return f"carewise_blocks_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def _bucketed(spark: SparkSession, path: str, parts: int) -> DataFrame:
    """The saved blocks as a table of the catalog, which knows how they lie."""
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({BLOCK_SCHEMA}) USING parquet LOCATION '{path.rstrip('/')}/blocks' "
        f"CLUSTERED BY (part) SORTED BY (part, term_id) INTO {parts} BUCKETS"
    )
    return spark.table(name)
