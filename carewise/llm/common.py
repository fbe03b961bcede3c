"""What several operators share: whole texts in Arrow batches, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carewise.session import stored

BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row beyond that."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def map_texts(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """``work`` on every slice of whole rows; it may return fewer or more rows, or None."""

    def run(batches):
        for part in sliced(batches, text):
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    return docs.mapInArrow(run, schema)


EDGE_BLOCK = 1 << 18


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) replaced, block by block, by edges to the smallest node each is connected with."""

    def flat(block: list[tuple]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for u, v in block:
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(batch.column("u").to_pylist(), batch.column("v").to_pylist())
            if len(held) >= EDGE_BLOCK:
                yield flat(held)
                held = []
        if held:
            yield flat(held)

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``, the component being its smallest node.

    Blocks of edges are contracted where they lie. Then the two star steps of label contraction
    alternate with that: larger neighbours, then smaller ones, are linked to the smallest node of
    the neighbourhood, until every node has one edge, to a smallest node. Every round is a
    written table, edges never get more, and a hub is aggregated before the shuffle.
    """
    start = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stored(_contracted(start), "edges")
    while True:
        ends = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        inner = now.select(F.col("v").alias("u")).distinct().join(ends, "u", "left_semi")
        if not ends.filter("n > 1").select("u").unionByName(inner).take(1):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "large-star")
        down = stored(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select("u", "v", "m")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(_contracted(small.distinct()), "small-star")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
