"""Top-k search of many query vectors in a part of an index, in tasks of bounded size.

An index is cut into parts of documents. A part has a block per term: the documents that hold the
term, by number, their weights, and the largest of these. A search meets every part with every
group of queries in one shuffle; nothing is summed across tasks, and only the best rows of a part leave it.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Most documents and postings of a part, most queries and terms of a group.
PART_DOCUMENTS = 32_768
PART_POSTINGS = 4_000_000
GROUP_QUERIES = 65_536
GROUP_TERMS = 2_000_000
# Parts that an index has at least, if its size and the number of tasks allow.
LEAST_PARTS = 24
# Queries and terms that travel in one row.
BUNDLE_QUERIES = 256
BUNDLE_TERMS = 65_536
# Queries that share one table of scores, documents of it, cells of the table of weights, and terms added at once.
TILE = 256
SLAB = 2048
# Documents of the first slab of a part, which give the others a floor.
FIRST_SLAB = 192
DENSE_CELLS = 16_000_000
ADDED_TERMS = 256
# Terms that can't add more than this share of what a document must reach are looked up for few documents only.
LEFT_SHARE = 0.15
# Scores count with this many places, for the threshold as for the order.
SCORE_PLACES = 9
# Most that one product or sum of single precision is off, of values up to 1.
SINGLE_ERROR = 1.2e-7

BLOCK_SCHEMA = "part int, term_id int, documents array<int>, weights array<double>, most double"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def part_count(documents: int, postings: int, tasks: int) -> int:
    """Parts of an index. Their number grows with the documents only where parts would get too large: queries go to every part."""
    return max(1, min(tasks, LEAST_PARTS), -(-documents // PART_DOCUMENTS), -(-postings // PART_POSTINGS))


def part_of(parts: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


def blocks_of(postings: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (part, term_id, documents, weights, most) and places (part, number, doc_id) of
    postings. Documents of a part are numbered by id."""
    placed = postings.withColumn("part", part_of(parts)).repartition(parts, "part")
    numbered = placed.withColumn("number", (F.dense_rank().over(W.partitionBy("part").orderBy("doc_id")) - 1).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("number", "weight")))
    grouped = numbered.groupBy("part", "term_id").agg(listed.alias("l"), F.max("weight").alias("most"))
    blocks = grouped.select("part", "term_id", F.col("l.number").alias("documents"), F.col("l.weight").alias("weights"), "most")
    places = postings.select("doc_id").distinct().withColumn("part", part_of(parts))
    places = places.withColumn("number", (F.row_number().over(W.partitionBy("part").orderBy("doc_id")) - 1).cast("int"))
    return blocks, places


class Part:
    """The blocks of a part as arrays."""

    def __init__(self, blocks: pa.Table):
        documents, weights = (blocks.column(c).combine_chunks() for c in ("documents", "weights"))
        self.sizes = np.asarray(pa.compute.list_value_length(documents), dtype=np.int64)
        self.documents, self.weights = np.asarray(documents.flatten()), np.asarray(weights.flatten())
        self.rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.most = np.asarray(blocks.column("most").combine_chunks())
        self.row_of = {t: i for i, t in enumerate(blocks.column("term_id").to_pylist())}
        self.size = int(self.documents.max()) + 1 if len(self.documents) else 0


class Slab:
    """Some documents of a part: postings by block, and the longest blocks as rows of a table in single precision."""

    def __init__(self, part: Part, first: int, end: int):
        inside = (part.documents >= first) & (part.documents < end)
        self.first, self.width = first, end - first
        self.rows, self.documents, self.weights = part.rows[inside], part.documents[inside].astype(np.int64) - first, part.weights[inside]
        self.keys = self.rows * self.width + self.documents  # ascending, as blocks list documents by number
        self.sizes = np.bincount(self.rows, minlength=len(part.sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        longest = np.argsort(-self.sizes, kind="stable")[:DENSE_CELLS // self.width]
        self.place = np.full(len(part.sizes), -1)
        self.place[longest] = np.arange(len(longest))
        self.dense = np.zeros((len(longest), self.width), dtype=np.float32)
        held = self.place[self.rows] >= 0
        self.dense[self.place[self.rows[held]], self.documents[held]] = self.weights[held]

    def exact(self, row: np.ndarray, document: np.ndarray) -> np.ndarray:
        """The weights of terms in documents."""
        keys = row * self.width + document
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.weights[at], 0.0)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some stretches one after the other, and which stretch each comes from."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes), which


def _order(part: Part, owner: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The terms of the queries, each query's short blocks first, and the most that a document
    can get from a term and those behind it: the sum of the blocks' maxima, or the length of that
    part of the query, as documents have length 1."""
    order = np.lexsort((row, part.sizes[row], owner))
    owner, row, weight = owner[order], row[order], weight[order]
    ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(owner) - 1)

    def from_here(values: np.ndarray) -> np.ndarray:
        """Sums up to the end of the own query, each over its own few values."""
        back = np.cumsum(values[::-1])[::-1]
        behind = np.append(back[1:], 0.0)[ends]
        return back - np.repeat(behind, np.diff(np.append(-1, ends)))

    length = np.sqrt(np.maximum(from_here(weight * weight), 0.0))
    return owner, row, weight, np.minimum(from_here(weight * part.most[row]), length)


def _leading(query: np.ndarray, score: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by query and falling score, and the rank of each within its query. Of equal scores the earlier one leads."""
    order = np.lexsort((-score, query))
    return order, np.arange(len(order)) - np.searchsorted(query[order], query[order])


def best_of_tile(slab: Slab, owner, row, weight, bound, own: np.ndarray, floor: np.ndarray, top_k: int, threshold: float):
    """(query, document, score) of the best documents of a slab, and how many products it took.

    ``own`` is the document a query must not find, or a negative number; ``floor`` is what a document must
    reach, the threshold or what the query has found elsewhere. A query's terms are added up in single precision for all documents of the slab, those of short
    blocks first, until the terms left can add but a share of the floor. Documents stay in whose sum and what
    the left terms may add reach the floor or the k-th best sum; only for these the left terms are looked up. What is
    then among the best, give or take the error of single precision, gets its exact score.
    """
    tile = len(own)
    place = slab.place[row]
    now = (bound >= LEFT_SHARE * floor[owner]) | (place < 0)
    left = np.flatnonzero(~now)
    rest = np.zeros(tile)
    np.maximum.at(rest, owner[left], bound[left])
    begins = np.searchsorted(owner, np.arange(tile + 1))
    length = np.sqrt(np.bincount(owner, weight * weight, tile))
    slack = SINGLE_ERROR * (np.diff(begins) + 4) * np.maximum(length, 1.0) + 10.0**-SCORE_PLACES

    scores = np.zeros((tile, slab.width), dtype=np.float32)
    near = np.flatnonzero(now & (place >= 0))
    cuts, narrow = np.searchsorted(owner[near], np.arange(tile + 1)), weight[near].astype(np.float32)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        for a in range(cuts[i], cuts[i + 1], ADDED_TERMS):
            b = min(a + ADDED_TERMS, cuts[i + 1])
            scores[i] += narrow[a:b] @ slab.dense.take(place[near[a:b]], axis=0)
    short = np.flatnonzero(place < 0)
    at, which = _spread(slab.starts[row[short]], slab.sizes[row[short]])
    np.add.at(scores.reshape(-1), owner[short][which] * slab.width + slab.documents[at], (weight[short][which] * slab.weights[at]).astype(np.float32))
    products = int(slab.sizes[row[now]].sum())

    banned = np.flatnonzero((own >= slab.first) & (own < slab.first + slab.width))
    scores[banned, own[banned] - slab.first] = -1.0
    if slab.width > top_k:
        # Where an earlier slab has raised the floor, that is enough.
        new = np.flatnonzero(floor <= threshold)
        floor[new] = np.maximum(floor[new], np.partition(scores[new], -top_k, axis=1)[:, -top_k])
    least = np.maximum(floor - rest - slack, np.finfo(np.float32).tiny).astype(np.float32)
    cells = np.flatnonzero(scores >= least[:, None])
    query, document = cells // slab.width, cells % slab.width
    found = scores.reshape(-1)[cells].astype(np.float64)

    behind = np.searchsorted(owner[left], np.arange(tile + 1))
    at, which = _spread(behind[query], behind[query + 1] - behind[query])
    added = slab.dense[place[left[at]], document[which]]
    found += np.bincount(which, weight[left[at]] * added, len(found))
    products += int(np.count_nonzero(added))
    order, rank = _leading(query, found, top_k)
    last = order[rank == top_k - 1]
    floor[query[last]] = np.maximum(floor[query[last]], found[last] - slack[query[last]])
    kept = found >= floor[query] - slack[query]
    query, document = query[kept], document[kept]

    at, which = _spread(begins[query], begins[query + 1] - begins[query])
    exact = np.bincount(which, weight[at] * slab.exact(row[at], document[which]), len(query))
    products += len(at)
    return query, document + slab.first, np.floor(exact * 10.0**SCORE_PLACES + 0.5) / 10.0**SCORE_PLACES, products


def best_of_part(part: Part, queries: pa.Table, own: np.ndarray, top_k: int, threshold: float):
    """The best documents of a part for a group of queries (terms, weights), slab by slab and tile by tile.

    What a query has found in one slab is what documents of the next must reach.
    """
    terms, weights = (queries.column(c).combine_chunks() for c in ("terms", "weights"))
    sizes = np.asarray(pa.compute.list_value_length(terms), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    row = np.fromiter((part.row_of.get(t, -1) for t in terms.flatten().to_pylist()), np.int64, len(owner))
    known = row >= 0
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not known.any():
        return *empty, 0
    owner, row, weight, bound = _order(part, owner[known], row[known], np.asarray(weights.flatten())[known])
    floor, found, products = np.full(len(sizes), float(threshold)), [], 0
    cuts = [0, *range(min(FIRST_SLAB, SLAB), part.size, SLAB), part.size]
    for first, end in zip(cuts, cuts[1:]):
        slab = Slab(part, first, end)
        parts = []
        for start in range(0, len(sizes), TILE):
            a, b = np.searchsorted(owner, [start, start + TILE])
            if a < b:
                cut = slice(start, start + TILE)
                q, d, s, n = best_of_tile(slab, owner[a:b] - start, row[a:b], weight[a:b], bound[a:b], own[cut], floor[cut].copy(), top_k, threshold)
                parts.append((q + start, d, s))
                products += n
        q, d, s = (np.concatenate(c) for c in zip(*parts))
        order, rank = _leading(q, s, top_k)
        kept = order[(rank < top_k) & (s[order] >= threshold)]
        last = order[rank == top_k - 1]
        floor[q[last]] = np.maximum(floor[q[last]], s[last])
        found.append((q[kept], d[kept], s[kept]))
    q, d, s = (np.concatenate(c) for c in zip(*found))
    order, rank = _leading(q, s, top_k)
    best = order[rank < top_k]
    return q[best], d[best], s[best], products


def best_hits(
    blocks: DataFrame,
    places: DataFrame,
    vectors: DataFrame,
    parts: int,
    top_k: int,
    threshold: float,
    exclude_self: bool = False,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """(query_id, doc_id, score): the best documents of every part for every query.

    ``vectors`` has (query_id, term_id, weight). Parts stay where they are: the queries, bundled in rows,
    go to every part. Above ``group_queries`` queries, or so many terms, parts meet each group of queries
    in a task of its own. A part has a bounded number of documents and postings, so that a term or
    query that everybody uses makes no task larger than the others.
    """
    kind = dict(vectors.dtypes)["query_id"]
    rows = vectors.groupBy("query_id").agg(F.collect_list("term_id").alias("terms"), F.collect_list("weight").alias("weights"))
    size = vectors.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("terms")).first()
    groups = max(1, -(-size["queries"] // group_queries), -(-size["terms"] // GROUP_TERMS))
    bundles = groups * max(1, -(-size["queries"] // (groups * BUNDLE_QUERIES)), -(-size["terms"] // (groups * BUNDLE_TERMS)))
    own = [F.lit(-1).alias("own_part"), F.lit(-1).alias("own")]
    if exclude_self:
        placed = places.select(F.col("doc_id").alias("own_id"), F.col("part").alias("own_part"), F.col("number").alias("own"))
        rows = rows.join(placed, rows["query_id"] == placed["own_id"], "left")
        own = [F.coalesce("own_part", F.lit(-1)).alias("own_part"), F.coalesce("own", F.lit(-1)).alias("own")]
    bundled = rows.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(bundles)).cast("int").alias("bundle")).agg(
        F.collect_list(F.struct("query_id", "terms", "weights", *own)).alias("queries"))
    asked = bundled.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["part"]
    if groups > 1:
        keys = ["part", "cell"]
        asked = asked.withColumn("cell", F.pmod("bundle", F.lit(groups)))
        blocks = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.select(*keys, "queries")

    def meet(bundles: pa.Table, own_blocks: pa.Table) -> pa.Table:
        queries = bundles.column("queries").combine_chunks().flatten()
        names = ["query_id", "part", "number", "score"]
        if not len(queries) or not own_blocks.num_rows:
            empty = [queries.field("query_id")[:0], pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.float64())]
            return pa.table(empty, names=names)
        number = own_blocks.column("part")[0].as_py()
        own = np.where(np.asarray(queries.field("own_part")) == number, np.asarray(queries.field("own"), dtype=np.int64), -1)
        table = pa.table([queries.field("terms"), queries.field("weights")], names=["terms", "weights"])
        q, d, s, _ = best_of_part(Part(own_blocks), table, own, top_k, threshold)
        return pa.table([queries.field("query_id").take(pa.array(q)), pa.array(np.full(len(q), number), pa.int32()),
                         pa.array(d, pa.int32()), pa.array(s)], names=names)

    met = asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(meet, f"query_id {kind}, part int, number int, score double")
    return met.join(places, ["part", "number"]).select("query_id", "doc_id", "score")
