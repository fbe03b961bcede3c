"""Exact Jaccard self-join of documents on word n-grams, with set-relation skipping.

Two documents are linked when ``100 * |intersection| >= percent * |union|`` of their shingle
sets. Equal sets are one set. Every set indexes its rarest elements only (a prefix in one global
order), so two linked sets meet in at least one list. What the join skips:

* in a list, by position: entries are ordered by set size and position, and two entries are
  passed over when even a full overlap behind their positions could not reach the limit;
* by answers: the overlap of a set with the centre of its neighbourhood is computed first. If x
  and y were both compared with c, then |x n y| <= min(|x n c|, |y n c|) + min(|x| - |x n c|,
  |y| - |y n c|), so most pairs follow from the answers of c without being compared;
* by profile: sets are compared in full only if counts of their elements by first byte allow it;
* by links: two sets that are connected already need no further comparison, since the result is
  the component of each document. Groups of near copies thus cost one comparison per member.

The order puts elements that many sets share last, the more the later. It only steers the work:
links do not depend on it. Shingles are 64-bit hashes; sets are identified by 128 bits.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with
nothing; a text shorter than the n-gram has its whole sequence as its one shingle; an empty table
gives an empty result; rows that repeat a doc_id are separate documents with the same id; null
ids form components by text like all others, null being the smallest id. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carewise.llm.common import components, map_texts, sliced
from carewise.llm.shingles import BATCH, shingle_sets
from carewise.session import broadcast_if_small, stored

WIDTH = 4
PERCENT = 85
# Elements whose place in the global order follows their frequency; all others follow by hash.
ORDERED_ELEMENTS = 1 << 18
COUNT_BLOCK = 1 << 21
# Rows of a centre's neighbours that one copy of the centre meets.
NEIGHBOURS_PER_SALT = 512
PAIR_BLOCK = 1 << 20

NO_SET = 0


def needed_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection size with which sets of these sizes are linked."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ------------------------------------------------------------ global order

def shared_elements(docs: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements that occur most often, sorted, and the rank of each by frequency.

    Elements are counted within blocks of some two million; those that occur once in a block are
    not passed on, so single elements are never shuffled. At most ORDERED_ELEMENTS come back.
    """

    def count(batches):
        held, size = [], 0
        for part in sliced(batches, most=BATCH):
            for elements in shingle_sets(part.column(0).to_pylist(), width, seed):
                held.append(elements)
                size += len(elements)
            if size >= COUNT_BLOCK:
                yield _repeated(held)
                held, size = [], 0
        if held:
            yield _repeated(held)

    counts = docs.select("text").mapInArrow(count, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    counts = stored(counts, "shared-elements")
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.col("size").desc()).collect()
    least, total = None, 0
    for row in sizes:  # at most 63 rows: powers of two
        total += row["count"]
        if total > ORDERED_ELEMENTS:
            break
        least = 2 ** row["size"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    found = counts.filter(F.col("n") >= least).toPandas()
    element = found["element"].to_numpy().view(np.uint64)
    by_count = np.lexsort((element, found["n"].to_numpy()))
    rank = np.empty(len(element), dtype=np.int64)
    rank[by_count] = np.arange(len(element))
    by_element = np.argsort(element)
    return element[by_element], rank[by_element]


def _repeated(held: list[np.ndarray]) -> pa.RecordBatch:
    element, n = np.unique(np.concatenate(held), return_counts=True)
    many = n > 1
    return pa.RecordBatch.from_arrays([pa.array(_signed(element[many])), pa.array(n[many].astype(np.int64))], ["element", "n"])


def ordered_prefix(elements: np.ndarray, shared: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """The first ``length`` elements in the global order, and how many of the set are not shared."""
    if not len(shared):
        return elements[:length], len(elements)
    at = np.searchsorted(shared, elements)
    at[at == len(shared)] = 0
    known = shared[at] == elements
    rare = elements[~known]
    if len(rare) >= length:
        return rare[:length], len(rare)
    frequent = elements[known][np.argsort(rank[at[known]], kind="stable")]
    return np.concatenate((rare, frequent[: length - len(rare)])), len(rare)


# ------------------------------------------------------------ sets and postings

def _ids(elements: np.ndarray) -> tuple[int, int]:
    """The id of a set and a second hash by which equal ids of different sets are noticed."""
    digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def profile_of(elements: np.ndarray) -> bytes:
    """How many elements start with each byte; 255 stands for that many or more."""
    return np.minimum(np.bincount((elements >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """(doc_id, n, set_id, check, rare, prefix, profile) per document; prefix and profile only where
    a task meets a set for the first time, so that copies are dropped before any shuffle."""
    shared, rank = shared_elements(docs, width, seed)

    def work(batches):
        met = set()
        for part in sliced(batches, most=BATCH):
            n, ids, checks, rares, prefixes, profiles = [], [], [], [], [], []
            for elements in shingle_sets(part.column("text").to_pylist(), width, seed):
                set_id, check = _ids(elements)
                prefix, rare, profile = None, 0, None
                if len(elements) and set_id not in met:
                    met.add(set_id)
                    length = int(prefix_length(np.int64(len(elements)), percent))
                    first, rare = ordered_prefix(elements, shared, rank, length)
                    prefix = _signed(np.ascontiguousarray(first))
                    profile = profile_of(elements)
                n.append(len(elements))
                ids.append(set_id if len(elements) else None)
                checks.append(check)
                rares.append(rare)
                prefixes.append(prefix)
                profiles.append(profile)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(checks, pa.int64()),
                 pa.array(rares, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(profiles, pa.binary())],
                ["doc_id", "n", "set_id", "check", "rare", "prefix", "profile"],
            )

    return docs.mapInArrow(work, "doc_id long, n long, set_id long, check long, rare long, prefix array<long>, profile binary")


def _live_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Entries (element, set_id, n, pos, rare) of lists in which some other set has a fitting size."""
    entries = sets.filter(F.col("prefix").isNotNull()).select(
        F.posexplode("prefix").alias("pos", "element"), "set_id", "n", "rare"
    )
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartition(partitions, "element").sortWithinPartitions("element", "n", "pos", "set_id")

    def keep(batches):
        for element, columns in _whole_lists(batches, ["element", "n", "pos", "set_id", "rare"]):
            n, set_id = columns["n"], columns["set_id"]
            # a set that several tasks met stands several times, side by side
            first = np.ones(len(element), dtype=bool)
            first[1:] = (element[1:] != element[:-1]) | (set_id[1:] != set_id[:-1])
            columns = {k: v[first] for k, v in columns.items()}
            element, n = columns["element"], columns["n"]
            fits = (element[1:] == element[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
            live = np.zeros(len(element), dtype=bool)
            live[1:] |= fits
            live[:-1] |= fits
            if live.any():
                yield pa.RecordBatch.from_arrays([pa.array(columns[c][live]) for c in columns], list(columns))

    return ordered.mapInArrow(keep, "element long, n long, pos int, set_id long, rare long")


def _whole_lists(batches, names: list[str]):
    """Blocks of rows sorted by element in which no list is cut, as arrays."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        held.append(columns)
        element = columns["element"]
        if element[0] == element[-1] and (len(held) == 1 or held[0]["element"][-1] == element[0]):
            continue
        whole = {c: np.concatenate([h[c] for h in held]) for c in names}
        cut = int(np.searchsorted(whole["element"], whole["element"][-1]))
        if cut:
            yield whole["element"][:cut], {c: v[:cut] for c, v in whole.items()}
        held = [{c: v[cut:] for c, v in whole.items()}]
    if held:
        whole = {c: np.concatenate([h[c] for h in held]) for c in names}
        yield whole["element"], whole


# ------------------------------------------------------------ candidates

LIST_COLUMNS = ["element", "n", "pos", "set_id", "rare", "component", "centre", "known"]


def _by_list(lists: DataFrame) -> DataFrame:
    partitions = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(partitions, "element").sortWithinPartitions("element", "n", "pos", "set_id")


def _fitting(n1, p1, n2, p2, percent) -> np.ndarray:
    """Whether sets of these sizes can be linked if their first common element has these positions."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * small >= percent * large) & (np.minimum(n1 - p1, n2 - p2) >= needed_overlap(n1, n2, percent))


def _star_candidates(lists: DataFrame, percent: int) -> DataFrame:
    """(set_id, other): for every set its most central partner in another component, per size class.

    The centre of a list's size class is the set with the fewest rare elements: the one that
    others were derived from. A set is paired with centres of its own class and of the next below.
    """
    step = np.log(100 / percent)

    def work(batches):
        for element, c in _whole_lists(batches, LIST_COLUMNS):
            size_class = np.floor(np.log(c["n"]) / step).astype(np.int64)
            order = np.lexsort((c["set_id"], c["rare"], size_class, element))
            e, k = element[order], size_class[order]
            first = np.ones(len(e), dtype=bool)
            first[1:] = (e[1:] != e[:-1]) | (k[1:] != k[:-1])
            head = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            found = []
            for lower in (0, 1):
                # the head of this class, or of the class before it in the list if that is the next below
                g = group - lower
                ok = g >= 0
                at = head[np.maximum(g, 0)]
                ok &= (e[at] == e) & (k[at] == k - lower)
                x, y = order[ok], order[at[ok]]
                good = (c["component"][x] != c["component"][y]) & _fitting(c["n"][x], c["pos"][x], c["n"][y], c["pos"][y], percent)
                x, y = x[good], y[good]
                if len(x):
                    found.append((c["set_id"][x], np.full(len(x), lower, dtype=np.int32), c["rare"][y], c["set_id"][y]))
            if found:
                x, lower, rare, y = (np.concatenate(v) for v in zip(*found))
                best = np.lexsort((y, rare, lower, x))
                x, lower, rare, y = x[best], lower[best], rare[best], y[best]
                first = np.ones(len(x), dtype=bool)
                first[1:] = (x[1:] != x[:-1]) | (lower[1:] != lower[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(v[first]) for v in (x, lower, rare, y)], ["set_id", "lower", "rare", "other"])

    rows = _by_list(lists).mapInArrow(work, "set_id long, lower int, rare long, other long")
    best = rows.groupBy("set_id", "lower").agg(F.min(F.struct("rare", "other")).alias("best"))
    return best.select("set_id", F.col("best.other").alias("other")).filter("set_id <> other").distinct()


def _open_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs that share a list, may be linked by size, position and the known answers,
    and are in different components."""

    def work(batches):
        for element, c in _whole_lists(batches, LIST_COLUMNS):
            starts = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
            stops = np.append(starts[1:], len(element))
            # lists within one component have nothing left to say
            comp = c["component"]
            mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
            left, right = [], []
            for start, stop in zip(starts[mixed].tolist(), stops[mixed].tolist()):
                for a, b in _pairs_of_list({k: v[start:stop] for k, v in c.items()}, percent):
                    left.append(a)
                    right.append(b)
                    if sum(map(len, left)) > PAIR_BLOCK:
                        yield _distinct_pairs(left, right)
                        left, right = [], []
            if left:
                yield _distinct_pairs(left, right)

    return _by_list(lists).mapInArrow(work, "a long, b long").distinct()


def _pairs_of_list(c: dict, percent: int):
    """Pairs of one list across components: every entry outside the largest component is met with
    the block of entries whose sizes fit."""
    n, pos, comp = c["n"], c["pos"].astype(np.int64), c["component"]
    names, counts = np.unique(comp, return_counts=True)
    rest = np.flatnonzero(comp != names[np.argmax(counts)])
    low = np.searchsorted(n, -(-percent * n[rest] // 100))
    high = np.searchsorted(n, 100 * n[rest] // percent, side="right")
    outside = np.zeros(len(n), dtype=bool)
    outside[rest] = True
    for i, a, b in zip(rest.tolist(), low.tolist(), high.tolist()):
        other = np.arange(a, b)
        # a pair of two outsiders is met from its later entry
        other = other[(comp[a:b] != comp[i]) & (~outside[a:b] | (other < i))]
        other = other[_fitting(n[i], pos[i], n[other], pos[other], percent)]
        same = (c["centre"][other] == c["centre"][i]) & (c["centre"][i] != NO_SET)
        if same.any():
            k1, k2 = c["known"][i], c["known"][other]
            most = np.minimum(k1, k2) + np.minimum(n[i] - k1, n[other] - k2)
            other = other[~same | (most >= needed_overlap(n[i], n[other], percent))]
        if len(other):
            x, y = np.full(len(other), c["set_id"][i]), c["set_id"][other]
            yield np.minimum(x, y), np.maximum(x, y)


def _distinct_pairs(left: list, right: list) -> pa.RecordBatch:
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])


# ------------------------------------------------------------ verification

def _elements(docs: DataFrame, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """(set_id, elements) of the sets in ``wanted`` (set_id, _doc), from the texts of these documents.

    If ids repeat, only texts that have the wanted set count.
    """
    needed, _ = broadcast_if_small(wanted)
    texts = docs.join(needed, docs["doc_id"].eqNullSafe(needed["_doc"])).select("set_id", "text")

    def work(part):
        found = zip(part.column("set_id").to_pylist(), shingle_sets(part.column("text").to_pylist(), width, seed))
        rows = [(i, _signed(elements)) for i, elements in found if _ids(elements)[0] == i]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array([e for _, e in rows], pa.list_(pa.int64()))], ["set_id", "elements"]
        )

    return map_texts(texts, work, "set_id long, elements array<long>")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b) that their profiles allow to be linked: two sets have at most the
    smaller of both counts in common for every first byte."""
    known = sets.filter(F.col("profile").isNotNull()).select("set_id", "n", "profile")
    sides = pairs.join(known.toDF("a", "n_a", "profile_a"), "a").join(known.toDF("b", "n_b", "profile_b"), "b")

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, 256) for c in ("profile_a", "profile_b"))
            least = np.minimum(left, right)
            most = least.sum(axis=1, dtype=np.int64)
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            stays = (most >= needed_overlap(n_a, n_b, percent)) | (least == 255).any(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(stays))

    # several tasks may have met a set
    return sides.select("a", "b", "n_a", "n_b", "profile_a", "profile_b").mapInArrow(work, "a long, b long").distinct()


def _overlaps(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap) for stored pairs.

    A set with many partners is copied once per NEIGHBOURS_PER_SALT of them; its partners stream
    past it, so a task holds one set at a time.
    """
    degrees = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / NEIGHBOURS_PER_SALT).cast("int").alias("salts")), "degrees")
    salted = stored(pairs.join(degrees, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "salted")
    sent, _ = broadcast_if_small(salted)
    partners = (
        elements.withColumnRenamed("set_id", "b").join(sent, "b")
        .select("a", "salt", F.lit(1).alias("kind"), "b", "elements")
    )
    centres = (
        degrees.join(elements.withColumnRenamed("set_id", "a"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "elements")
    )
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = partners.unionByName(centres).repartition(partitions, "a", "salt").sortWithinPartitions("a", "salt", "kind")

    def work(batches):
        centre, own = None, None
        for batch in batches:
            offsets = batch.column("elements").offsets.to_numpy()
            values = batch.column("elements").values.to_numpy(zero_copy_only=False)
            out = []
            for i, (a, kind, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("kind").to_pylist(), batch.column("b").to_pylist())):
                # the order within a set is that of unsigned numbers
                elements = values[offsets[i]:offsets[i + 1]].view(np.uint64)
                if kind == 0:
                    centre, own = a, elements.copy()
                elif centre == a and len(own):
                    at = np.searchsorted(own, elements)
                    at[at == len(own)] = 0
                    out.append((a, b, len(own), len(elements), int((own[at] == elements).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], ["a", "b", "n_a", "n_b", "overlap"])

    return rows.mapInArrow(work, "a long, b long, n_a long, n_b long, overlap long")


def _linked(percent: int):
    return F.col("overlap") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))


# ------------------------------------------------------------ the join

def similar_components(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    while True:
        sets = stored(_sets(docs, width, percent, seed), "sets")
        classes = stored(
            sets.filter("set_id is not null").groupBy("set_id").agg(
                F.min("doc_id").alias("lowest"), F.max(F.col("doc_id").isNull()).alias("with_null"),
                F.min("check").alias("c1"), F.max("check").alias("c2"),
            ),
            "classes",
        )
        if not classes.filter("c1 <> c2 or set_id = 0").take(1):
            break
        seed += 1  # two sets share their 64-bit id: hash anew

    lists = stored(_live_lists(sets, percent), "lists")
    elements = _Elements(docs, classes, width, seed)
    apart = lists.select("*", F.col("set_id").alias("component"), F.lit(NO_SET).cast("long").alias("centre"), F.lit(0).cast("long").alias("known"))
    stars = stored(_star_candidates(apart, percent).select(F.col("other").alias("a"), F.col("set_id").alias("b")), "stars")
    stars = stored(_possible(stars, sets, percent), "possible-stars")
    answers = stored(_overlaps(stars, elements.of(stars)), "answers")
    links = answers.filter(_linked(percent)).select("a", "b")
    grouped = stored(components(links), "components")

    labels = stored(_labels(grouped, answers), "labels")
    labelled = lists.join(labels, "set_id", "left").select(
        *lists.columns, F.coalesce("component", "set_id").alias("component"),
        F.coalesce("centre", F.lit(NO_SET).cast("long")).alias("centre"), F.coalesce("known", F.lit(0).cast("long")).alias("known"),
    )
    rest = stored(_possible(stored(_open_pairs(labelled, percent), "open-pairs"), sets, percent), "possible-pairs")
    if rest.take(1):
        found = stored(_overlaps(rest, elements.of(rest)).filter(_linked(percent)).select("a", "b"), "more-links")
        if found.take(1):
            old = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
            grouped = stored(components(old.unionByName(found)), "components")

    ids = classes.select("set_id", "lowest", "with_null")
    joined = grouped.withColumnRenamed("node", "set_id").join(ids, "set_id")
    smallest = stored(joined.groupBy("component").agg(F.min("lowest").alias("least"), F.max("with_null").alias("any_null")), "smallest")
    linked = stored(grouped.withColumnRenamed("node", "set_id").join(smallest, "component").select("set_id", "least", "any_null"), "linked")
    of_set = ids.join(linked, "set_id", "left").select(
        "set_id", F.when(~F.coalesce("any_null", "with_null"), F.coalesce("least", "lowest")).alias("component_id")
    )
    return sets.select("doc_id", "n", "set_id").join(stored(of_set, "set-components"), "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


class _Elements:
    """Reads the elements of sets that take part in comparisons, from one text of each set."""

    def __init__(self, docs, classes, width, seed):
        self.docs, self.width, self.seed = docs, width, seed
        self.one = classes.select("set_id", F.col("lowest").alias("_doc"))

    def of(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        wanted = stored(self.one.join(ids, "set_id"), "wanted")
        return stored(_elements(self.docs, wanted, self.width, self.seed), "elements")


def _labels(grouped: DataFrame, answers: DataFrame) -> DataFrame:
    """The component of every compared set, and its best known centre with the overlap."""
    both = answers.select(F.col("b").alias("set_id"), F.struct("overlap", F.col("a").alias("centre")).alias("answer")).unionByName(
        answers.select(F.col("a").alias("set_id"), F.struct(F.col("n_a").alias("overlap"), F.col("a").alias("centre")).alias("answer"))
    )
    best = both.groupBy("set_id").agg(F.max("answer").alias("answer"))
    return best.join(grouped.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", F.coalesce("component", "set_id").alias("component"), "answer.centre", F.col("answer.overlap").alias("known")
    )
