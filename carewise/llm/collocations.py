"""Phrases of two and three words whose words occur together more often than apart.

Counts lie in streams that are kept in two orders. In prefix order a word is followed by the
pairs and triples that begin with it, so one pass in lockstep meets the count of every left part
and the extensions to the right. In suffix order, the same pass over the words read backwards
meets right parts and extensions to the left. Both streams, again in prefix order, are merged.
No count is looked up in a table in memory: a pass remembers one word, one pair and the pair's most
frequent extension.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.llm.common import sliced
from carewise.session import filter_computed, shuffle_tasks, stored

PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
NO_LANGUAGE = "und"
LEAST_COUNT = 10
INSIDE_PERCENT = 50
PHRASES = 2000
SCALE = 1_000_000
# Parts in which the phrases of a language are ranked first.
SHARES = 64
SLICE_BYTES = 4 << 20
ROWS = 1 << 15
FILTER_BITS = 1 << 28
# Words of 64 bits of the filter that come to the driver as one row.
PART_MASKS = 1 << 14
# A word that begins more phrases than this lies in several slices of a stream.
SLICE_ROWS = 20_000

ORDERED = "lang string, slice int, first string, second string, third string, n long"
NOTED = "lang string, first string, second string, third string, a long, one long, two long, extended long"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows, gathered or cut to about ``SLICE_BYTES`` of text."""
    held, total = [], 0
    for part in sliced(batches, most=SLICE_BYTES // 4):
        held.append(part)
        total += part.column("text").nbytes
        if total >= SLICE_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Places:
    """The words of some texts one after the other, as numbers; a new piece is a new number too."""

    langs: pa.Array
    words: pa.Array
    lang: np.ndarray
    word: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Places:
        text = batch.column("text").cast(pa.large_string())
        # A copy, since pyarrow lower-cases slices of a column wrongly.
        text = pc.ascii_lower(pa.concat_arrays([text, text.slice(0, 0)]))
        text = pc.replace_substring(pc.replace_substring_regex(text, PIECE_ENDS, "\n"), "\t", " ")
        pieces = pc.split_pattern(text, "\n")
        words = pc.split_pattern(pc.list_flatten(pieces), " ")
        piece, word = np.asarray(pc.list_parent_indices(words)), pc.list_flatten(words)
        there = pc.greater(pc.binary_length(word), 0)
        coded, langs = word.filter(there).dictionary_encode(), batch.column("lang").dictionary_encode()
        piece = piece[np.asarray(there)]
        del text, words, word, there
        lang = np.asarray(langs.indices, dtype=np.int64)[np.asarray(pc.list_parent_indices(pieces))[piece]]
        return cls(langs.dictionary, coded.dictionary, lang, np.asarray(coded.indices, dtype=np.int64), piece)

    def counted(self, at: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
        """The different sequences of ``width`` words that begin at some places, and how often."""
        size = len(self.words)
        numbers = [self.word[at + k] for k in range(width)]
        if len(self.langs) * float(size) ** width < 2.0**62:
            key = self.lang[at]
            for number in numbers:
                key = key * size + number
            key, n = np.unique(key, return_counts=True)
            found = []
            for _ in range(width):
                key, number = np.divmod(key, size)
                found.insert(0, number)
            found.insert(0, key)
        else:
            both, n = np.unique(np.stack([self.lang[at], *numbers], 1), axis=0, return_counts=True)
            found = list(both.T)
        for start in range(0, len(n), ROWS):
            cut = slice(start, start + ROWS)
            lang, *words = (pa.array(f[cut]) for f in found)
            taken = [self.langs.take(lang)] + [self.words.take(w).cast(pa.string()) for w in words]
            empty = [pa.nulls(len(lang), pa.string())] * (3 - width)
            yield pa.RecordBatch.from_arrays([*taken, *empty, pa.array(n[cut].astype(np.int64))], ["lang", "first", "second", "third", "n"])

    def pairs(self) -> np.ndarray:
        return np.flatnonzero(self.piece[:-1] == self.piece[1:])

    def pair_keys(self, at: np.ndarray) -> np.ndarray:
        return pair_keys(self.langs, self.words, self.lang[at], self.word[at], self.word[at + 1])


def pair_keys(langs: pa.Array, words: pa.Array, lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair, from keys of its words."""
    def keys(of: pa.Array) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in of.cast(pa.binary()).to_pylist()), np.uint64, len(of))

    word = keys(words)
    x = keys(langs)[lang] * np.uint64(0x9E3779B97F4A7C15) + word[first] * np.uint64(0xC2B2AE3D27D4EB4F) + word[second]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((keys >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 32)]


@dataclass
class PairFilter:
    """A Bloom filter of the pairs that are frequent enough. It only spares triples their count that
    can't be frequent; what it lets through by mistake is counted like the others. It has 16 bits a
    pair and at most ``FILTER_BITS``, beyond which more is let through."""

    bits: int
    table: np.ndarray

    @classmethod
    def learn(cls, pairs: DataFrame) -> PairFilter:
        size = pairs.count()
        bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * size).bit_length()))

        def places(batches):
            for batch in batches:
                kinds = [batch.column(c).dictionary_encode() for c in ("lang", "first", "second")]
                words = pa.concat_arrays([kinds[1].dictionary, kinds[2].dictionary])
                lang, first, second = (np.asarray(k.indices, dtype=np.int64) for k in kinds)
                keys = pair_keys(kinds[0].dictionary, words, lang, first, second + len(kinds[1].dictionary))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_slots(keys, bits)))], ["slot"])

        slots = pairs.select("lang", "first", "second").mapInArrow(places, "slot long")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
        masks = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("mask"))

        def packed(rows: pa.Table) -> pa.Table:
            at, part = np.asarray(rows["at"]), np.zeros(PART_MASKS, dtype=np.int64)
            part[at % PART_MASKS] = np.asarray(rows["mask"])
            return pa.table({"part": pa.array([int(at[0]) // PART_MASKS]), "masks": pa.array([part.tobytes()], pa.binary())})

        # The driver gets bytes, a task's parts at a time, never a row per mask.
        grouped = masks.groupBy(F.expr(f"at div {PART_MASKS}").alias("part")).applyInArrow(packed, "part long, masks binary")
        table = np.zeros(max(bits // 64, PART_MASKS), dtype=np.uint64)
        for row in stored(grouped, "pair-filter").toLocalIterator():
            table[row["part"] * PART_MASKS:][:PART_MASKS] = np.frombuffer(row["masks"], dtype=np.uint64)
        return cls(bits, table[: bits // 64])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for slot in _slots(keys, self.bits):
            found &= (self.table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
        return found


def count_streams(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, first, second, third, n) for words, pairs and triples with n >= ``least``; what is
    shorter has null in its last places. One more row per language, without words, has n of all.

    Words and pairs are counted first. Triples are counted where both of their pairs may be
    frequent, since a triple is never more frequent than its pairs. Sums are made per slice of text
    before they are shuffled, so that a hot word or pair is one row per slice.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"))
    kind = "lang string, first string, second string, third string, n long"

    def short(batches):
        for batch in _slices(batches):
            places = Places.of(batch)
            yield from places.counted(np.arange(len(places.word)), 1)
            yield from places.counted(places.pairs(), 2)

    summed = rows.mapInArrow(short, kind).drop("third").groupBy("lang", "first", "second").agg(F.sum("n").alias("n"))
    # The conditions stay above the sums, so that both parts share one exchange.
    kept = filter_computed(summed, F.col("n") >= least)
    totals = filter_computed(summed, F.col("second").isNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    nothing = F.lit(None).cast("string")
    totals = totals.select("lang", nothing.alias("first"), nothing.alias("second"), "n")
    counted = stored(kept.unionByName(totals), "words-and-pairs")
    pairs = PairFilter.learn(counted.filter("second IS NOT NULL"))

    def long(batches):
        for batch in _slices(batches):
            places = Places.of(batch)
            at = places.pairs()
            at = at[pairs.holds(places.pair_keys(at))]
            # Two such pairs in a row; both lie within one piece.
            yield from places.counted(at[:-1][at[1:] == at[:-1] + 1], 3)

    triples = rows.mapInArrow(long, kind).groupBy("lang", "first", "second", "third").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counted.withColumn("third", nothing).select("lang", "first", "second", "third", "n").unionByName(triples)


def _annotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair and triple of a stream in order, with the counts of its first word and, for
    triples, of its first two. A pair also gets the largest count of a triple that begins with it;
    it is held back until its triples are through."""
    word, word_n = None, 0
    held: list | None = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in NOTED.split(", ")])
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types)], schema=kinds)

    for batch in batches:
        rows = []
        for lang, _, first, second, third, n in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and (third is None or (lang, first, second) != tuple(held[:3])):
                rows.append(tuple(held))
                held = None
            if second is None:
                word, word_n = (lang, first), n
                continue
            one = word_n if word == (lang, first) else None
            if third is None:
                held = [lang, first, second, None, n, one, None, 0]
            else:
                pair = held[4] if held is not None else None
                if held is not None:
                    held[7] = max(held[7], n)
                rows.append((lang, first, second, third, n, one, pair, 0))
        yield out(rows)
    if held is not None:
        yield out([tuple(held)])


def in_order(streams: DataFrame, words: Sequence[str]) -> DataFrame:
    """The streams in the order of ``words``, with what a pass over them notes.

    Tasks take ranges of (language, first word, slice). A word that begins very many phrases is
    cut into slices by its second word, and its own row goes in front of each of them.
    """
    first, second, third = (F.col(w) for w in words)
    rows = streams.select("lang", first.alias("first"), second.alias("second"), third.alias("third"), "n")
    begun = rows.filter("second IS NOT NULL").groupBy("lang", "first").agg(F.count(F.lit(1)).alias("phrases"))
    slices = F.greatest(F.ceil(F.col("phrases") / SLICE_ROWS), F.lit(1)).cast("int")
    wide = begun.filter(F.col("phrases") > SLICE_ROWS).select(F.col("lang").alias("l"), F.col("first").alias("f"), slices.alias("slices"))
    sliced = rows.join(wide, (F.col("lang") == F.col("l")) & (F.col("first") == F.col("f")), "left")
    many = F.coalesce("slices", F.lit(1))
    own = F.when(F.col("second").isNull(), F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.pmod(F.xxhash64("second"), many).cast("int")))
    placed = sliced.select("lang", F.explode(own).alias("slice"), "first", "second", "third", "n")
    tasks = shuffle_tasks(streams.sparkSession)
    ordered = placed.repartitionByRange(tasks, "lang", "first", "slice").sortWithinPartitions("lang", "first", "slice", "second", "third")
    return ordered.mapInArrow(_annotated, NOTED)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest score of all cuts and its parts, in whole numbers of any size."""
    for batch in batches:
        kept = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        best = []
        for a, *cuts in zip(kept["a"], kept["l1"], kept["r1"], kept["l2"], kept["r2"]):
            parts = [(SCALE * a * a // (left * right), left, right) for left, right in zip(cuts[::2], cuts[1::2]) if left is not None]
            best.append(min(parts, key=lambda p: p[0]))
        columns = [batch.column(c) for c in ("lang", "phrase", "a")] + [pa.array([b[i] for b in best], pa.int64()) for i in (1, 2, 0)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "a", "l", "r", "score"])


def collocations(docs: DataFrame, least: int = LEAST_COUNT, inside_percent: int = INSIDE_PERCENT, phrases: int | None = PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language.

    ``a`` counts a phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the
    language; the score is a million times a * a / (l * r), rounded down. A pair is left out when a
    triple around it is found in ``inside_percent`` of its places or more. ``phrases`` is the
    length of the list, None returns all.

    Null and empty texts have no words, a null language is "und", repeated rows count as often as
    they come, equal scores are ordered by count and phrase, an empty table gives no rows, and
    other columns are not looked at. Very long texts and hot words only make more rows of counts.
    """
    streams = stored(count_streams(docs.select("text", "lang"), least), "count-streams")
    counts = streams.filter("first IS NOT NULL")
    totals = streams.filter("first IS NULL").select("lang", F.col("n").alias("total"))
    left = in_order(counts, ("first", "second", "third"))
    # Read backwards: a pair has its last word in front, a triple its last two.
    backwards = counts.select(
        "lang",
        F.coalesce("third", "second", "first").alias("first"),
        F.when(F.col("third").isNotNull(), F.col("second")).when(F.col("second").isNotNull(), F.col("first")).alias("second"),
        F.when(F.col("third").isNotNull(), F.col("first")).alias("third"),
        "n",
    )
    noted = in_order(backwards, ("first", "second", "third"))
    right = noted.select(
        F.col("lang").alias("lang_"),
        F.coalesce("third", "second").alias("first_"),
        F.when(F.col("third").isNotNull(), F.col("second")).otherwise(F.col("first")).alias("second_"),
        F.when(F.col("third").isNotNull(), F.col("first")).otherwise(F.lit("")).alias("third_"),
        F.col("one").alias("last_one"),
        F.col("two").alias("last_two"),
        F.col("extended").alias("extended_"),
    )
    left = left.withColumn("third", F.coalesce("third", F.lit("")))
    same = [F.col(c) == F.col(f"{c}_") for c in ("lang", "first", "second", "third")]
    both = left.hint("merge").join(right, same[0] & same[1] & same[2] & same[3])
    triple = F.col("third") != ""
    candidates = both.select(
        "lang",
        F.when(triple, F.concat_ws(" ", "first", "second", "third")).otherwise(F.concat_ws(" ", "first", "second")).alias("phrase"),
        "a",
        F.col("one").alias("l1"),
        F.when(triple, F.col("last_two")).otherwise(F.col("last_one")).alias("r1"),
        F.when(triple, F.col("two")).alias("l2"),
        F.when(triple, F.col("last_one")).alias("r2"),
        F.greatest("extended", "extended_").alias("around"),
    )
    kept = filter_computed(candidates, F.col("around") * 100 < F.col("a") * inside_percent).drop("around")
    scored = kept.mapInArrow(_scored, "lang string, phrase string, a long, l long, r long, score long")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    if phrases is not None:
        # The best of each share of a language first, so that a language's last task has few rows.
        scored = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
        among = F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))
        scored = scored.withColumn("place", among).filter(F.col("place") <= phrases).drop("share", "place")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    if phrases is not None:
        ranked = ranked.filter(F.col("rank") <= phrases)
    # One row per language.
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
