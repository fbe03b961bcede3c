"""Language identification with a bit-sliced Bloom filter of character n-grams.

One table of language masks holds the Bloom filters of all languages at once: bit l of a slot is
that slot of language l's filter. The AND of the slots of an n-gram is the set of all languages
that may contain it. Over a text, the bits of each language are counted, false positives are
taken off by the fill of its filter, and the language with the largest corrected share decides.

An n-gram is listed for a language if it is about as frequent there as anywhere. The lists are
learned from a bounded sample of distinct labelled texts, taken by their hash.

Defined cases: a text that is null or has no letter is "und" with score 0, as is every text when
nothing was learned; equal shares go to the language with more training text, then to the
smaller name; labels that are null teach nothing; rows that repeat an id are judged one by one;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.llm.common import sliced
from carewise.llm.shingles import mix
from carewise.session import stored

# Labelled documents that the lists are learned from, about.
LEARN_DOCUMENTS = 20_000
SLOTS = 1 << 20
HASHES = 4
GRAM = 3
# An n-gram belongs to the languages in which it has at least this part of its highest rate.
PART_OF_HIGHEST = 0.4
LEAST_COUNT = 3
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

# Numbers that are no digits, such as fractions and Roman numerals, are no letters either.
# A pattern that names them all would compare every character with each of them.
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(r"[^\W\d_]+")
# The hash range in which a share of texts is taken; fine enough for any number of them.
RANGE = 1 << 40


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text."""
    if not text.isascii():
        for number in NUMBERS.intersection(text):
            text = text.replace(number, " ")
    return WORD.findall(text)


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters and word ends, and how many each text has."""
    plain = []
    for t in texts:
        words = letter_runs((t or "").lower())
        plain.append(f" {' '.join(words)} " if words else "")
    sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < GRAM:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(plain), dtype=np.int64)
    grams = points[: len(points) - GRAM + 1].copy()
    for k in range(1, GRAM):
        grams |= points[k: len(points) - GRAM + 1 + k] << np.uint64(21 * k)
    inside = np.ones(len(points), dtype=bool)
    stops = np.cumsum(sizes)[sizes > 0]
    for k in range(1, GRAM):
        inside[stops - k] = False
    return mix(grams[inside[: len(grams)]]), np.maximum(sizes - GRAM + 1, 0)


def slots_of(grams: np.ndarray, slots: int, number: int) -> np.ndarray:
    """The slot of each n-gram under one of the hash functions."""
    return ((grams >> np.uint64(16 * (number % 2))) * np.uint64(2 * number + 1) + (grams >> np.uint64(40))).astype(np.int64) & (slots - 1)


@dataclass(frozen=True)
class LanguageFilters:
    """Languages in order of their training text, and masks (slot, word of 64 languages)."""

    languages: tuple[str, ...]
    table: np.ndarray

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected shares (text, language), and the number of n-grams of each text."""
        grams, counts = text_grams(texts)
        slots = len(self.table)
        masks = self.table[slots_of(grams, slots, 0)]
        for number in range(1, HASHES):
            masks &= self.table[slots_of(grams, slots, number)]
        used = np.flatnonzero(counts)
        begins = (np.cumsum(counts) - counts)[used]
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = np.uint64(1) << np.uint64(i % 64)
            wrong = float(((self.table[:, i // 64] & bit) != 0).mean()) ** HASHES
            if len(used):
                hits = np.add.reduceat(((masks[:, i // 64] & bit) != 0).astype(np.int64), begins)
                share = hits / counts[used]
                out[used, i] = np.clip((share - wrong) / max(1 - wrong, 1e-9), 0, 1)
        return out, counts

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its part of all corrected shares."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        shares, counts = self.shares(texts)
        best = shares.argmax(axis=1)  # the first of equal ones has the most training text
        total = shares.sum(axis=1)
        score = np.where(total > 0, shares.max(axis=1) / np.where(total > 0, total, 1), 1 / len(self.languages))
        return [(self.languages[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best.tolist(), score.tolist(), counts.tolist())]


def share_of(wanted: int, total: int) -> int:
    """The part of RANGE that holds about ``wanted`` of ``total`` hashes; never nothing."""
    return min(RANGE, max(1, -(-wanted * RANGE // max(total, 1))))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", documents: int = LEARN_DOCUMENTS, slots: int = SLOTS, seed: int = 5) -> LanguageFilters:
    """Filters from about ``documents`` of the distinct labelled texts of ``docs``."""
    labelled = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    total = labelled.agg(F.approx_count_distinct(F.xxhash64("text", "lang"), 0.02)).first()[0]
    sample = labelled.filter(F.pmod(F.xxhash64("text", "lang", F.lit(seed)), F.lit(RANGE)) < share_of(documents, total)).dropDuplicates(["text", "lang"])

    def count(batches):
        for part in sliced(batches, most=SLICE_BYTES):
            grams, counts = text_grams(part.column("text").to_pylist())
            names = part.column("lang").to_pylist()
            kinds = sorted(set(names))
            of_gram = np.repeat(np.searchsorted(kinds, names), counts)
            for i, name in enumerate(kinds):
                gram, n = np.unique(grams[of_gram == i], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                )

    counted = stored(
        sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts"
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").collect()  # one row per language
    languages = tuple(r["lang"] for r in totals)
    if not languages:
        return LanguageFilters((), np.zeros((1, 1), dtype=np.uint64))
    size = F.element_at(F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], float(r["n"]))]), F.col("lang"))
    rated = counted.filter(F.col("n") >= LEAST_COUNT).withColumn("rate", F.col("n") / size)
    highest = stored(rated.groupBy("gram").agg(F.max("rate").alias("highest")), "gram-rates")
    listed = rated.join(highest, "gram").filter(F.col("rate") >= PART_OF_HIGHEST * F.col("highest"))
    number = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)]), F.col("lang"))

    def places(batches):
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(np.uint64)
            slot = np.concatenate([slots_of(gram, slots, k) for k in range(HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.tile(batch.column("number").to_numpy(), HASHES))], ["slot", "number"])

    bits = listed.select("gram", number.cast("long").alias("number")).mapInArrow(places, "slot long, number long")
    word, bit = F.floor(F.col("number") / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    masks = bits.groupBy("slot", word.alias("word")).agg(F.bit_or(bit).alias("mask")).toPandas()  # at most slots times words
    table = np.zeros((slots, -(-len(languages) // 64)), dtype=np.uint64)
    table[masks["slot"].to_numpy(), masks["word"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    return LanguageFilters(languages, table)


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row."""

    def work(batches):
        for part in sliced(batches, most=SLICE_BYTES):
            found = filters.identify(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, folds: int = 4) -> Column:
    """The fold of a document, by the CRC-32 of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds
