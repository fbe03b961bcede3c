"""Reversible line de-duplication: sharded cuckoo filters over exact reference counts.

The exact table holds, for every line key, the number of documents that have it. Each shard of
it has a cuckoo filter of the keys whose count reaches the limit. Adding documents adds to the
counts, removing them subtracts, and keys that cross the limit enter or leave their shard's
filter, so that the state after any series of additions and removals equals that of a fresh
build. A text is first probed against the filters; what passes is looked up in the exact counts.

Defined cases: a null or empty text is one empty line; an empty key (a blank line) never counts;
a line that repeats within a document counts once for it; rows with the same doc_id are separate
documents; an empty table gives an empty result; further columns are kept by ``drop_lines``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carewise.llm.common import sliced
from carewise.session import stored

SLOTS = 4
LOAD = 0.85
KEYS_PER_SHARD = 1 << 16
# The frequent keys of the exact table travel with the filters up to this size (32 bytes each);
# beyond it the lines that pass are joined with the table.
CARRIED_BYTES = 64 << 20
COUNTS_SCHEMA = "key binary, n long"


def line_keys(text: str | None) -> list[bytes | None]:
    """SHA-256 of every line's key, in order; None for an empty key."""
    found = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(b" \t\n\v\f\r")
        found.append(hashlib.sha256(key).digest() if key else None)
    return found


# ---------------------------------------------------------------- cuckoo filter

def places(heads: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets (a power of two in number) of keys given by two uint64 words."""
    mask = np.uint64(buckets - 1)
    prints = (heads[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
    prints[prints == 0] = 1
    first = (heads[:, 0] & mask).astype(np.int64)
    return prints, first, other_bucket(first, prints, buckets)


def other_bucket(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    return (bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) >> 3)) & (buckets - 1)


def heads_of(keys: list[bytes]) -> np.ndarray:
    """Two words of each 32-byte key: for the bucket and for the fingerprint."""
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 4)[:, :2]


def bucket_count(keys: int) -> int:
    return 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


def insert(table: np.ndarray, keys: list[bytes]) -> bool:
    """Put keys into the table; False if one finds no place, and the table must grow."""
    if not keys:
        return True
    buckets = len(table)
    prints, first, second = places(heads_of(keys), buckets)
    kick = 0
    for p, i, j in zip(prints.tolist(), first.tolist(), second.tolist()):
        for _ in range(500):
            free = np.flatnonzero(table[i] == 0)
            if len(free):
                table[i, free[0]] = p
                break
            i = j if not kick else i
            free = np.flatnonzero(table[i] == 0)
            if len(free):
                table[i, free[0]] = p
                break
            kick = (kick * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (kick >> 8) % SLOTS
            p, table[i, slot] = int(table[i, slot]), p
            i = int(other_bucket(np.array([i]), np.array([p], dtype=np.uint16), buckets)[0])
        else:
            return False
        kick = 0
    return True


def remove(table: np.ndarray, keys: list[bytes]) -> None:
    """Take keys that were inserted out again."""
    if not keys:
        return
    prints, first, second = places(heads_of(keys), len(table))
    for p, i, j in zip(prints.tolist(), first.tolist(), second.tolist()):
        for b in (i, j):
            at = np.flatnonzero(table[b] == p)
            if len(at):
                table[b, at[0]] = 0
                break


def filled(keys: list[bytes], buckets: int) -> np.ndarray:
    while True:
        table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        if insert(table, keys):
            return table
        buckets *= 2


# ---------------------------------------------------------------- the index

def shard_column(shards: int):
    """The shard of a key, from bytes that neither bucket nor fingerprint uses."""
    return F.pmod(F.conv(F.hex(F.substring("key", 25, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


FILTER_SCHEMA = "shard int, keys long, buckets int, cells binary"


@dataclass(frozen=True)
class LineIndex:
    """Counts (key, n), filters (shard, keys, buckets, cells), the limit and the number of shards."""

    counts: DataFrame
    filters: DataFrame
    limit: int
    shards: int

    @staticmethod
    def build(docs: DataFrame, limit: int = 10, text: str = "text") -> LineIndex:
        counts = stored(_deltas(docs, text, 1).groupBy("key").agg(F.sum("n").alias("n")), "line-counts")
        frequent = counts.filter(F.col("n") >= limit)
        shards = max(1, -(-frequent.count() // KEYS_PER_SHARD))
        filters = _fresh(frequent.select(shard_column(shards).alias("shard"), "key"))
        return LineIndex(counts, stored(filters, "line-filters"), limit, shards)

    def add(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._moved(_deltas(docs, text, 1))

    def remove(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Undo the addition of these documents."""
        return self._moved(_deltas(docs, text, -1))

    def _moved(self, deltas: DataFrame) -> LineIndex:
        both = self.counts.select("key", F.col("n").alias("was"), F.col("n").alias("now")).unionByName(
            deltas.select("key", F.lit(0).cast("long").alias("was"), F.col("n").alias("now"))
        )
        moved = stored(both.groupBy("key").agg(F.sum("was").alias("was"), F.sum("now").alias("n")), "line-moves")
        over, is_over = F.col("was") >= self.limit, F.col("n") >= self.limit
        changes = moved.filter(over != is_over).select(shard_column(self.shards).alias("shard"), "key", is_over.alias("enters"))
        filters = stored(_changed(self.filters, changes), "line-filters")
        full = filters.filter("buckets < 0").select("shard")
        again = moved.filter(is_over).select(shard_column(self.shards).alias("shard"), "key").join(full, "shard")
        filters = stored(filters.filter("buckets > 0").unionByName(_fresh(again)), "line-filters")
        return LineIndex(moved.filter("n > 0").select("key", "n"), filters, self.limit, self.shards)

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n") >= self.limit).select("key")

    def drop_lines(self, docs: DataFrame, text: str = "text", carried: int = CARRIED_BYTES) -> DataFrame:
        """The documents with ``kept_text``, ``n_lines`` and ``n_dropped`` (input columns of these
        names are replaced); all other columns are unchanged."""
        docs = docs.drop("kept_text", "n_lines", "n_dropped")
        filters = None
        if self.filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0)).alias("b")).first()["b"] <= carried:
            filters = self.shards, {r["shard"]: (r["buckets"], bytes(r["cells"])) for r in self.filters.toLocalIterator()}
        if filters is not None and 32 * self.frequent().count() <= carried:
            keys = sorted(bytes(r["key"]) for r in self.frequent().toLocalIterator())
            exact = np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, 4).astype(np.uint64)
            return _rewritten(docs, text, lambda found: _in_table(found, filters, exact))
        return self._drop_by_join(docs, text, filters)

    def _drop_by_join(self, docs: DataFrame, text: str, filters) -> DataFrame:
        """Equal texts lose the same lines, so the lines are looked up once per text, by its hash."""
        schema = "text_key binary, key binary"

        def candidates(batches):
            for part in sliced(batches):
                owners, keys = [], []
                for value in part.column(0).to_pylist():
                    own = list({k for k in line_keys(value) if k})
                    if filters is not None and own:
                        own = [k for k, hit in zip(own, probe(heads_of(own), shard_of(own, filters[0]), filters)) if hit]
                    owners += [hashlib.sha256((value or "").encode("utf-8", "surrogatepass")).digest()] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.binary()), pa.array(keys, pa.binary())], ["text_key", "key"])

        plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
        lines = docs.select(plain.alias("text")).mapInArrow(candidates, schema).distinct()
        hits = lines.join(stored(self.frequent(), "frequent-lines"), "key")
        found = stored(hits.groupBy("text_key").agg(F.collect_list("key").alias("_keys")), "lines-found")
        keyed = docs.withColumn("text_key", F.unhex(F.sha2(plain, 256)))
        both = keyed.join(found, "text_key", "left").select(*docs.columns, "_keys")
        return _rewritten(both, text, None)


def shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(k[24:28] for k in keys), dtype=">u4").astype(np.int64) % shards


def probe(heads: np.ndarray, shard: np.ndarray, filters) -> np.ndarray:
    """Which keys the filters of their shards hold, false positives included."""
    hit = np.zeros(len(heads), dtype=bool)
    for number, (buckets, cells) in filters[1].items():
        own = np.flatnonzero(shard == number)
        if len(own):
            table = np.frombuffer(cells, dtype=np.uint16).reshape(buckets, SLOTS)
            prints, first, second = places(heads[own], buckets)
            same = (table[first] == prints[:, None]).any(axis=1) | (table[second] == prints[:, None]).any(axis=1)
            hit[own] = same
    return hit


def _in_table(keys: list[bytes], filters, exact: np.ndarray) -> np.ndarray:
    """Which keys are frequent: those that pass the filters and stand in the exact table."""
    hit = probe(heads_of(keys), shard_of(keys, filters[0]), filters)
    passed = np.flatnonzero(hit)
    if not len(passed):
        return hit
    words = np.frombuffer(b"".join(keys[i] for i in passed), dtype=">u8").reshape(-1, 4).astype(np.uint64)
    at = np.searchsorted(exact[:, 0], words[:, 0])
    sure = np.zeros(len(passed), dtype=bool)
    open_ = np.arange(len(passed))
    while len(open_):
        open_ = open_[at[open_] < len(exact)]
        open_ = open_[exact[at[open_], 0] == words[open_, 0]]
        same = (exact[at[open_]] == words[open_]).all(axis=1)
        sure[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
    hit[passed] = sure
    return hit


def _rewritten(docs: DataFrame, text: str, frequent) -> DataFrame:
    """The documents without frequent lines; ``frequent`` says which of a batch's keys are, or
    else every row carries its own in ``_keys``."""
    names = [c for c in docs.columns if c != "_keys"]
    fields = [docs.schema[c] for c in names]
    extra = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]

    def rewrite(batches):
        for part in sliced(batches, text):
            values = part.column(text).to_pylist()
            keys = [line_keys(v) for v in values]
            if frequent is None:
                own = [set(k or ()) for k in part.column("_keys").to_pylist()]
            else:
                flat = [k for doc in keys for k in doc if k]
                hits = {k for k, hit in zip(flat, frequent(flat)) if hit} if flat else set()
                own = [hits] * len(keys)
            kept, lines, dropped = [], [], []
            for value, doc, gone in zip(values, keys, own):
                stay = [line for line, key in zip((value or "").split("\n"), doc) if key not in gone]
                kept.append("\n".join(stay))
                lines.append(len(doc))
                dropped.append(len(doc) - len(stay))
            columns = [part.column(c) for c in names]
            columns += [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names + ["kept_text", "n_lines", "n_dropped"])

    return docs.mapInArrow(rewrite, T.StructType(fields + extra))


def _deltas(docs: DataFrame, text: str, sign: int) -> DataFrame:
    """(key, n) of a part of the documents: how many of them have the key, counted per batch first."""

    def count(batches):
        for part in sliced(batches):
            n: dict[bytes, int] = {}
            for value in part.column(0).to_pylist():
                for key in {k for k in line_keys(value) if k}:
                    n[key] = n.get(key, 0) + sign
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["key", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, COUNTS_SCHEMA)


def _changed(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """The filters after keys have entered and left; a shard holds about KEYS_PER_SHARD keys."""

    def update(shard: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        keys = [bytes(k) for k in new.column("key").to_pylist()]
        enters = new.column("enters").to_pylist() if new.num_rows else []
        coming = sorted(k for k, e in zip(keys, enters) if e)
        going = [k for k, e in zip(keys, enters) if not e]
        number = shard[0].as_py()
        if old.num_rows:
            held, buckets = old.column("keys")[0].as_py(), old.column("buckets")[0].as_py()
            table = np.frombuffer(old.column("cells")[0].as_py(), dtype=np.uint16).reshape(buckets, SLOTS).copy()
        else:
            held, buckets = 0, bucket_count(len(coming))
            table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        remove(table, going)
        held += len(coming) - len(going)
        if held > SLOTS * LOAD * buckets or not insert(table, coming):
            # A filter cannot be re-spread from its cells alone: mark it for a rebuild.
            return pa.table({"shard": [number], "keys": [held], "buckets": [-1], "cells": [b""]}, pa.schema(_filter_fields()))
        return pa.table({"shard": [number], "keys": [held], "buckets": [buckets], "cells": [table.tobytes()]}, pa.schema(_filter_fields()))

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, FILTER_SCHEMA)


def _fresh(keys: DataFrame) -> DataFrame:
    """Filters of shards whose keys are all given."""

    def build(shard: tuple, new: pa.Table) -> pa.Table:
        own = sorted(bytes(k) for k in new.column("key").to_pylist())
        table = filled(own, bucket_count(len(own)))
        columns = {"shard": [shard[0].as_py()], "keys": [len(own)], "buckets": [len(table)], "cells": [table.tobytes()]}
        return pa.table(columns, pa.schema(_filter_fields()))

    return keys.groupBy("shard").applyInArrow(build, FILTER_SCHEMA)


def _filter_fields():
    return [("shard", pa.int32()), ("keys", pa.int64()), ("buckets", pa.int32()), ("cells", pa.binary())]
