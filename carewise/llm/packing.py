"""Best-fit packing of tokenised documents into sequences, with certified sequence counts.

Every text becomes its token ids and an end id. Only documents above the capacity are cut, into
pieces of the capacity. Pieces are dealt to partitions of a fixed expected size; each is packed
by best-fit decreasing, and dual-feasible functions give a lower bound on the sequences that any
packing of it needs. Partitions that reach their bound are certified and give only their one
emptiest sequence away. Those with a gap give their emptiest sequences, to pools of several
partitions that are packed again; a new packing is taken only if it saves a sequence. This
repeats until the pools have merged.

Tokens are looked up per blank-separated word in a table of each task; words that are new to it
are encoded by the tokenizer in bulk. The ids equal those of encoding the whole text.

Defined cases: a null or empty text is the end id alone; an empty table gives no rows; rows that
repeat a doc_id are separate documents; other columns are not read.
"""

from __future__ import annotations

import json
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carewise.llm.common import sliced
from carewise.session import stored

CAPACITY = 2048
END_ID = 0
# Expected sequences of a partition, sequences it gives to a pool, and partitions of a pool.
PARTITION_SEQUENCES = 4096
POOLED_SEQUENCES = 512
POOLED_PARTITIONS = 8
# What the words that a task remembers may take, letters and ids, before it starts anew.
REMEMBERED_BYTES = 24 << 20
SLICE_BYTES = 4 << 20
# Words that the tokenizer gets as one text.
JOINED_WORDS = 1000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ------------------------------------------------------------ tokens

def _gathered(ids: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids between the edges of the given numbers one behind the other, and their edges."""
    sizes = edges[which + 1] - edges[which]
    out = np.concatenate(([0], np.cumsum(sizes)))
    kind = np.int32 if max(out[-1], len(ids)) < 1 << 31 else np.int64
    places = np.repeat((edges[which] - out[:-1]).astype(kind), sizes)
    places += np.arange(out[-1], dtype=kind)
    return ids[places], out


class Words:
    """Token ids of texts through a table of words, which is an Arrow array beside the runs of ids.

    A text may be cut at blanks and line feeds, since no token and no normalisation crosses one.
    Words of plain letters and closing punctuation are cut again between the two, in lower case.
    The different words of some texts are looked up at once.
    """

    LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|%*#"
    SIMPLE = rf"\A(?P<letters>[{LETTERS}]+)(?P<marks>[{MARKS}]*)\z"
    PART = rf"\A(?:[{LETTERS}]+|[{MARKS}]+)\z"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ends = np.zeros(max(vocabulary.values()) + 3, dtype=bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ends = ends
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([""], pa.string())
        self.ids = np.zeros(0, dtype="<u4")
        # the ids of a word lie from its edge to the next
        self.edges = np.zeros(2, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian 32-bit bytes."""
        if self.words.nbytes + self.ids.nbytes + self.edges.nbytes > REMEMBERED_BYTES:
            self.forget()
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        found = cut.flatten().dictionary_encode()
        ids, edges = _gathered(*self._of_words(found.dictionary), found.indices.to_numpy())
        stops = (4 * edges[cut.offsets.to_numpy()]).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(stops, stops[1:])]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one behind the other, and their edges."""
        simple = pc.extract_regex(words, self.SIMPLE)
        letters = pc.coalesce(pc.utf8_lower(pc.struct_field(simple, "letters")), words)
        marks = pc.coalesce(pc.struct_field(simple, "marks"), "")
        parts = pa.concat_arrays([letters, marks]).dictionary_encode()
        known = pc.index_in(parts.dictionary, value_set=self.words)
        first = len(self.words)
        self._learn(parts.dictionary.filter(known.is_null()))
        places = known.fill_null(-1).to_numpy().astype(np.int64)
        places[places < 0] = np.arange(first, len(self.words))
        ids, edges = _gathered(self.ids, self.edges, places[parts.indices.to_numpy().reshape(2, -1).T.ravel()])
        return ids, edges[::2]

    def _learn(self, new: pa.Array) -> None:
        simple = pc.match_substring_regex(new, self.PART)
        joined, other = new.filter(simple), new.filter(pc.invert(simple))
        ids, sizes = [self.ids], []
        for i in range(0, len(joined), JOINED_WORDS):
            block = joined.slice(i, JOINED_WORDS).to_pylist()
            own = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[own]) + 1
            if len(stops) == len(block):
                ids.append(own)
                sizes.append(np.diff(stops, prepend=0))
            else:
                self._singly(block, ids, sizes)
        self._singly(other.to_pylist(), ids, sizes)
        edges = np.cumsum(np.concatenate([self.edges[-1:], *sizes]))
        # in the order of the new words
        learnt, runs = _gathered(np.concatenate(ids), edges, np.argsort(np.argsort(~simple.to_numpy(zero_copy_only=False), kind="stable")))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, learnt])
        self.edges = np.concatenate([self.edges, self.edges[-1] + runs[1:]])

    def _singly(self, words: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids.append(np.array([i for own in found for i in own], dtype="<u4"))
        sizes.append(np.array(list(map(len, found)), dtype=np.int64))


def worker_words(path: str) -> Words:
    """The tokenizer of this Python worker, which lives as long as the worker; its table of words
    is emptied after each task, so that idle workers hold no memory."""
    kept = sys.modules.setdefault("_carewise_words", types.ModuleType("_carewise_words")).__dict__
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row; ids are an array of ints."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def work(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end = np.array([end_id], dtype="<u4").tobytes()
        words = worker_words(tokenizer)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
        try:
            for part in sliced(batches, most=SLICE_BYTES):
                rows = []
                encoded = words.encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start:start + 4 * capacity]
                        row = (doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own))
                        rows.append(row + (np.frombuffer(own, dtype="<u4").astype(np.int32),) if keep_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        finally:
            words.forget()
            pa.default_memory_pool().release_unused()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, PIECE_SCHEMA + ", ids array<int>" * keep_ids)


# ------------------------------------------------------------ packing

def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins.

    Open bins are kept by their room; the room to use is the lowest set bit at or above a length.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = count = 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, count
            count += 1
        bins[i], offsets[i] = own, capacity - room
        left = room - length
        if left:
            by_room[left].append(own)
            rooms |= 1 << left
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual-feasible functions, from counts per length."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    # small items to nothing, large ones to a whole bin
    amounts = np.concatenate(([0], np.cumsum(counts * x)))
    above = np.concatenate(([0], np.cumsum(counts)))
    limit = np.arange(1, capacity // 2 + 1)
    whole = above[-1] - above[capacity - limit + 1]
    middle = amounts[capacity - limit + 1] - amounts[limit]
    if len(limit):
        best = max(best, int((-(-(whole * capacity + middle) // capacity)).max()))
    # sizes rounded down to k-th parts, except where the multiple is exact
    for k in range(1, 101):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


PACKED_SCHEMA = PIECE_SCHEMA + ", row long, sequence_id long, offset long, emptiness long, gap long"


def _pack(number: int, table: pa.Table, capacity: int) -> pa.Table:
    """Pack the items of one partition, or keep what they have if that is as good."""
    lengths = table.column("length").to_numpy()
    # the order of arrival must not matter
    order = np.lexsort((table.column("piece").to_numpy(), table.column("row").to_numpy()))
    table, lengths = table.take(pa.array(order)), lengths[order]
    bins, offsets, count = best_fit_decreasing(lengths, capacity)
    sequence = (np.int64(number) << 20) + bins
    if "sequence_id" in table.column_names:
        old = table.column("sequence_id").to_numpy()
        if len(np.unique(old)) <= count:
            sequence, offsets = old, table.column("offset").to_numpy()
    names, of = np.unique(sequence, return_inverse=True)
    filled = np.bincount(of, weights=lengths).astype(np.int64)
    emptiness = np.empty(len(names), dtype=np.int64)
    emptiness[np.argsort(filled, kind="stable")] = np.arange(len(names))
    gap = len(names) - lower_bound(lengths, capacity)
    columns = {c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "row")}
    columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(offsets), "emptiness": pa.array(emptiness[of]),
                "gap": pa.array(np.full(len(lengths), gap))}
    return pa.table(columns)


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for stored pieces that are numbered by ``row``."""

    def run(rows: DataFrame) -> DataFrame:
        def pack(key: tuple, table: pa.Table) -> pa.Table:
            return _pack(key[0].as_py(), table, capacity)

        return rows.groupBy("part").applyInArrow(pack, PACKED_SCHEMA)

    total = items.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // (capacity * PARTITION_SEQUENCES)))
    state = stored(run(items.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))), "packed")
    settled, base, pools = [], parts, parts
    while pools > 1:
        is_open = (F.col("emptiness") == 0) | ((F.col("gap") > 0) & (F.col("emptiness") < POOLED_SEQUENCES))
        settled.append(state.filter(~is_open))
        pools = -(-pools // POOLED_PARTITIONS)
        # numbers of partitions and pools lie above the low bits of a sequence id
        pool = F.pmod(F.xxhash64(F.shiftright("sequence_id", 20)), F.lit(pools)) + base
        state = stored(run(state.filter(is_open).withColumn("part", pool)), "repacked")
        base += pools
    for part in settled:
        state = state.unionByName(part)
    return state


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece."""
    found = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, keep_ids)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = packed(found.drop("ids"), capacity)
    if keep_ids:
        placed = placed.join(found.select("row", "ids"), "row")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
