"""Exact de-duplication by composable polynomial fingerprints.

A text's UTF-8 bytes, as numbers x_0, x_1, ..., have the fingerprint sum(x_k * B^k) modulo a
prime, on several lanes of different bases, together with the length. The fingerprint of a
joined text follows from those of its parts: fp(ab) = fp(a) + B^len(a) * fp(b). So a huge text
is hashed in chunks, in parallel, and the chunk hashes are shifted by their offsets and summed.
Texts with equal fingerprints are then compared chunk by chunk with one text of their group; a
text that differs in any chunk goes on with the others that do, so the result is exact.

Defined cases: null counts as empty, and empty texts are equal; of equal texts the row with the
largest doc_id (null is the smallest) stays; of rows that repeat doc_id and text too, exactly one
is marked as kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carewise.llm.common import sliced
from carewise.session import broadcast_if_small, stored

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_567_483_333, 214_013_987)
CHUNK = 1 << 16
# Members of a group that meet one copy of its representative in a task.
MEMBERS_PER_SALT = 256
LANES = [f"f{i}" for i in range(len(BASES))]


def powers(base: int, count: int, prime: int = PRIME) -> np.ndarray:
    """B^0 .. B^(count-1), by doubling."""
    out = np.ones(max(count, 1), dtype=np.uint64)
    done, step = 1, base % prime
    while done < count:
        more = min(done, count - done)
        out[done:done + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        done += more
        step = step * step % prime
    return out[:count]


def chunk_hash(data: np.ndarray, powers_of: np.ndarray, prime: int = PRIME) -> int:
    """Fingerprint of one chunk of at most CHUNK bytes on one lane."""
    return int((data * powers_of[: len(data)] % np.uint64(prime)).sum() % np.uint64(prime))


def shifted(value: int, base: int, offset: int, prime: int = PRIME) -> int:
    """What a chunk that starts at ``offset`` adds to the fingerprint of its text."""
    return value * pow(base, offset, prime) % prime


def fingerprints(texts: list[bytes], bases=BASES, prime: int = PRIME) -> list[list[int]]:
    """Per lane the fingerprints of whole texts, from their chunks."""
    tables = [powers(b, CHUNK, prime) for b in bases]
    lanes: list[list[int]] = [[] for _ in bases]
    for data in texts:
        total = [0] * len(bases)
        for start in range(0, len(data), CHUNK):
            # bytes are raised by one, so that a zero byte counts
            part = np.frombuffer(data, dtype=np.uint8, count=min(CHUNK, len(data) - start), offset=start).astype(np.uint64) + np.uint64(1)
            for i, base in enumerate(bases):
                total[i] = (total[i] + shifted(chunk_hash(part, tables[i], prime), base, start, prime)) % prime
        for i, value in enumerate(total):
            lanes[i].append(value)
    return lanes


def fingerprint_chunks(chunks: DataFrame, key: str = "doc_id", bases=BASES, prime: int = PRIME) -> DataFrame:
    """(key, f0.., n_bytes) from a table (key, start, chunk) of byte chunks in any order.

    The chunks of one document may lie on different machines; their shifted hashes are summed.
    """

    def hashes(batches):
        for part in sliced(batches, "chunk"):
            starts, data = part.column("start").to_pylist(), [c or b"" for c in part.column("chunk").to_pylist()]
            own = fingerprints(data, bases, prime)
            moved = [pa.array([shifted(v, b, s, prime) for v, s in zip(lane, starts)], pa.int64()) for lane, b in zip(own, bases)]
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(map(len, data), pa.int64()), *moved], ["_key", "n_bytes", *LANES[: len(bases)]])

    kind = dict(chunks.dtypes)[key]
    lanes = LANES[: len(bases)]
    schema = f"_key {kind}, n_bytes long, " + ", ".join(f"{c} long" for c in lanes)
    rows = chunks.select(F.col(key).alias("_key"), "start", F.col("chunk").cast("binary").alias("chunk")).mapInArrow(hashes, schema)
    return rows.groupBy(F.col("_key").alias(key)).agg(
        *[F.pmod(F.sum(c), F.lit(prime)).alias(c) for c in lanes], F.sum("n_bytes").alias("n_bytes")
    )


def _prints(whole: DataFrame, bases, prime) -> DataFrame:
    """(doc_id, text, n_bytes, lanes, text_sha256) per row."""
    lanes = LANES[: len(bases)]

    def work(batches):
        for part in sliced(batches):
            data = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            own = [pa.array(lane, pa.int64()) for lane in fingerprints(data, bases, prime)]
            digests = pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())
            columns = [part.column("doc_id"), part.column("text"), pa.array(map(len, data), pa.int64()), *own, digests]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_bytes", *lanes, "text_sha256"])

    schema = "doc_id long, text string, n_bytes long, " + ", ".join(f"{c} long" for c in lanes) + ", text_sha256 string"
    return whole.mapInArrow(work, schema)


def exact_duplicates(docs: DataFrame, text: str = "text", bases=BASES, prime: int = PRIME) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    group = ["n_bytes", *LANES[: len(bases)], "split"]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = stored(_prints(whole, bases, prime).withColumn("row", F.monotonically_increasing_id()), "prints")
    rows = held.drop("text").withColumn("split", F.lit(0))
    while True:
        groups = stored(
            rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")),
            "print-groups",
        )
        differing = stored(_differing(held.select("row", "n_bytes", "text"), rows, groups, group), "differing")
        if not differing.take(1):
            break
        # true collisions leave their group and are grouped among themselves
        marked = rows.join(differing.withColumn("_differs", F.lit(1)), "row", "left")
        rows = stored(marked.withColumn("split", F.col("split") + F.coalesce("_differs", F.lit(0))).drop("_differs"), "prints-split")
    return rows.join(groups, group).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
    )


def _differing(texts: DataFrame, rows: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """Rows whose text is not that of their group's kept row, by comparison chunk by chunk.

    Each group's representative is sent once for every MEMBERS_PER_SALT members, so that a group
    of any size is spread over the tasks.
    """
    salts = F.ceil(F.col("group_size") / MEMBERS_PER_SALT).cast("int")
    members = stored(
        rows.join(groups.filter("group_size > 1"), group).select(
            "row", F.col("keep.row").alias("keep_row"), F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"), salts.alias("salts")
        ),
        "members",
    )
    sent, _ = broadcast_if_small(members)
    size = F.lit(CHUNK)
    last = F.greatest(F.ceil(F.col("n_bytes") / size).cast("int"), F.lit(1)) - 1
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("text").cast("binary"), i * size + 1, size))
    chunks = stored(
        texts.join(sent, "row").select("row", "keep_row", "salt", "salts", F.posexplode(pieces).alias("part", "chunk")), "chunks"
    )
    representatives = chunks.filter("row = keep_row").select(
        "keep_row", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("chunk").alias("expected")
    )
    compared = chunks.filter("row <> keep_row").join(representatives, ["keep_row", "part", "salt"])
    return compared.filter("chunk <> expected").select("row").distinct()
