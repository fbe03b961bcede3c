"""Near duplicates among vectors, found through cells of the E8 lattice.

Every table projects a vector onto a few random directions, eight for each lattice, and decodes the
projection to the nearest lattice points. A vector lives in that cell and looks into the cells next to
it that it is closest to. Candidates pass a comparison of 128 signs before a vector is fetched; links
are decided by the cosine in double precision.

Copies do not lead to pairs of all with all: vectors within half the angle of one leader (the smallest
one of a shared cell) form a ball. Members of a ball are linked with each other by the triangle
inequality, so they are counted, not compared. What remains are pairs of balls that meet in a cell;
their members are compared block by block, and a comparison returns counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.llm.common import components
from carewise.session import broadcast_if_small, stored

SLICE = 1024
BLOCK = 24
SIGNS = 128
# So many standard deviations more unequal signs than expected are let through.
DEVIATIONS = 6


@dataclass(frozen=True)
class Lattice:
    """How cells are made. ``scale`` is the lattice's unit where coordinates of random unit vectors
    have the variance 1."""

    cosine: float = 0.9
    tables: int = 9
    blocks: int = 2
    probes: int = 3
    scale: float = 2.4
    seed: int = 13


def lattice_for(rows: int, dims: int, cosine: float = 0.9, recall: float = 0.99, start: Lattice = Lattice()) -> Lattice:
    """Cells that get finer as rows get more, so that the strangers met in a cell stay few, and as
    many tables as find the share ``recall`` of pairs that are just at the cosine (all the more of
    closer ones). The share per table is measured on 2,000 random pairs of that cosine."""
    finer = (max(rows, 100_000) / 100_000) ** (-1 / (8 * start.blocks))
    one = replace(start, cosine=cosine, scale=start.scale * finer, tables=1)
    rng = np.random.default_rng(start.seed)
    x, y = rng.standard_normal((2, 2000, max(dims, 2)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (home_x, probe_x), (home_y, probe_y) = cells(x, one), cells(y, one)
    met = (home_x == home_y).any(1) | (probe_x == home_y).any(1) | (probe_y == home_x).any(1)
    share = min(max(met.mean(), 0.01), 0.999)
    return replace(one, tables=max(1, math.ceil(math.log(1 - recall) / math.log(1 - share))))


# ------------------------------------------------------------ cells

@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of a half with an even number of minus signs."""
    found = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                found.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            found.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum: round, and where the sum is odd round the worst entry the other way."""
    whole = np.rint(x)
    odd = np.flatnonzero(whole.sum(1) % 2)
    error = x[odd] - whole[odd]
    worst = np.abs(error).argmax(1)
    whole[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return whole


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is the even whole points and the same moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(maxsize=64)
def _directions(dims: int, lattice: Lattice, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, the lattice's shift and multipliers for the key of a cell."""
    rng = np.random.default_rng([lattice.seed, table, dims])
    width = 8 * lattice.blocks
    drawn = rng.standard_normal((dims, width))
    if dims >= width:
        drawn = np.linalg.qr(drawn)[0] * math.sqrt(dims)
    return drawn / lattice.scale, rng.random(width), rng.integers(1, 1 << 63, width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def cells(unit: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the home cell per table and of the cells next to it, nearest first."""
    n, dims = unit.shape
    homes, probes = [], []
    around = neighbours()
    for table in range(lattice.tables):
        directions, shift, factors = _directions(dims, lattice, table)
        y = unit @ directions + shift
        home = np.hstack([nearest(y[:, 8 * b : 8 * b + 8]) for b in range(lattice.blocks)])
        rest = y - home
        # |r - v|^2 - |r|^2 = 2 - 2 r.v for each of the shortest vectors v.
        added = np.hstack([-(rest[:, 8 * b : 8 * b + 8] @ around.T) for b in range(lattice.blocks)])
        doubled = np.rint(2 * home).astype(np.int64).view(np.uint64)
        key = (doubled * factors[:-1]).sum(1, dtype=np.uint64) + factors[-1]
        homes.append(_mixed(key))
        if lattice.probes:
            near = np.argpartition(added, lattice.probes - 1, axis=1)[:, : lattice.probes]
            steps = np.vstack([np.rint(2 * around).astype(np.int64).view(np.uint64) @ factors[8 * b : 8 * b + 8] for b in range(lattice.blocks)]).ravel()
            probes.append(_mixed(key[:, None] + steps[near]))
    return np.stack(homes, 1), np.hstack(probes) if probes else np.empty((n, 0), np.int64)


def signs(unit: np.ndarray, lattice: Lattice) -> np.ndarray:
    """128 signs of random projections as two whole numbers."""
    rng = np.random.default_rng([lattice.seed, 1 << 20, unit.shape[1]])
    bits = (unit @ rng.standard_normal((unit.shape[1], SIGNS)) >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, 2)


def most_unequal(angle: float) -> int:
    p = min(angle / math.pi, 0.5)
    return math.floor(SIGNS * p + DEVIATIONS * math.sqrt(SIGNS * p * (1 - p))) + 1


def units(column: pa.ListArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Row numbers and unit vectors of the usable vectors, by length."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    rows, found = [], []
    for length in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == length)
        x = flat[starts[own][:, None] + np.arange(length)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        x, own = x[good], own[good]
        if len(own):
            x = x / np.abs(x).max(1, keepdims=True)
            rows.append(own)
            found.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    return rows, found


def _signed(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                for own, unit in zip(*units(batch.column("v"))):
                    homes, probes = cells(unit, lattice)
                    s = signs(unit, lattice)
                    columns = [
                        batch.column("row").take(pa.array(own)), pa.array(np.ascontiguousarray(s[:, 0])), pa.array(np.ascontiguousarray(s[:, 1])),
                        pa.array(list(homes), pa.list_(pa.int64())), pa.array(list(probes), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "s1", "s2", "homes", "probes"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cosine of a row's vector and its leader's; vectors of different lengths have none."""
    for batch in batches:
        rows, left = units(batch.column("v"))
        cosine = np.full(batch.num_rows, -2.0)
        at, right = {}, units(batch.column("lead_v"))
        for own, unit in zip(*right):
            at.update(zip(own.tolist(), unit))
        for own, unit in zip(rows, left):
            for i, x in zip(own.tolist(), unit):
                y = at.get(i)
                if y is not None and len(x) == len(y):
                    cosine[i] = x @ y
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("lead"), pa.array(cosine)], ["row", "lead", "cosine"])


def _singles(batch: pa.RecordBatch, alone: np.ndarray, cosine: float) -> list[tuple[int, int, int, int]]:
    """Links of blocks of one member each, all at once."""
    rows, vectors = [], []
    for side in ("left", "right"):
        column = batch.column(side)
        starts = np.cumsum(np.append(0, np.asarray(pa.compute.list_value_length(column))))[:-1][alone]
        members = column.flatten().take(pa.array(starts))
        rows.append(np.asarray(members.field("row")))
        vectors.append({unit.shape[1]: (own, unit) for own, unit in zip(*units(members.field("v")))})
    a, b = (np.asarray(batch.column(c))[alone] for c in ("a", "b"))
    out: list[tuple[int, int, int, int]] = []
    for length, (own, unit) in vectors[0].items():
        if length in vectors[1]:
            other, second = vectors[1][length]
            both, i, j = np.intersect1d(own, other, return_indices=True)
            hit = both[np.einsum("ij,ij->i", unit[i], second[j]) >= cosine]
            for side in rows:
                out += zip(a[hit].tolist(), b[hit].tolist(), side[hit].tolist(), [1] * len(hit))
    return out


def _compared(cosine: float):
    """Links between two blocks of members: per member how many, on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [np.asarray(pa.compute.list_value_length(batch.column(side))) for side in ("left", "right")]
            alone = (sizes[0] == 1) & (sizes[1] == 1)
            out = _singles(batch, np.flatnonzero(alone), cosine)
            for i in np.flatnonzero(~alone).tolist():
                sides = []
                for side in ("left", "right"):
                    block = batch.column(side)[i].values
                    sides.append((block.field("row").to_numpy(zero_copy_only=False), *units(block.field("v"))))
                (rows_a, own_a, units_a), (rows_b, own_b, units_b) = sides
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                for own, x in zip(own_a, units_a):
                    for other, y in zip(own_b, units_b):
                        if x.shape[1] == y.shape[1]:
                            linked = x @ y.T >= cosine
                            for rows, counts in ((rows_a[own], linked.sum(1)), (rows_b[other], linked.sum(0))):
                                hit = counts > 0
                                out += [(a, b, r, n) for r, n in zip(rows[hit].tolist(), counts[hit].tolist())]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "row", "links"])

    return run


# ------------------------------------------------------------ links

def _unequal(*pairs: tuple[Column, Column]) -> Column:
    first, second = (F.bit_count(x.bitwiseXOR(y)) for x, y in pairs)
    return first + second


def _sent(df: DataFrame, name: str) -> DataFrame:
    return broadcast_if_small(stored(df, name))[0]


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, recall: float = 0.99, lattice: Lattice | None = None
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    ``n_links`` counts the other rows found at a cosine of ``cosine`` or more, ``component_id`` is the
    smallest key reachable by links, ``kept`` says whether it is the row's own. Cells and tables follow
    the number of rows (``lattice_for``), unless a ``lattice`` is given.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Rows that repeat a key are vectors of their own, a null key is no
    smallest one, an empty table gives no rows, and other columns are not looked at.
    """
    # The angle of half a link; the margin is above the rounding of a cosine.
    angle = math.acos(cosine)
    half = math.cos(angle / 2) + 1e-9
    numbered = stored(vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    if lattice is None:
        size = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dims")).first()
        lattice = lattice_for(size["n"], size["dims"], cosine, recall)
    known = numbered.select("row", "v")
    signed = stored(known.mapInArrow(_signed(lattice), "row long, s1 long, s2 long, homes array<long>, probes array<long>"), "cells")

    # Balls: the smallest row of a shared cell leads those within half the angle.
    homes = signed.select("row", "s1", "s2", F.explode("homes").alias("cell"))
    leads = homes.groupBy("cell").agg(F.min(F.struct("row", "s1", "s2")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leads = leads.select("cell", F.col("l.row").alias("lead"), F.col("l.s1").alias("l1"), F.col("l.s2").alias("l2"))
    close = _unequal((F.col("s1"), F.col("l1")), (F.col("s2"), F.col("l2"))) <= most_unequal(angle / 2)
    led = stored(homes.join(leads, "cell").filter((F.col("row") != F.col("lead")) & close).select("row", "lead").distinct(), "led")
    lead_vectors = _sent(known.join(_sent(led.select(F.col("lead").alias("row")).distinct(), "leads"), "row").select(F.col("row").alias("lead"), F.col("v").alias("lead_v")), "lead-vectors")
    measured = led.join(known, "row").join(lead_vectors, "lead").select("row", "lead", "v", "lead_v").mapInArrow(_cosines, "row long, lead long, cosine double")
    balls = _sent(measured.filter(F.col("cosine") >= half).groupBy("row").agg(F.min("lead").alias("ball")), "balls")
    own_signs = signed.select("row", "s1", "s2")
    led_signs = _sent(own_signs.join(_sent(balls.select(F.col("ball").alias("row")).distinct(), "ball-rows"), "row").select(F.col("row").alias("ball"), F.col("s1").alias("b1"), F.col("s2").alias("b2")), "ball-signs")
    members = signed.join(balls, "row", "left").join(led_signs, "ball", "left").select(
        "row", F.coalesce("ball", "row").alias("ball"), F.col("ball").isNotNull().alias("wide"),
        F.coalesce("b1", "s1").alias("b1"), F.coalesce("b2", "s2").alias("b2"), "homes", "probes")
    members = stored(members, "members")

    # Pairs of balls that meet in a cell, one of them at home there.
    looks = members.select("ball", "wide", "b1", "b2", F.explode("homes").alias("cell"), F.lit(True).alias("home")).unionByName(
        members.select("ball", "wide", "b1", "b2", F.explode("probes").alias("cell"), F.lit(False).alias("home")))
    met = looks.groupBy("cell", "ball", "b1", "b2").agg(F.max("home").alias("home"), F.max("wide").alias("wide"))
    left = met.select("cell", *[F.col(c).alias(f"l_{c}") for c in ("ball", "b1", "b2", "home", "wide")])
    right = met.select("cell", *[F.col(c).alias(f"r_{c}") for c in ("ball", "b1", "b2", "home", "wide")])
    limits = [most_unequal(angle * (1 + wide / 2)) for wide in range(3)]
    limit = F.when(F.col("l_wide") & F.col("r_wide"), limits[2]).when(F.col("l_wide") | F.col("r_wide"), limits[1]).otherwise(limits[0])
    signs_near = _unequal((F.col("l_b1"), F.col("r_b1")), (F.col("l_b2"), F.col("r_b2"))) <= limit
    meeting = left.join(right, "cell").filter((F.col("l_ball") < F.col("r_ball")) & (F.col("l_home") | F.col("r_home")) & signs_near)
    pairs = stored(meeting.select(F.col("l_ball").alias("a"), F.col("r_ball").alias("b")).distinct(), "ball-pairs")

    # Members of such balls, block by block.
    sizes = stored(members.groupBy("ball").agg(F.count(F.lit(1)).alias("n")), "ball-sizes")
    paired = pairs.select(F.col("a").alias("ball")).unionByName(pairs.select(F.col("b").alias("ball"))).distinct()
    cut = _sent(sizes.join(paired, "ball").select("ball", F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts")), "ball-cuts")
    blocks = members.select("row", "ball").join(cut, "ball").join(known, "row").withColumn("part", F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int"))
    packed = stored(blocks.groupBy("ball", "part").agg(F.collect_list(F.struct("row", "v")).alias("block")), "blocks")

    def side(name: str, ball: str) -> DataFrame:
        return packed.select(F.col("ball").alias(ball), F.col("part").alias(f"{ball}_part"), F.col("block").alias(name))

    # A part that the hash leaves empty has no row in ``packed`` and falls out of the join.
    tiles = pairs.join(cut.select(F.col("ball").alias("a"), F.col("cuts").alias("a_cuts")), "a").join(
        cut.select(F.col("ball").alias("b"), F.col("cuts").alias("b_cuts")), "b")
    tiles = tiles.withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_cuts") - 1))).withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("b_cuts") - 1)))
    tiles = tiles.join(side("left", "a"), ["a", "a_part"]).join(side("right", "b"), ["b", "b_part"])
    links = stored(tiles.select("a", "b", "left", "right").mapInArrow(_compared(cosine), "a long, b long, row long, links long"), "links")

    # Rows, their links and components.
    joined = components(links.select("a", "b").distinct())
    counted = _sent(links.groupBy("row").agg(F.sum("links").alias("links")), "link-counts")
    groups = _sent(joined.select(F.col("node").alias("ball"), "component"), "components")
    within = _sent(sizes.filter("n > 1"), "wide-balls")
    placed = members.select("row", "ball").join(groups, "ball", "left").join(within, "ball", "left").select(
        "row", F.coalesce("component", "ball").alias("component"), (F.coalesce("n", F.lit(1)) - 1).alias("within"))
    placed = placed.join(counted, "row", "left").select("row", "component", (F.col("within") + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = stored(placed.filter("n_links > 0").join(numbered.select("row", "id"), "row"), "linked")
    smallest = _sent(linked.groupBy("component").agg(F.min("id").alias("least")), "smallest")
    sent = _sent(linked.join(smallest, "component").select("row", "n_links", "least"), "linked-rows")
    out = numbered.select("row", "id").join(sent, "row", "left")
    least = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), least.alias("component_id"),
        F.col("id").eqNullSafe(least).alias("kept"))
