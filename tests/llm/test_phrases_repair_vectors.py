"""Phrases, conversation repair and near vectors against plain versions."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from carewise.llm import collocations as P
from carewise.llm import conversation_repair as C
from carewise.llm import lattice_dedup as V
from carewise.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ------------------------------------------------------------ phrases

DOCS = "doc_id long, text string, lang string, n string, first string, slice string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, (t, lang) in enumerate(rows)], DOCS)


def plain_phrases(rows, least, inside, most):
    f = collections.defaultdict(collections.Counter)
    totals = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            longer = [n for other, n in counts.items() if len(other) == 3 and n >= least and len(phrase) == 2 and phrase in (other[:2], other[1:])]
            if not any(100 * n >= inside * a for n in longer):
                found.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrases_of(docs, **kinds):
    return sorted(tuple(r) for r in P.collocations(docs, **kinds).collect())


@pytest.mark.parametrize("partitions", [1, 7])
def test_phrases_as_by_hand(spark, with_partitions, partitions):
    with_partitions(partitions)
    rng = random.Random(3)
    words = ["New", "york", "city", "é", "ÄB", "the", "of", "a b", "x y", "z\x1c"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 11), k=rng.randint(0, 60))) + rng.choice([".", "\n", "\t", ", ", ""]) * 2, rng.choice(["en", "de", None])) for _ in range(60)]
    rows += [("New York City. " * 9, "en"), (None, "en"), ("", None), (" \t ", "fr"), ("lone", "es"), ("one two three " * 4000, "it")] * 2
    docs = docs_of(spark, rows).repartition(5)
    assert phrases_of(docs, least=3, phrases=15) == plain_phrases(rows, 3, 50, 15)
    assert phrases_of(docs, least=1, inside_percent=80, phrases=None) == plain_phrases(rows, 1, 80, 10**9)


def test_words_in_slices(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE_ROWS", 2)
    monkeypatch.setattr(P, "SLICE_BYTES", 700)
    monkeypatch.setattr(P, "ROWS", 7)
    monkeypatch.setattr(P, "FILTER_BITS", 1 << 6)  # lets nearly all through
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["Ä", "a", f"ßB{rng.randint(0, 9)}"]) for _ in range(80)), "en") for _ in range(30)]
    assert phrases_of(docs_of(spark, rows), least=2) == plain_phrases(rows, 2, 50, 2000)


def test_filter_comes_to_the_driver_as_bytes(spark, monkeypatch, with_partitions):
    """The driver gets a row for many words of the filter, which holds just the bits of its pairs."""
    with_partitions(3)
    monkeypatch.setattr(P, "PART_MASKS", 64)
    rows = [("en" if i % 3 else "und", f"w{i % 70}", f"v{i // 70}") for i in range(5000)]
    made, store = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, *a: made.append(store(df, *a)) or made[-1])
    monkeypatch.setattr("pyspark.sql.DataFrame.toPandas", lambda self: pytest.fail("rows of the filter go to the driver"))
    found = P.PairFilter.learn(spark.createDataFrame(rows, "lang string, first string, second string").repartition(4))
    assert [df.count() <= found.bits // 64 // 64 for df in made] == [True]
    import pyarrow as pa

    kinds = [pa.array(c).dictionary_encode() for c in zip(*rows)]
    words = pa.concat_arrays([kinds[1].dictionary, kinds[2].dictionary])
    lang, first, second = (np.asarray(k.indices, dtype=np.int64) for k in kinds)
    keys = P.pair_keys(kinds[0].dictionary, words, lang, first, second + len(kinds[1].dictionary))
    table = np.zeros(found.bits // 64, dtype=np.uint64)
    for slot in P._slots(keys, found.bits):
        np.bitwise_or.at(table, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
    assert np.array_equal(found.table, table) and found.holds(keys).all()


def test_counts_past_64_bits():
    import pyarrow as pa

    n = 1 << 40
    batch = pa.RecordBatch.from_pydict({"lang": ["x"], "phrase": ["a b c"], "a": [n], "l1": [n + 1], "r1": [n], "l2": [n], "r2": [n + 1]})
    out = next(P._scored([batch])).to_pylist()[0]
    assert out == {"lang": "x", "phrase": "a b c", "a": n, "l": n + 1, "r": n, "score": 1_000_000 * n // (n + 1)}


def test_no_phrases(spark):
    assert phrases_of(docs_of(spark, [("a b", "en")]).limit(0)) == []
    assert phrases_of(docs_of(spark, [(None, None), ("", "en")])) == []


# ------------------------------------------------------------ conversations

TURNS = "conv_id long, turn long, role string, text string, pos string, block string"


def cheapest(rows):
    """Letters as the operator has them; every prefix by cost and initials."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, done = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(rows) and s in (0, 3):
            return cost, audit, done
        then = {0: 2, 1: 2, 2: 3, 3: 2}[s]
        role = {2: "user", 3: "assistant"}[then]
        heapq.heappush(heap, (cost + 2, audit + "I", i, then, done + ((role, ""),)))
        if i == len(rows):
            continue
        own, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, done))
        if fault in ("blank", "duplicate"):
            continue
        extra = fault == "truncated"
        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, then, done + ((role, text),)))
        kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}.get((own[:1], s))
        if kept is not None:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept, done + ((own, text),)))


def plain_repairs(rows):
    kept = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in kept.items():
        own.sort()
        seen, judged, counts = set(), [], collections.Counter()
        for _, _, role, text in own:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        turns = {t for known, t, _, _ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, done = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=repr)


def repairs_of(turns, **kinds):
    found = C.repair_digest(turns, **kinds)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize(("partitions", "bits"), [(1, 14), (6, 0), (6, 2)])
def test_repairs_as_by_hand(spark, with_partitions, partitions, bits):
    with_partitions(partitions)
    rng = random.Random(partitions + bits)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randint(1, 14)):
            text = rng.choice(["Yes.", "No", "", " \t\n", "Why? ", "ok!\n", None, "é.", "Yes."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), text))
    rows += [(777, t, "user" if t % 3 else "assistant", f"text {t % 40}.") for t in range(700)]
    rows += rng.choices(rows, k=40)
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(4)
    assert repairs_of(turns, block_bits=bits) == plain_repairs(rows)


def test_cheapest_edits(spark):
    rng = random.Random(9)
    kinds = {c: (("X", "t", "blank") if c == "X" else (c.lower(), "t", "truncated" if c.isupper() else None)) for c in "suaoSUAOX"}
    for _ in range(600):
        rows = "".join(rng.choices("suaoSUAOX", weights=[1, 4, 4, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 12)))
        cost, audit, marks, _ = C.closed(rows, C.bounds(rows, C.CLOSING), 0, True)
        expected = cheapest([kinds[c] for c in rows])
        assert (cost, audit) == expected[:2] and len(marks) == len(rows) or not rows


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Hm"), (1, 2, "user", "Hm"), (2, 0, "user", " ")]
    repair = C.Repair(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS))
    found = [tuple(r) for r in repair.rows().orderBy("conv_id", "pos", "place").select("conv_id", "role", "text").collect()]
    audits = dict(repair.summary().select("conv_id", "audit").collect())
    assert audits == {1: "IKDD", 2: "D"}
    assert found == [(1, "user", ""), (1, "assistant", "Hi.")]


def test_no_conversations(spark):
    assert repairs_of(spark.createDataFrame([], TURNS)) == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repairs_of(spark.createDataFrame([(lost, 0, "user", "a", "", "")], TURNS)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ------------------------------------------------------------ vectors

VECTORS = "vec_id long, embedding array<double>, row string, v string, cell string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b", "c") for i, v in rows], VECTORS)


def plain_links(rows, least=0.9):
    usable = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    groups = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    by_length = collections.defaultdict(list)
    for k, v in usable:
        v = v / np.abs(v).max()
        by_length[len(v)].append((k, v / np.linalg.norm(v)))
    for own in by_length.values():
        m = np.array([v for _, v in own])
        for i, j in zip(*np.nonzero(m @ m.T >= least)):
            if i != j:
                a, b = own[i][0], own[j][0]
                links[a] += 1
                groups[max(root(a), root(b))] = min(root(a), root(b))
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in ids[root(k)] if x is not None]
        c = min(known) if known else None
        out.append((i, links[k], c, i == c))
    return sorted(out, key=repr)


def clusters(seed, dims=64, lone=150, groups=12, spread=0.03):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dims) for _ in range(lone)]
    for g in range(groups):
        centre = rng.standard_normal(dims)
        size = 60 if g == 0 else int(rng.integers(2, 9))
        noise = spread if g % 2 else spread * 6
        rows += [(centre + noise * rng.standard_normal(dims)) * rng.uniform(0.1, 10) for _ in range(size)]
    return [(i, v.tolist()) for i, v in enumerate(rng.permutation(rows))]


@pytest.mark.parametrize("partitions", [1, 6])
def test_links_as_by_brute_force(spark, with_partitions, partitions):
    with_partitions(partitions)
    rows = clusters(partitions)
    rows += [(None, rows[3][1]), (500, rows[3][1]), (500, rows[5][1]), (501, None), (502, []), (503, [0.0] * 64), (504, [float("nan")] * 64),
             (505, [None] + [1.0] * 63), (506, [1.0] * 3), (507, [2.0] * 3), (508, [float("inf")] * 64), (509, [1e300 * x for x in rows[0][1]]), (510, [1.0])]
    found = V.near_vectors(vectors_of(spark, rows).repartition(3), recall=0.9999)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_links(rows)


def test_recall_at_the_threshold(spark):
    """Pairs that are just at the cosine: at least nine of ten are found, and nothing below it."""
    rng = np.random.default_rng(8)
    rows = []
    for cosine in np.repeat([0.9001, 0.92, 0.88], 150):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        rows += [x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)]
    found = {r["vec_id"]: r["n_links"] for r in V.near_vectors(vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(rows)])).collect()}
    share = [np.mean([found[i] for i in range(300 * k, 300 * (k + 1))]) for k in range(3)]
    assert share[0] >= 0.95 and share[1] >= 0.97 and share[2] == 0


def test_nearest_points():
    rng = np.random.default_rng(2)
    around = V.neighbours()
    assert around.shape == (240, 8) and np.allclose((around**2).sum(1), 2) and len(np.unique(around, axis=0)) == 240
    x = rng.uniform(-3, 3, (500, 8))
    points = V.nearest(x)
    distance = ((x - points) ** 2).sum(1)
    assert (distance <= 1 + 1e-9).all()  # the covering radius
    for v in around:
        assert (distance <= ((x - points - v) ** 2).sum(1) + 1e-9).all()


def test_no_vectors(spark):
    assert V.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert [tuple(r) for r in V.near_vectors(vectors_of(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_links_as_by_sql(spark, tmp_path):
    rows = [(i, v) for i, v in clusters(5, lone=40)]
    vectors_of(spark, rows).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    own = sorted(tuple(r) for r in queries.op13_embedding_near_dedup(spark, str(tmp_path)).collect())
    assert own == sorted(engine.sql(queries.OP13_SQL).fetchall())
