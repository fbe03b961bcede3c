"""Line dedup, exact dedup and the n-gram join against brute force, and their defined cases."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carewise.llm import exact_dedup, line_dedup, ngram_join
from carewise.llm.common import components

DOCS = "doc_id long, text string, kept_text string"


def made_texts(seed, n):
    """Texts with shared lines, exact copies, near copies, nulls, blanks and one long text."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(12)]
    out = [None, "", " \n\t", "one", "One", "a b c d", " ".join(rng.choices(words, k=9000))]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.5 or len(out) < 20:
            out.append("\n".join([" ".join(rng.choices(words, k=40)), rng.choice(lines), rng.choice(lines).upper() + " "]))
        elif kind < 0.7:
            out.append(rng.choice(out[7:]))
        else:
            own = rng.choice(out[7:]).split(" ")
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    return made_texts(1, 160)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "in the way") for i, t in enumerate(texts)], DOCS).repartition(3)


# ------------------------------------------------------------ lines

def kept_by_hand(texts, counted, limit):
    def key(line):
        return line.encode().strip(b" \t\n\v\f\r").lower()

    n = defaultdict(int)
    for t in counted:
        for k in {key(line) for line in (t or "").split("\n")}:
            n[k] += 1
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or n[key(x)] < limit) for t in texts]


@pytest.mark.parametrize("carried", [1 << 20, 33, 0])
def test_lines_as_by_hand(docs, texts, carried):
    """With carried tables, with carried filters only, and with neither."""
    index = line_dedup.LineIndex.build(docs, 10)
    rows = {r["doc_id"]: r for r in index.drop_lines(docs, carried=carried).collect()}
    expected = kept_by_hand(texts, texts, 10)
    assert [rows[i]["kept_text"] for i in range(len(texts))] == expected
    assert rows[0]["n_lines"] == 1 and rows[0]["n_dropped"] == 0
    assert sum(r["n_dropped"] for r in rows.values()) > 20


def test_removal_undoes_addition(spark, docs, texts):
    first, second = docs.filter("doc_id < 90"), docs.filter("doc_id >= 90")
    index = line_dedup.LineIndex.build(first, 10)
    both = index.add(second)
    assert [r["kept_text"] for r in both.drop_lines(docs).orderBy("doc_id").collect()] == kept_by_hand(texts, texts, 10)
    back = both.remove(second)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    assert [r["kept_text"] for r in back.drop_lines(docs).orderBy("doc_id").collect()] == kept_by_hand(texts, texts[:90], 10)
    assert back.remove(first).counts.count() == 0


def test_cuckoo_filter_holds_what_went_in():
    keys = [hashlib.sha256(b"%d" % i).digest() for i in range(5000)]
    table = line_dedup.filled(keys, line_dedup.bucket_count(len(keys)))
    filters = (1, {0: (len(table), table.tobytes())})
    assert line_dedup.probe(line_dedup.heads_of(keys), line_dedup.shard_of(keys, 1), filters).all()
    other = [hashlib.sha256(b"x%d" % i).digest() for i in range(5000)]
    assert line_dedup.probe(line_dedup.heads_of(other), line_dedup.shard_of(other, 1), filters).mean() < 0.01
    line_dedup.remove(table, keys)
    assert not table.any()


def test_a_full_filter_is_rebuilt(spark):
    few = spark.createDataFrame([(i, "line %d" % (i % 4)) for i in range(40)], "doc_id long, text string")
    many = spark.createDataFrame([(i, "\n".join("other %d" % k for k in range(200))) for i in range(10)], "doc_id long, text string")
    index = line_dedup.LineIndex.build(few, 10).add(many)
    assert index.filters.agg(F.sum("keys")).first()[0] == 204
    assert index.drop_lines(many).agg(F.sum("n_dropped")).first()[0] == 2000


def test_lines_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.LineIndex.build(empty).drop_lines(empty).count() == 0


# ------------------------------------------------------------ exact copies

def groups_by_hand(texts):
    last, size = {}, defaultdict(int)
    for i, t in enumerate(texts):
        last[t or ""] = i
        size[t or ""] += 1
    return {i: (last[t or ""], size[t or ""], last[t or ""] == i) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bases, prime", [(exact_dedup.BASES, exact_dedup.PRIME), ((3,), 5)])
def test_copies_as_by_hand(docs, texts, bases, prime):
    """The second fingerprint collides all the time, so that only the comparison tells texts apart."""
    got = exact_dedup.exact_duplicates(docs, bases=bases, prime=prime).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == groups_by_hand(texts)
    assert all(r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in got)


def test_chunks_compose(spark):
    data = bytes(random.Random(3).randrange(256) for _ in range(150_000))
    whole = [lane[0] for lane in exact_dedup.fingerprints([data])]
    starts = [0, 7, 70_000, 140_001]
    rows = [(1, s, data[s:e]) for s, e in zip(starts, [*starts[1:], len(data)])]
    random.Random(1).shuffle(rows)
    got = exact_dedup.fingerprint_chunks(spark.createDataFrame(rows, "doc_id long, start long, chunk binary")).first()
    assert [got[lane] for lane in exact_dedup.LANES] == whole and got["n_bytes"] == len(data)


def test_long_and_repeated_rows(spark):
    long = "é" * 200_000
    rows = [(1, long), (2, long), (3, long[:-1] + "e"), (4, "x"), (4, "x"), (None, "x")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if (r["doc_id"] or 0) < 4 and r["doc_id"]) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    same = [r for r in got if r["keep_id"] == 4]
    assert len(same) == 3 and sum(r["kept"] for r in same) == 1
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------ n-gram join

def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def components_by_hand(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width, percent", [(4, 85), (2, 50)])
def test_join_as_by_hand(docs, texts, width, percent, with_partitions):
    for partitions in (1, 5):
        with_partitions(partitions)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, width=width, percent=percent).collect()}
        assert [got[i] for i in range(len(texts))] == components_by_hand(texts, width, percent)


def test_near_copies_in_chains(spark):
    """Each text is near the one before it and far from the first."""
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(200)]
    texts = []
    for k in range(40):
        texts.append(" ".join(words))
        words[k * 5] = f"new{k}"
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similar_components(rows).select("doc_id", "component_id").collect()))
    assert got == [(i, c) for i, (_, c) in enumerate(components_by_hand(texts, 4, 85))]
    assert {c for _, c in got} == {0}


def test_join_cases(spark):
    rows = [(None, "p q r s t"), (1, "p q r s t"), (2, None), (2, "short"), (7, "SHORT"), (7, "u v w x y z"), (9, "")]
    got = sorted(map(tuple, ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, None), (1, 2, None), (2, 0, 2), (2, 1, 2), (7, 1, 2), (7, 3, 7), (9, 0, 9)], key=repr)
    assert ngram_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5002), (5002, 5000), (9, 9)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(200)} == {1000}
    assert got[5002] == 5000 and len(got) == 301 + 200 + 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
