import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carewise.operators import retrieval as RT
from carewise.operators import topk
from carewise.operators import termcount
from carewise.operators.tfidf import TfidfSettings, frequent_terms, term_stats, vocabulary, vocabulary_of
from carewise.operators.topk import best_hits

STOPS = ("i", "my", "in", "the", "on", "up", "us", "we", "will", "a", "to", "and", "of", "it", "is")


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conversation_id string, customer_message string, support_reply string")


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, query string")


@pytest.fixture(scope="module")
def three(spark):
    return RT.ConversationIndex.fit(conversations(spark, [
        ("U1", "The parcel came without its lid.", "Write to the desk, please."),
        ("U2", "Two tickets were billed for one seat.", "The seat office looks at each ticket."),
        ("U3", "A green umbrella stayed on the train.", "Ask at the lost property counter."),
    ]))


def test_shared_word_ranks_first_and_zero_scores_fill_up(spark, three):
    hits = three.search(queries(spark, ("q", "whose umbrella was it")), top_k=2, threshold=0.0).orderBy("rank").collect()
    assert [(r["rank"], r["conversation_id"]) for r in hits] == [(1, "U3"), (2, "U1")]
    assert hits[0]["similarity_score"] > 0 and hits[1]["similarity_score"] == 0
    assert hits[0]["support_reply"] == "Ask at the lost property counter."


def test_blank_and_unrelated_queries(spark, three):
    asked = queries(spark, ("empty", ""), ("blank", " \n "), ("null", None), ("other", "quarterly invoice numbers"))
    assert three.search(asked, threshold=0.5).count() == 0
    filled = three.search(asked, threshold=0.0, top_k=2).collect()
    assert sorted((r["query_id"], r["conversation_id"]) for r in filled) == [("other", "U1"), ("other", "U2")]


def test_save_and_load(spark, three, tmp_path):
    three.save(str(tmp_path / "index"))
    again = RT.ConversationIndex.load(spark, str(tmp_path / "index"))
    asked = queries(spark, ("q", "the ticket for that seat"), ("r", "the parcel and the counter"))
    assert sorted(three.search(asked).collect()) == sorted(again.search(asked).collect())
    assert again.settings.stop_words == tuple(three.settings.stop_words)
    with pytest.raises(Exception):
        RT.ConversationIndex.load(spark, str(tmp_path / "nothing"))


# --- brute force in plain Python ---

def words_of(text):
    kept = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOPS]
    return Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])


def brute_force(docs, asked, settings, top_k, threshold, exclude_self=False):
    counted = {key: words_of(text) for key, text in docs.items()}
    df = Counter(t for c in counted.values() for t in c)
    cf = sum(counted.values(), Counter())
    kept = sorted((t for t in df if df[t] >= settings.min_df), key=lambda t: (-cf[t], t))[: settings.max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}

    def vector(counts):
        raw = {t: (1 + math.log(n) if settings.sublinear_tf else n) * idf[t] for t, n in counts.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    vectors = {key: vector(c) for key, c in counted.items()}
    out = []
    for query_id, text in asked.items():
        v = vector(words_of(text))
        scores = [(-round(sum(x * d.get(t, 0.0) for t, x in v.items()), 9), key) for key, d in vectors.items()
                  if not (exclude_self and key == query_id)]
        scores = [(s, key) for s, key in sorted(scores) if -s >= threshold][:top_k]
        out += [(query_id, rank, key, round(-s, 4)) for rank, (s, key) in enumerate(scores, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary_words = [a + b for a in ("fare", "trip", "app", "card", "bag", "door") for b in ("", "s", "ed", "ing", "er")]

    def text():
        # "the common" is in a third of all texts, and some texts are copies
        common = "common " if rng.random() < 0.34 else ""
        return common + " ".join(rng.choice(vocabulary_words) for _ in range(rng.randint(3, 9)))

    docs = {f"d{i:03d}": (text(), text()) for i in range(90)}
    for i in range(60, 90):
        docs[f"d{i:03d}"] = docs["d000"]
    asked = {f"d{i:03d}": text() for i in range(40)}
    return docs, asked


@pytest.mark.parametrize("kind", ["near", "groups", "no self", "small vocabulary", "raw counts"])
def test_search_equals_brute_force(spark, corpus, kind):
    docs, asked = corpus
    settings = TfidfSettings(stop_words=STOPS, **{
        "small vocabulary": {"max_features": 40, "min_df": 2}, "raw counts": {"sublinear_tf": False}
    }.get(kind, {}))
    options = {"groups": {"group_queries": 7}, "no self": {"exclude_self": True}}.get(kind, {})
    index = RT.ConversationIndex.fit(conversations(spark, [(k, m, r) for k, (m, r) in docs.items()]), settings)
    hits = index.search(queries(spark, *asked.items()), top_k=4, threshold=0.15, **options)
    got = sorted((r["query_id"], r["rank"], r["conversation_id"], r["similarity_score"]) for r in hits.collect())
    texts = {k: f"{m} {r}" for k, (m, r) in docs.items()}
    expected = brute_force(texts, asked, settings, 4, 0.15, exclude_self=kind == "no self")
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all(abs(g[3] - e[3]) < 1e-3 for g, e in zip(got, expected)) and len(got) > 60


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_search_does_not_depend_on_partitioning(spark, corpus, with_partitions, partitions):
    docs, asked = corpus
    with_partitions(partitions)
    settings = TfidfSettings(stop_words=STOPS)
    rows = conversations(spark, [(k, m, r) for k, (m, r) in docs.items()]).repartition(partitions)
    hits = RT.ConversationIndex.fit(rows, settings).search(queries(spark, *asked.items()), top_k=4).collect()
    texts = {k: f"{m} {r}" for k, (m, r) in docs.items()}
    assert sorted((r["query_id"], r["rank"], r["conversation_id"]) for r in hits) == [e[:3] for e in brute_force(texts, asked, settings, 4, 0.15)]


def test_saved_blocks_are_read_in_place(spark, corpus, tmp_path):
    """The search of a saved index shuffles its queries, not its blocks, and is one join for all of them."""
    docs, asked = corpus
    RT.ConversationIndex.fit(conversations(spark, [(k, m, r) for k, (m, r) in docs.items()]), TfidfSettings(stop_words=STOPS)).save(str(tmp_path))
    index = RT.ConversationIndex.load(spark, str(tmp_path))
    vectors = spark.createDataFrame([("q", 1, 0.6), ("q", 2, 0.8)], "query_id string, term_id int, weight double")
    hits = best_hits(index.blocks, index.places, vectors, index.parts, 3, 0.15)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert "Exchange" not in plan[plan.rindex("ExistingRDD"): plan.index("carewise_blocks")]


def test_append_equals_a_fresh_fit(spark, corpus, tmp_path):
    docs, asked = corpus
    rows = [(k, m, r) for k, (m, r) in docs.items()]
    settings = TfidfSettings(stop_words=STOPS, max_features=60)
    RT.ConversationIndex.fit(conversations(spark, rows[:50]), settings).save(str(tmp_path / "first"))
    # A row that is there already is left out, a second one with its key too.
    more = RT.ConversationIndex.load(spark, str(tmp_path / "first")).append(conversations(spark, [*rows[45:], rows[60]]))
    more.save(str(tmp_path / "second"))
    grown, fresh = RT.ConversationIndex.load(spark, str(tmp_path / "second")), RT.ConversationIndex.fit(conversations(spark, rows), settings)

    def content(index):
        postings = index.postings.join(index.vocab, "term_id").select("doc_id", "term", "df", "cf", "n_docs", F.round("weight", 9).alias("weight"))
        return sorted(map(tuple, postings.collect()))

    assert content(grown) == content(fresh) and grown.corpus.count() == len(rows)
    assert sorted(grown.search(queries(spark, *asked.items())).collect()) == sorted(fresh.search(queries(spark, *asked.items())).collect())


def part_of(vectors):
    """A part with the blocks of a matrix."""
    lists = [(t, np.flatnonzero(vectors[:, t]), vectors[:, t]) for t in range(vectors.shape[1]) if vectors[:, t].any()]
    return topk.Part(pa.table({
        "term_id": [t for t, _, _ in lists], "documents": pa.array([d for _, d, _ in lists], pa.list_(pa.int32())),
        "weights": pa.array([v[d] for _, d, v in lists], pa.list_(pa.float64())), "most": [v.max() for _, _, v in lists]}))


@pytest.mark.parametrize(("top_k", "threshold"), [(1, 0.6), (3, 0.15), (3, 0.4), (5, 1e-6), (200, 0.3)])
def test_bounds_skip_products_and_lose_nothing(top_k, threshold):
    """A skewed vocabulary: frequent terms weigh little, as in text."""
    rng = np.random.default_rng(top_k)
    often = 1 / np.arange(1, 301) ** 0.7

    def vectors(n, density):
        x = (rng.random((n, 300)) < density * often * 5) * rng.uniform(0.5, 1.5, (n, 300)) / np.sqrt(often)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    documents, asked = vectors(500, 0.5), vectors(600, 0.15)
    documents[100:150] = documents[7]
    asked[5] = documents[7]
    own = np.where(rng.random(600) < 0.3, rng.integers(0, 500, 600), -1)
    terms = [np.flatnonzero(x) for x in asked]
    rows = pa.table({"terms": pa.array(terms, pa.list_(pa.int32())), "weights": pa.array([x[t] for x, t in zip(asked, terms)], pa.list_(pa.float64()))})
    q, d, s, products = topk.best_of_part(part_of(documents), rows, own, top_k, threshold)
    scores = np.floor(asked @ documents.T * 1e9 + 0.5) / 1e9
    scores[own >= 0, own[own >= 0]] = -1
    expected = []
    for i in range(600):
        best = np.lexsort((np.arange(500), -scores[i]))[:top_k]
        expected += [(i, int(j)) for j in best if scores[i, j] >= threshold]
    assert list(zip(q.tolist(), d.tolist())) == expected and np.allclose(s, scores[q, d], atol=2e-9)
    everything = int(((asked > 0).sum(0) * (documents > 0).sum(0)).sum())
    assert products < everything * (0.9 if threshold > 0.1 else 1.01)


@pytest.mark.parametrize("cells", [0, 40 * 70, 10**6])
def test_slabs_and_short_blocks_lose_nothing(monkeypatch, cells):
    """A part of several slabs, whose blocks are rows of a table or lists; tied copies lie in different slabs."""
    monkeypatch.setattr(topk, "SLAB", 70)
    monkeypatch.setattr(topk, "DENSE_CELLS", cells)
    monkeypatch.setattr(topk, "ADDED_TERMS", 4)
    rng = np.random.default_rng(cells)
    x = (rng.random((500, 90)) < 0.2) * rng.uniform(0.1, 1.0, (500, 90))
    x[::9] = x[3]
    x[20], x = 0.0, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    own = np.where(rng.random(500) < 0.5, np.arange(500), -1)
    terms = [np.flatnonzero(v) for v in x]
    rows = pa.table({"terms": pa.array(terms, pa.list_(pa.int32())), "weights": pa.array([v[t] for v, t in zip(x, terms)], pa.list_(pa.float64()))})
    q, d, s, _ = topk.best_of_part(part_of(x), rows, own, 3, 0.2)
    scores = np.floor(x @ x.T * 1e9 + 0.5) / 1e9
    scores[own >= 0, own[own >= 0]] = -1
    ranked = [(i, int(j)) for i in range(500) for j in np.lexsort((np.arange(500), -scores[i]))[:3] if scores[i, j] >= 0.2]
    assert list(zip(q.tolist(), d.tolist())) == ranked and len(ranked) > 1400


def test_queries_travel_in_bundles(spark, corpus, monkeypatch):
    """The rows that go to the parts are bundles, and the parts of an index don't grow with the number of tasks."""
    docs, asked = corpus
    assert topk.part_count(540_000, 42_000_000, 600) == topk.part_count(90_000, 7_000_000, 100) == topk.LEAST_PARTS
    assert topk.part_count(10, 10**8, 4) == 25 and topk.part_count(0, 0, 200) >= 1
    monkeypatch.setattr(topk, "BUNDLE_QUERIES", 3)
    monkeypatch.setattr(topk, "GROUP_TERMS", 50)
    index = RT.ConversationIndex.fit(conversations(spark, [(k, m, r) for k, (m, r) in docs.items()]), TfidfSettings(stop_words=STOPS))
    hits = index.search(queries(spark, *asked.items()), top_k=4, exclude_self=True).collect()
    texts = {k: f"{m} {r}" for k, (m, r) in docs.items()}
    expected = brute_force(texts, asked, TfidfSettings(stop_words=STOPS), 4, 0.15, exclude_self=True)
    assert sorted((r["query_id"], r["rank"], r["conversation_id"]) for r in hits) == [e[:3] for e in expected]


def test_threshold_counts_the_rounded_score(spark, corpus):
    docs, asked = corpus
    index = RT.ConversationIndex.fit(conversations(spark, [("a", "fare", "trip"), ("b", "card", "bag")]), TfidfSettings(high=1, stop_words=()))
    hits = index.search(queries(spark, ("q", "fare trip")), threshold=1.0).collect()
    assert [(r["conversation_id"], r["similarity_score"]) for r in hits] == [("a", 1.0)]


def test_term_statistics(spark):
    docs = spark.createDataFrame([(1, "fare fare trip"), (2, "trip app"), (3, "")], "k int, t string")
    settings = TfidfSettings(high=1, stop_words=(), max_features=2)
    stats = {r["term"]: (r["df"], r["cf"]) for r in term_stats(docs, "t", settings).collect()}
    assert stats == {"fare": (1, 2), "trip": (2, 2), "app": (1, 1)}
    vocab = {r["term"]: r for r in vocabulary(docs, "t", settings).collect()}
    assert sorted(vocab) == ["fare", "trip"] and vocab["trip"]["term_id"] == 1
    assert vocab["fare"]["idf"] == pytest.approx(math.log(4 / 2) + 1) and vocab["fare"]["n_docs"] == 3


def plain_terms(texts, low, high, stops):
    df, cf = Counter(), Counter()
    for text in texts:
        kept = [w for w in re.findall(r"\w\w+", (text or "").lower()) if w not in stops]
        grams = Counter(" ".join(kept[i:i + n]) for n in range(low, high + 1) for i in range(len(kept) - n + 1))
        cf.update(grams)
        df.update(grams.keys())
    return {t: (df[t], cf[t]) for t in cf}


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 3), (1, 4)])
def test_counted_terms(spark, low, high, monkeypatch):
    monkeypatch.setattr(termcount, "HELD_ROWS", 30)
    rng = random.Random(high)
    texts = [" ".join(rng.choices(["fare", "trip", "the", "of", "card", "bag", "x", "b\u00e4r"], k=rng.randint(0, 12))) for _ in range(60)] + [None, "", "the of", "fare"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    settings = TfidfSettings(low=low, high=high, stop_words=("the", "of"), strip_accents=False)
    got = {r["term"]: (r["df"], r["cf"]) for r in term_stats(docs, "t", settings).collect()}
    assert got == plain_terms(texts, low, high, ("the", "of"))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    """No more words than the bound are counted at once, but for a document that is longer alone."""
    seen, count = [], termcount.count_terms
    monkeypatch.setattr(termcount, "COUNTED_WORDS", 10)
    monkeypatch.setattr(termcount, "count_terms", lambda words, *rest: seen.append(words) or count(words, *rest))
    rng = random.Random(3)
    texts = [rng.choices(["fare", "trip", "the", "card"], k=rng.choice([0, 3, 5, 25])) for _ in range(50)] + [None]
    batches = [pa.record_batch({"words": pa.array(part, pa.list_(pa.string()))}) for part in (texts[:30], texts[30:])]
    tables = [pa.Table.from_batches([b]) for b in termcount.counter(1, 2, ("the",), None)(iter(batches))]
    got = {r["term"]: (r["df"], r["cf"]) for r in pa.concat_tables(tables).to_pylist()}
    assert got == plain_terms([" ".join(t or ()) for t in texts], 1, 2, ("the",))
    assert len(seen) > 20 and all(len(w) == 1 or len(w.flatten()) <= 10 for w in seen)


@pytest.mark.parametrize(("words", "capacity", "certified"), [(30, 500, True), (3000, 60, True), (3000, 4, False)])
def test_summaries_miss_no_frequent_term(spark, monkeypatch, words, capacity, certified):
    """Rare terms in great number: the summaries drop them, and the frequent ones are still exact."""
    monkeypatch.setattr(termcount, "HELD_ROWS", 300)
    rng = random.Random(words)
    often = [f"often{i}" for i in range(20)]
    texts = [" ".join(rng.choices(often, weights=range(1, 21), k=12) + [f"rare{rng.randrange(words)}" for _ in range(6 if certified else 60)]) for _ in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
        settings = TfidfSettings(high=1, stop_words=(), max_features=10, min_df=2)
        found = frequent_terms(docs, "t", settings, capacity)
        exact = vocabulary_of(term_stats(docs, "t", settings), F.lit(len(texts)), settings)
        own = vocabulary_of(found.stats, F.lit(len(texts)), settings)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, exact.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.certified == certified and (found.error > 0) == (words == 3000)
    if found.error and certified:
        assert 10 <= found.candidates < 200 and found.least > found.error
