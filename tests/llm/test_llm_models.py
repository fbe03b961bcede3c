"""Fingerprints, URL filters, languages, quality, secrets, pieces, packing and the pipeline."""

import bisect
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carewise.llm import edit_embedding as E
from carewise.llm import language_id as L
from carewise.llm import packing as P
from carewise.llm import piece_lattice as S
from carewise.llm import quality as Q
from carewise.llm import secrets_crf as C
from carewise.llm import url_filter as U

SF = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, fingerprint string, secrets string, ids string"


def rows_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y", "z") for i, t in enumerate(texts)], ROWS)


def prose(seed, n, words=300, size=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioubcdfglmnprst", k=rng.randint(2, 9))) for _ in range(words)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(5, size))) for _ in range(n)]


# ------------------------------------------------------------ fingerprints

def test_edits_as_by_hand(spark, with_partitions):
    texts = [None, "", "a", "ab", *prose(1, 40), "é" * 5000, "same", "same"]
    for partitions in (1, 5):
        with_partitions(partitions)
        rows = {r["doc_id"]: r for r in E.fingerprint_edits(rows_of(spark, texts, 3).repartition(4)).collect()}
        plain = [t or "" for t in texts]
        assert sorted(rows) == list(range(3, 3 + len(texts)))
        for i, t in enumerate(plain):
            r, following = rows[3 + i], plain[(i + 1) % len(plain)]
            changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if changed == t:
                assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
        assert rows[3 + len(texts) - 2]["fingerprint"] == rows[3 + len(texts) - 1]["fingerprint"]
    long = [r for r in rows.values() if r["n_chars"] > 300 and r["n_chars"] < 4000]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in long])


def test_edits_of_few_rows(spark):
    one = E.fingerprint_edits(rows_of(spark, ["alone"])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"aloal").hexdigest() and one[0]["near_next"] == 1
    assert E.fingerprint_edits(rows_of(spark, ["x"]).limit(0)).count() == 0
    tied = spark.createDataFrame([(None, "n"), (None, "m"), (5, "b"), (5, "a")], "doc_id long, text string")
    assert E.fingerprint_edits(tied).count() == 4


def test_likeness_falls_with_edits():
    rng, bits = random.Random(2), E.walk_bits(1)
    text = " ".join(prose(3, 12))
    near = []
    for edits in (0, 3, 30, 300):
        own = list(text)
        for _ in range(edits):
            at = rng.randrange(len(own))
            own[at:at + 1] = rng.choice([[], ["x"], [own[at], "y"]])
        near.append(E.likeness(*E.fingerprints([text, "".join(own)], bits)))
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.85 and near[3] < 0.5


def test_walks_are_those_of_a_plain_loop():
    bits = E.walk_bits(4)
    for text in ["a", "hello world", *prose(5, 3), "x" * 3000]:
        symbols, place, step, digits = E.symbols(text), 0, 0, []
        level = E.level_of(len(text))
        levels = E.step_levels(0, 4 * len(text) + 64)
        while place < len(symbols):
            if levels[step] >= level:
                digits.append(E.HEX[symbols[place] & 15])
            place += bits[step % E.PERIOD, symbols[place]]
            step += 1
        assert E.fingerprints([text], bits)[0] == f"{level}:" + "".join(digits)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next_row(row, i, x, b)
        assert E.edit_distance(a, b) == row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_near_duplicates_are_found(spark):
    texts = prose(7, 30, size=200)
    near = [t[:50] + "zz" + t[53:] for t in texts[:10]]
    groups = dict(map(tuple, E.near_duplicates(rows_of(spark, texts + near)).collect()))
    assert all(groups[30 + i] == groups[i] for i in range(10) if len(texts[i]) > 300)
    assert len({groups[i] for i in range(30)}) == 30


def with_edits(text, part, rng):
    """The text with changes of single characters spread over it."""
    own = list(text)
    for at in rng.sample(range(len(own)), int(part * len(own))):
        own[at] = rng.choice([own[at] + "x", "", "q"])
    return "".join(own)


def links_by_hand(texts, most_edits=0.1):
    """The smallest index among the texts that links over shared bands lead to."""
    prints = [set(E.bands(f) or [f]) for f in E.fingerprints(texts, E.walk_bits(E.SEED))]
    least = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if prints[i] & prints[j] and E.edit_distance(texts[i], texts[j]) <= most_edits * max(len(texts[i]), len(texts[j])):
            low, high = sorted((least[i], least[j]))
            least = [low if x == high else x for x in least]
    return least


def test_near_duplicates_as_by_hand(spark):
    """Edits spread over the text, and families of texts behind one common start, whose bands they share."""
    rng = random.Random(12)
    spread = [t for t in prose(8, 12, size=200) if len(t) > 300]
    texts = spread + [with_edits(t, part, rng) for t in spread for part in (0.01, 0.03, 0.05)]
    start = " ".join(prose(9, 2, size=60))[:120]
    families = [start + t[:400] for t in prose(10, 12, size=200) if len(t) > 400]
    texts += families + [with_edits(t, 0.02, rng) for t in families for _ in range(3)] + [texts[3], "", ""]
    expected = links_by_hand(texts)
    got = dict(map(tuple, E.near_duplicates(rows_of(spark, texts)).collect()))
    assert [got[i] for i in range(len(texts))] == expected
    classes = {r["doc_id"]: r["class_id"] for r in E.fingerprint_classes(rows_of(spark, texts)).collect()}
    assert classes == got
    assert sum(expected[len(spread) + i] < len(spread) for i in range(3 * len(spread))) > 2 * len(spread)


def test_classes_of_repeated_and_null_ids(spark):
    text, other = prose(11, 2, size=200)
    rows = [(None, text), (4, text[:-2]), (4, other), (7, other + "z"), (9, "alone"), (9, "alone")]
    got = E.fingerprint_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["class_id"]) for r in got), key=repr) == sorted(
        [(None, len(text), None), (4, len(text) - 2, None), (4, len(other), 4), (7, len(other) + 1, 4), (9, 5, 9), (9, 5, 9)], key=repr)


def test_bounds_of_the_distance():
    rng = random.Random(13)
    for _ in range(60):
        a = "".join(rng.choices("abc ", k=rng.randint(0, 60)))
        b = with_edits(a, rng.random(), rng) if rng.random() < 0.7 else "".join(rng.choices("abc ", k=rng.randint(0, 60)))
        exact = E.edit_distance(a, b)
        assert E.least_distance(a, b) <= exact and E.distance_within(a, b, 99) == (exact, True)


def test_distance_in_a_band():
    rng = random.Random(21)
    for _ in range(400):
        a = "".join(rng.choices("abc ", k=rng.randint(0, 300)))
        b = with_edits(a, rng.random() / 4, rng) if rng.random() < 0.8 else "".join(rng.choices("abc ", k=rng.randint(0, 300)))
        exact, most = E.edit_distance(a, b), rng.randint(0, 60)
        assert E.banded_distance(a, b, most) == min(exact, most + 1)
        distance, known = E.distance_within(a, b, most)
        assert distance == exact if known else most < distance <= exact


def test_profiles_lose_no_link():
    rng = random.Random(22)
    texts = ["".join(rng.choices("ab c", k=rng.choice([0, 2, 30, 31, 32, 33, 500, 3000]))) for _ in range(30)] + ["a" * 700, "a" * 650]
    texts += [with_edits(t, 0.05, rng) for t in texts]
    opened = [E._opened(E.gram_profile(t)) for t in texts]
    for text, own in zip(texts, opened):
        shared = E._shared_most(own, opened)
        for other, most in zip(texts, shared.tolist()):
            assert E._bound(max(len(text), len(other)), abs(len(text) - len(other)), most) <= E.edit_distance(text, other)


def test_pairs_of_a_band_are_few():
    import pyarrow as pa

    rng = random.Random(23)
    texts = ["".join(rng.choices("abcdefghijkl mnopq", k=1000)) for _ in range(60)]
    texts += [with_edits(t, 0.04, rng) for t in texts[:3]]
    texts.sort(key=len)
    n = len(texts)
    columns = {
        "band": [7] * n, "node": list(range(n)), "component": list(range(n)), "size": list(map(len, texts)), "least": [0] * n, "most": [1 << 40] * n,
        "profile": list(map(E.gram_profile, texts)),
    }
    found = {p for b in E._open_pairs(iter([pa.RecordBatch.from_pydict(columns)]), 0.1) for p in zip(*(b.column(c).to_pylist() for c in "ab"))}
    near = {(i, j) for i, j in itertools.combinations(range(n), 2) if E.edit_distance(texts[i], texts[j]) <= 0.1 * max(len(texts[i]), len(texts[j]))}
    assert len(near) == 3 and near <= found and len(found) < 6


def test_profiles_go_only_where_a_partner_is_near():
    """Entries of a band that are near to none by size and distance to the head get no profile, and no pair is lost."""
    import pyarrow as pa

    rng = random.Random(29)
    texts = ["".join(rng.choices("abc de", k=rng.choice([50, 53, 80, 200, 203, 400]))) for _ in range(40)]
    texts += [with_edits(t, 0.04, rng) for t in texts[:12]] + ["x" * 30, "x" * 900]
    rows = sorted((i % 40 % 3 if i < 52 else 4, len(t), i, t) for i, t in enumerate(texts))
    numbers = [i for _, _, i, _ in rows]
    columns = {"band": [b for b, *_ in rows], "node": numbers, "component": [i % 7 for i in numbers], "size": [n for _, n, *_ in rows],
               "least": [10 * (i % 3) for i in numbers], "most": [10 * (i % 3) if i % 2 else 1 << 40 for i in numbers]}
    profiles = {i: E.gram_profile(t) for _, _, i, t in rows}

    def met(batch):
        with_profile = batch.append_column("profile", pa.array([profiles[i] for i in batch.column("node").to_pylist()]))
        return sorted(p for b in E._open_pairs(iter([with_profile.slice(0, 9), with_profile.slice(9)]), 0.1) for p in zip(*(b.column(c).to_pylist() for c in "ab")))

    whole = pa.RecordBatch.from_pydict(columns)
    kept = pa.Table.from_batches(list(E._with_partners(iter([whole.slice(0, 7), whole.slice(7)]), 0.1))).combine_chunks().to_batches()[0]
    assert kept.schema.names == ["band", *E.ENTRY] and 0 < kept.num_rows < len(texts) - 1
    assert met(kept) == met(whole) and met(whole)


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    from carewise.session import FREE_SHUFFLES, stored

    before = spark.conf.get(FREE_SHUFFLES)
    kept = stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts", str(tmp_path))
    assert kept.count() == 7 and spark.conf.get(FREE_SHUFFLES) == before


# ------------------------------------------------------------ URLs

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q", "https://example.org/en/1", "https://example.org/en/12#f", "https://example.org/en/2",
    "http://org/", "http://x.org", "http://x.com/fr/", "http://fakecom/fr/", "http://com/de/9", "http://a.b.c.com/de/?x", "ftp://casino-win.net/q",
    "http://adult.io", "http://notadulted.io/x", "http://q.com/fr/://y.org/es/", "http://h:80/p\nq?r", "http://q.net/" + "p" * 3000,
]
RULES = [U.Rule("org", "/", "allow"), U.Rule("example.org", "/es/", "block"), U.Rule("example.org", "/en/1", "block"),
         U.Rule("com", "/fr/", "allow"), U.Rule("com", "/de/", "block")]


def judged_by_hand(url):
    rest = (url or "").partition("://")
    cut = min([rest[2].find(c) for c in "/?#" if c in rest[2]] or [len(rest[2])])
    host = "".join(c.lower() if c.isascii() else c for c in rest[2][:cut])
    path = rest[2][cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fitting = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.key), default=None)
    blocked = any(part in ("adult", "casino") for label in host.split(".") for part in label.split("-"))
    return host, path, best and best.key, best.verdict if best else "block" if blocked else "allow"


@pytest.mark.parametrize("limit", [U.FILTER_BYTES, 0])
def test_urls_as_by_hand(spark, limit):
    """With filters, and with the join that stands in for filters that would be too large."""
    pages = spark.createDataFrame([(i, u, "kept", "gone") for i, u in enumerate(URLS)], "page_id long, url string, extra string, host string")
    got = U.judge(pages, RULES, U.hosts_with_words(pages, ["adult", "casino"]), limit)
    assert set(got.columns) == {"page_id", "url", "extra", "host", "path", "rule", "verdict"}
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert rows == {i: judged_by_hand(u) for i, u in enumerate(URLS)}
    assert U.judge(pages.limit(0), RULES, U.hosts_with_words(pages.limit(0), ["adult"]), limit).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(6000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    listed = keys.filter(F.xxhash64("key") % 7 == 0)
    found = U.cascade(listed, keys.filter(F.xxhash64("key") % 7 != 0))
    assert len(found.levels) > 1
    assert keys.filter(found.has(F.col("key")) != (F.xxhash64("key") % 7 == 0)).count() == 0


# ------------------------------------------------------------ languages

def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = L.fold(F.col("doc_id")) == 2
    found = L.identify(docs, L.learn(docs.filter(~held)))
    right = found.join(docs.filter(held), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_cases(spark):
    train = spark.createDataFrame([("abc abd abe" * 20, "x"), ("xyz xyw xyv" * 20, "y"), ("lost", None), (None, "z")], "text string, lang string")
    filters = L.learn(train)
    assert set(filters.languages) == {"x", "y"}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(rows_of(spark, [None, "", "12 -", "ABC", "xyz", "qqq", "abd " * 9000]), filters).collect()}
    assert [got[i][0] for i in range(5)] == ["und", "und", "und", "x", "y"] and got[6][0] == "x"
    assert got[0][1] == 0 and all(0 <= s <= 1 for _, s in got.values()) and got[5][0] in ("x", "y")
    none = L.learn(train.limit(0))
    assert L.identify(rows_of(spark, ["abc"]), none).first()["lang_pred"] == "und"
    assert zlib.crc32(b"17") % 4 == spark.range(1).select(L.fold(F.lit(17))).first()[0]


def test_more_languages_than_a_word_of_masks(spark):
    rows = [("".join(chr(0x4E00 + 50 * i + k) for k in range(40)) * 3, f"l{i:02d}") for i in range(70)]
    filters = L.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.table.shape[1] == 2
    assert [name for name, _ in filters.identify([t for t, _ in rows])] == [name for _, name in rows]


def test_copies_do_not_crowd_out_a_language(spark):
    texts = [(t, "x" if i % 2 else "y") for i, t in enumerate(prose(14, 60))]
    once, often = (spark.createDataFrame(texts + [("abc abd xyz " * 30, "x")] * n, "text string, lang string") for n in (1, 300))
    expected, got = (L.learn(d, documents=70) for d in (once, often))
    assert got.languages == expected.languages and np.array_equal(got.table, expected.table)


# ------------------------------------------------------------ quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels, pages = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "pages"))
    train = labels.filter(F.col("doc_id") % 3 != 0)
    rated = Q.quality(docs, train, Q.page_sites(pages))
    test = rated.join(labels.filter(F.col("doc_id") % 3 == 0), "doc_id").select((F.col("p_good") >= 0.5).cast("int").alias("kept"), "quality").collect()
    assert np.mean([r["kept"] == r["quality"] for r in test]) > 0.95


def test_sites_pull_by_their_number(spark):
    """With even texts, a site with many bad documents pulls a document down more than one with a few."""
    counts = [("many", 60, 6), ("few", 4, 1), ("good", 60, 54)]
    groups = spark.createDataFrame([(n * 1.0, g * 1.0, g * 1.0) for _, n, g in counts], "n double, s double, q double")
    strength = Q.prior_strength(groups, F.lit(0.5))
    assert 1 <= strength < 20
    rate = {name: (g + strength * 0.5) / (n + strength) for name, n, g in counts}
    assert rate["many"] < rate["few"] < 0.5 < rate["good"]
    alike = spark.createDataFrame([(50.0, 25.0, 25.0), (50.0, 25.0, 25.0)], "n double, s double, q double")
    assert Q.prior_strength(alike, F.lit(0.5)) == 1e6


def test_quality_cases(spark):
    docs = rows_of(spark, [None, "", "fine words here", "fine words here", "x " * 50_000])
    sites = spark.createDataFrame([(2, "h", "/a/"), (2, "h", "/b/"), (3, None, None)], "doc_id long, host string, path string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.quality(docs, none, sites).collect()
    assert len(rows) == 5 and all(r["p_text"] == 0.5 for r in rows) and {r["path"] for r in rows} == {None, "/a/"}
    assert Q.quality(docs.limit(0), none, sites).count() == 0


# ------------------------------------------------------------ secrets

SECRETS = [
    None, "", "password = hunter2", "PassWord : 'abcdefghijkl' x", "api_key=abc.def/ghi+123 token=token=abcdefghijkl", "secret: token = abcdefghijklmnop",
    "AKIAABCDEFGHIJKLMN and AKIASHORT", "0123456789abcdef0 deadbeef", "é password=éabcdefghijklm", "ſecret=abcdefghijklmnop", "x" * 200_000 + " token=" + "a" * 40,
    "a1b2c3d4e5f6a7b8\ntoken:\"0123456789abcdef0123\"",
]


def bases_by_hand(text):
    """Kind, start and end, tried from every place by plain comparison."""
    out, letters = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(c.lower() if c.isascii() else c for c in text)
    at = 0
    while at < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(k, at)), None)
        end = at + len(key) if key else at
        if key:
            end += text[end:end + 1] in ("'", '"') and text[end:end + 1] != ""
            while text[end:end + 1] == " ":
                end += 1
            if text[end:end + 1] in (":", "="):
                end += 1
                while text[end:end + 1] == " ":
                    end += 1
                end += text[end:end + 1] in ("'", '"') and text[end:end + 1] != ""
                value = end
                while text[end:end + 1] in letters and end < len(text):
                    end += 1
                if end > value:
                    if end - value >= 12:
                        out.append((at, 0, end))
                    at = end
                    continue
        at += 1
    for kind, start, allowed, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            end = at + len(start)
            if text.startswith(start, at) and text[end:end + 1] in allowed and end < len(text):
                while end < len(text) and text[end] in allowed:
                    end += 1
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_patterns_as_by_hand():
    rng = random.Random(8)
    made = ["".join(rng.choices(["token", "=", " ", ":", "'", "abc123def456", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "x", "é"], k=12)) for _ in range(200)]
    for text in [t for t in SECRETS if t] + made:
        if len(text) < 1000:
            assert C.base_spans(text) == bases_by_hand(text), text


@pytest.fixture(scope="module")
def field(spark):
    return C.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), windows=800)


def test_field_finds_more_and_keeps_the_base(spark, field):
    texts = [*SECRETS, "my api key: ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4 is here", "call 555-123-4567 on 2024-01-02, room 12", "plain words only"]
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in C.find_secrets(rows_of(spark, texts), field).collect()}
    for i, t in enumerate(texts):
        assert [s for s in rows[i] if s[0] != "crf"] == [(C.KINDS[k], a, b) for a, k, b in C.base_spans(t or "")]
    assert [s[0] for s in rows[len(SECRETS)]] == ["crf"]
    assert rows[len(SECRETS) + 1] == [] and rows[len(SECRETS) + 2] == []
    assert C.find_secrets(rows_of(spark, ["x"]).limit(0), field).count() == 0


def test_stretches_decode_like_whole_texts(spark, field):
    assert field.cuts
    whole = C.Field(field.weights, field.moves, False)
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        base = C.base_spans(r["text"])
        assert C.added_spans(r["text"], field, base) == C.added_spans(r["text"], whole, base)


def test_copies_do_not_crowd_out_the_sample(spark):
    """Copies of a text without secrets that comes first in the sample."""
    plain = [f"room {i} = 12 : the plain text has no value" for i in range(40)]
    order = F.pmod(F.xxhash64(F.col("text"), F.lit(29)), F.lit(1 << 40))
    first = rows_of(spark, plain).orderBy(order).first()["text"]
    secrets = [f"the token=0123456789abcdef{i:04d} is here" for i in range(30)]
    once, often = (C.learn(rows_of(spark, secrets + [first] * n), windows=80) for n in (1, 200))
    assert often.weights[0, C.OUTSIDE] != 10 and np.array_equal(once.weights, often.weights)


def test_viterbi_and_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))

    def value(tags, last=True):
        total = moves[0, tags[0]] + sum(scores[i, t] for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))
        return total + (moves[tags[-1], 0] if last else 0)

    paths = list(itertools.product(range(3), repeat=5))
    assert C.viterbi(scores, moves) == list(max(paths, key=value))
    weights = np.exp([value(p, False) for p in paths])
    share, pairs = C.marginals(scores[None], moves, np.ones((1, 5), dtype=bool))
    for i, t in itertools.product(range(5), range(3)):
        assert share[0, i, t] == pytest.approx(sum(w for p, w in zip(paths, weights) if p[i] == t) / weights.sum())
    assert pairs.sum() == pytest.approx(5)


def test_redaction(spark, field):
    rows = rows_of(spark, ["a token=0123456789abcdef0123 b", None, "plain"])
    assert [r["text"] for r in C.redact(rows, field).orderBy("doc_id").collect()] == ["a [SECRET] b", None, "plain"]


# ------------------------------------------------------------ pieces

@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(S.default_model(), 4)


def best_by_hand(pieces, text, n):
    marked = S.MARK + text.replace(" ", S.MARK)
    arcs, lists = pieces.arcs(marked), {0: [0.0]}
    for end in range(1, len(marked) + 1):
        lists[end] = sorted((s + gain for start, gain, _ in arcs[end] for s in lists[start]), reverse=True)
    return lists[len(marked)][:n]


@pytest.mark.parametrize("text", ["the cat", "a b", " x  y", "été, q.", "in\nout", "aaaa", "⚠️ a", "3.14", "a▁b", "Then,", "\n\n"])
def test_n_best_as_by_enumeration(pieces, text):
    found = pieces.encode(text)
    assert [s for s, _ in found] == pytest.approx(best_by_hand(pieces, text, 4))
    assert len({ids for _, ids in found}) == len(found)
    for _, ids in found:
        assert pieces.decode(np.frombuffer(ids, dtype="<u4").tolist()) == text.replace(S.MARK, " ")


@pytest.mark.parametrize("best", [1, 3, 5])
def test_parts_side_by_side_as_one_by_one(best, monkeypatch):
    """All short parts of a batch are searched in one go, with the lists of single searches, ties included."""
    pieces = S.Pieces(S.default_model(), best)
    # few different scores, so that many segmentations are equally good
    pieces.normal = {p: (float(len(p) // 2), i) for p, (_, i) in pieces.normal.items()}
    pieces.starts |= pieces.normal
    pieces._grow_tree()
    rng = random.Random(4)
    parts = ["".join(rng.choices("aehinorst\u00e9", k=rng.randint(2, 40))) for _ in range(800)] + ["a", "\U0001f600"]
    alone = [pieces.search(p) for p in parts]
    calls, search = [], S.Pieces.search
    monkeypatch.setattr(S.Pieces, "search", lambda self, part: calls.append(part) or search(self, part))
    assert pieces.search_all(parts) == alone
    assert calls and all(len(p) == 1 or len(p) > S.SHORT_PART for p in calls)
    texts = [" ".join(parts[i:i + 9]) for i in range(0, 90, 9)] + [""]
    del calls[:]
    together = pieces.encode_all(texts)
    assert all(len(p) == 1 or len(p) > S.SHORT_PART for p in calls)
    pieces.forget()
    assert [pieces.encode(t) for t in texts] == together


@pytest.mark.parametrize("best", [1, 2, 3, 5])
def test_words_put_together_at_once(best):
    """The scores of the n best and the ids of the best are those of the lists put together one by one."""
    pieces = S.Pieces(S.default_model(), best)
    rng = random.Random(8)
    letters = "etaoin \n.,3-\u00e9\u4e16\U0001f600" + S.MARK
    batches = [["", *["".join(rng.choices(letters, k=rng.choice([1, 2, 9, 60, 400]))) for _ in range(12)], "x" * 90] for _ in range(3)] + [["", ""], []]
    calls = []
    pieces.search_all = lambda parts, search=pieces.search_all: calls.append(len(parts)) or search(parts)
    for texts in batches:
        sizes, ids, scores = pieces.encode_best(texts)
        assert not calls  # nothing is searched part by part in lists
        alone = pieces.encode_all(texts)
        del calls[:]
        assert scores == [[s for s, _ in found] for found in alone]
        assert ids.tobytes() == b"".join(found[0][1] for found in alone)
        assert sizes.tolist() == [len(found[0][1]) // 4 for found in alone]
        assert pieces.decode_flat(sizes, ids) == pieces.decode_all([found[0][1] for found in alone])


@pytest.mark.parametrize("best", [1, 2, 3, 5])
@pytest.mark.parametrize("tied", [False, True])
def test_all_n_best_are_put_together_at_once(best, tied):
    """The ids of the second best on too are those of the lists put together one by one, ties included."""
    pieces = S.Pieces(S.default_model(), best)
    if tied:
        pieces.normal = {p: (float(len(p) // 2), i) for p, (_, i) in pieces.normal.items()}
        pieces.starts |= pieces.normal
        pieces._grow_tree()
    rng = random.Random(14)
    letters = "etaoin \n.,3-\u00e9\u4e16\U0001f600" + S.MARK
    batches = [["", *["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 9, 60, 400]))) for _ in range(40)], "x" * 90] for _ in range(3)] + [["", ""], []]
    for texts in batches:
        sizes, ids, scores = pieces.encode_lists(texts, best)
        alone = pieces.encode_all(texts)
        assert scores == [[s for s, _ in found] for found in alone]
        assert [[n for n in own if n] for own in sizes.tolist()] == [[len(own) // 4 for _, own in found if own] for found in alone]
        assert ids.tobytes() == b"".join(own for found in alone for _, own in found)


def test_query_gives_every_segmentation(spark, tmp_path):
    """The query's rows hold the n best segmentations, not the best one alone."""
    from carewise.llm import queries

    texts = [None, "", "a", *prose(15, 12), " x\n\u00e9", "\u2581 1", "aaaa aaaa"]
    rows_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = S.Pieces(S.default_model(), S.BEST)
    rows = {r["doc_id"]: r for r in queries.op8_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        best, *others = [np.frombuffer(own, dtype="<u4").tolist() for _, own in pieces.encode(text or "")]
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, best)).encode()).hexdigest()
        assert rows[i]["other_ids_sha256"] == hashlib.sha256(str(others).replace(" ", "").encode()).hexdigest()
    got = {r["doc_id"]: r["other_ids"] for r in S.encode(rows_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [[np.frombuffer(own, dtype="<u4").tolist() for _, own in pieces.encode(t or "")[1:]] for t in texts]


def test_decoded_at_once_as_one_by_one(pieces):
    found = [pieces.encode(t)[0][1] for t in ["", "the cat", " x\n\u00e9", "\U0001f600\ud800", ""]]
    found.append(np.array([pieces.byte_ids[b] for b in S.MARK.encode() * 2], dtype="<u4").tobytes())
    assert pieces.decode_all(found) == [pieces.decode(np.frombuffer(f, dtype="<u4").tolist()) for f in found]
    assert pieces.decode_all([]) == [] and pieces.decode_all([b""]) == [""]


def test_pieces_round_trip(spark):
    texts = [None, "", *prose(9, 20), "é\u0001\ttab  ", "x" * 30_000, "▁"]
    rows = {r["doc_id"]: r for r in S.decode(S.encode(rows_of(spark, texts))).collect()}
    assert [rows[i]["decoded"] for i in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]
    assert rows[0]["ids"] == [] and rows[0]["scores"] == [0.0]
    assert all(list(r["scores"]) == sorted(r["scores"], reverse=True) for r in rows.values())
    assert S.encode(rows_of(spark, ["x"]).limit(0)).count() == 0


# ------------------------------------------------------------ packing

def test_ids_are_those_of_whole_texts(spark):
    from tokenizers import Tokenizer

    texts = [None, "", *prose(10, 30), "<|endoftext|> a", "it's  we'LL  don't", "x\x1cy   z", "İ ΣΑΣ Σ. ß", "á é", "1234 ab12 !!! ... a.b,c", "word " * 5000]
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    rows = P.pack_documents(rows_of(spark, texts), keep_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["length"] == len(r["ids"]) <= 2048
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        got[r["doc_id"]] += r["ids"]
    assert [got[i] for i in range(len(texts))] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_word_table_is_small_and_exact(monkeypatch):
    """Words are kept in arrays, some 40 bytes each; ids stay those of whole texts when the table starts anew."""
    import tracemalloc

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(12)
    letters = "etaoinshrdlu\u00e9\u00dfÀÖ"
    texts = [" ".join("".join(rng.choices(letters, k=9)) + rng.choice(["", ".", ",", "!?", "###"]) for _ in range(500)) for _ in range(120)]
    words = P.Words(P.default_tokenizer())
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    words.encode(texts)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 60_000 * 80
    monkeypatch.setattr(P, "REMEMBERED_BYTES", 2000)
    whole = Tokenizer.from_file(P.default_tokenizer())
    odd = ["", " ", "\n\n a", "J\u030c ab\u0301c. İx ÷a ÿ... ...", "a.b x1. .a a\u00adb <|endoftext|>!", "\x00 a\rb\tc d\u3000e", *texts[:2], *prose(13, 4)]
    for some in (odd, [], odd[::-1], [""]):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(some)] == [whole.encode(t, add_special_tokens=False).ids for t in some]


def check_sequences(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_partitions_exchange_what_fits_badly(spark, monkeypatch):
    """Sizes just above a third leave gaps in every partition unless they meet the small ones."""
    monkeypatch.setattr(P, "PARTITION_SEQUENCES", 20)
    rng = random.Random(11)
    lengths = [rng.randint(30, 70) for _ in range(300)] + [rng.randint(1, 8) for _ in range(200)]
    items = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], P.PIECE_SCHEMA + ", row long")
    rows = P.packed(items, 100).collect()
    assert sorted(r["row"] for r in rows) == list(range(500))
    used = check_sequences(rows, 100)
    bound = P.lower_bound(np.array(lengths), 100)
    assert bound <= used <= best_fit_by_hand(lengths, 100) + 8


def best_fit_by_hand(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


def test_best_fit_and_bounds():
    rng = np.random.default_rng(12)
    for capacity, n in ((10, 9), (10, 40), (100, 200), (2048, 1000)):
        for _ in range(10):
            lengths = rng.integers(1, capacity + 1, n)
            bins, offsets, count = P.best_fit_decreasing(lengths, capacity)
            assert np.bincount(bins, weights=lengths).max() <= capacity
            assert P.lower_bound(lengths, capacity) <= count == best_fit_by_hand(lengths.tolist(), capacity)
    assert P.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_packing_cases(spark):
    rows = P.pack_documents(spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r["length"], r["doc_id"]) for r in rows if r["doc_id"]) == [(1, 1), (1, 1)] and check_sequences(rows, 2048) == 1
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------ pipeline

def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    bad = labels.filter("quality = 0").join(kept, "doc_id", "left_semi").count()
    good = labels.filter("quality = 1")
    assert bad <= 2 and good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    lines = corpus_pipeline.line_dedup(spark, kept, SF)
    assert lines.columns == list(corpus_pipeline.COLUMNS) and lines.count() == kept.count()
    assert lines.filter("n_chars <> char_length(text)").count() == 0
    once = corpus_pipeline.ngram_jaccard_join(spark, lines, SF)
    assert 0 < once.count() < lines.count() and once.filter("text <> ''").groupBy("text").count().filter("count > 1").count() == 0
    clean = corpus_pipeline.secret_scans(spark, once, SF)
    assert clean.count() == once.count() and not any(C.base_spans(r["text"]) for r in clean.select("text").collect())
    packed = corpus_pipeline.best_fit_packing(spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.select("doc_id").collect()}
    check_sequences(packed, 2048)


def test_pipeline_runs_all_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_tables(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 1), (3, "a b c d e f", None, "s", 2), (3, "", "en", None, 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for table in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF)
        assert table.count() >= 0


def test_near_copies_of_repeated_and_null_ids(spark):
    """One row of each group stays, whatever the ids are, and no row of another group goes."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    alone = " ".join(f"u{i}" for i in range(60))
    nulls = [" ".join(f"t{i}" for i in range(60)), " ".join(f"t{i}" for i in range(61))]
    rows = [(1, near), (1, near), (2, near + " end"), (2, alone), (3, other), (3, other), (None, nulls[0]), (None, nulls[0]), (8, nulls[1]), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))))
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs.repartition(3), SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, near), (2, alone), (3, other), (None, nulls[0]), (9, None), (9, None)], key=repr)


# ------------------------------------------------------------ shares, numbers, hosts, white space

def test_shares_of_any_number():
    """A sample is never empty, however many texts there are."""
    for total in (0, 1, 19_999, 20_001, 10**6, 2 * 10**10, 10**14):
        share = L.share_of(20_000, total)
        assert 1 <= share <= L.RANGE and (total <= 20_000) == (share == L.RANGE)
        if 20_000 < total <= 10**10:
            assert share / L.RANGE * total == pytest.approx(20_000, rel=1e-3)


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, text, lang) for i, (text, lang) in enumerate([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")])], "doc_id long, text string, lang string")
    filters = L.learn(docs)
    asked = rows_of(spark, ["\u00bd \u00b2 \u2167 \u0f33", "12 _ 3", "\u00bdthe\u00b2 cat", "\u00aa"])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(asked, filters).collect()}
    assert found[0] == found[1] == ("und", 0.0) and found[2][0] == "en" and found[3][0] in ("en", "de")


def test_letter_runs_in_the_time_of_a_plain_pattern():
    every = "".join(f"a{chr(i)}b" for i in range(0x110000))
    runs = [(k, "".join(g)) for k, g in itertools.groupby(every, str.isalpha)]
    assert L.letter_runs(every) == [r for k, r in runs if k]
    text = " ".join(prose(5, 2_000, words=40)) + " \u00e9"

    def seconds(work):
        taken = []
        for _ in range(3):
            start = time.perf_counter()
            work()
            taken.append(time.perf_counter() - start)
        return min(taken)

    plain = seconds(lambda: re.findall(r"[^\W\d_]+", text))
    assert seconds(lambda: L.letter_runs(text)) < 4 * plain


def test_identification_by_plain_sets(spark):
    """The bit-sliced filters against sets of n-grams, in which nothing is a false positive."""
    rows = [(i, t, lang) for lang, seed in (("aa", 1), ("bb", 2), ("cc", 3)) for i, t in enumerate(prose(seed, 25, words=60))]
    docs = spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    filters = L.learn(docs)
    sizes, counts = {}, {}
    for _, t, lang in rows:
        plain = " " + " ".join(L.WORD.findall(t.lower())) + " "
        for i in range(len(plain) - 2):
            counts[lang, plain[i:i + 3]] = counts.get((lang, plain[i:i + 3]), 0) + 1
            sizes[lang] = sizes.get(lang, 0) + 1
    highest = {}
    for (lang, gram), n in counts.items():
        if n >= L.LEAST_COUNT:
            highest[gram] = max(highest.get(gram, 0), n / sizes[lang])
    sets = {lang: {g for (own, g), n in counts.items() if own == lang and n >= L.LEAST_COUNT and n / sizes[lang] >= L.PART_OF_HIGHEST * highest[g]} for lang in sizes}
    asked = [" ".join(t.split()[:12]) for t in prose(1, 20, words=60) + prose(2, 20, words=60) + prose(9, 20)]
    for text, (lang, score) in zip(asked, filters.identify(asked)):
        plain = " " + " ".join(L.WORD.findall(text.lower())) + " "
        grams = [plain[i:i + 3] for i in range(len(plain) - 2)]
        share = {name: sum(g in sets[name] for g in grams) / len(grams) for name in filters.languages}
        total = sum(share.values())
        if total:
            assert share[lang] == pytest.approx(max(share.values()), abs=0.01) and score == pytest.approx(share[lang] / total, abs=0.02)


def test_hosts_in_either_case_are_one_site(spark):
    pages = spark.createDataFrame([(1, "http://Site.Example/a/7.html"), (2, "http://site.example/a/8")], "page_id long, url string")
    assert {r["host"] for r in Q.page_sites(pages).collect()} == {"site.example"}


def test_posteriors_by_plain_loops(spark):
    """p_site and p_good from sums over the other documents of a path and a host."""
    rng = random.Random(6)
    docs = rows_of(spark, [*prose(4, 60), None, ""])
    labels = spark.createDataFrame([(i, rng.randrange(2)) for i in range(50)], "doc_id long, quality int")
    sites = spark.createDataFrame([(i, f"h{i % 3}", f"/p{i % 7}/") for i in range(55)], "doc_id long, host string, path string")
    got = {r["doc_id"]: r for r in Q.quality(docs, labels, sites).collect()}
    p = {i: r["p_text"] for i, r in got.items()}
    overall = sum(p.values()) / len(p)

    def strength(groups, mean_of):
        n = [len(g) for g in groups.values()]
        rates = {k: sum(p[i] for i in g) / len(g) for k, g in groups.items()}
        noise = sum((p[i] - rates[k]) ** 2 for k, g in groups.items() for i in g) / (sum(n) - len(n))
        between = sum(len(g) * (rates[k] - mean_of(k)) ** 2 for k, g in groups.items())
        excess = (between - (len(n) - 1) * noise) / (sum(n) - sum(x * x for x in n) / sum(n))
        spread = sum(len(g) * mean_of(k) * (1 - mean_of(k)) for k, g in groups.items()) / sum(n)
        return 1e6 if excess <= 0 else min(1e6, max(1.0, spread / excess - 1))

    hosts, paths = {}, {}
    for i in range(55):
        hosts.setdefault(f"h{i % 3}", []).append(i)
        paths.setdefault((f"h{i % 3}", f"/p{i % 7}/"), []).append(i)
    at_hosts = strength(hosts, lambda k: overall)
    rate = {h: (sum(p[i] for i in g) + at_hosts * overall) / (len(g) + at_hosts) for h, g in hosts.items()}
    at_paths = strength(paths, lambda k: rate[k[0]])
    for i, r in got.items():
        site = overall
        if i < 55:
            own_host, own_path = hosts[f"h{i % 3}"], paths[f"h{i % 3}", f"/p{i % 7}/"]
            host = (sum(p[j] for j in own_host if j != i) + at_hosts * overall) / (len(own_host) - 1 + at_hosts)
            site = (sum(p[j] for j in own_path if j != i) + at_paths * host) / (len(own_path) - 1 + at_paths)
        odds = sum(s * np.log(x / (1 - x)) for s, x in ((1, p[i]), (1, site), (-1, overall)))
        assert r["p_site"] == pytest.approx(site) and r["p_good"] == pytest.approx(1 / (1 + np.exp(-odds)))


def test_stretches_reach_across_white_space():
    """Any run of white space parts words, and a stretch has its words on both sides."""
    for gap in (" " * 14, "\n\n \t", "\t" * 9, " \r\n" * 5):
        text = gap.join(["plain"] * 9 + ["password", "Zk3vQ9w1Xy7Lm2"] + ["plain"] * 9)
        (start, end), = C.stretches(text)
        inside = text[start:end].split()
        assert "password" in inside and "Zk3vQ9w1Xy7Lm2" in inside and len(inside) >= 2 + 2 * (C.AROUND - 1)
        assert text[start:end] == text[start:end].strip()
