"""The operators as queries over the given tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carewise.llm import language_id, piece_lattice
from carewise.llm.collocations import collocations
from carewise.llm.common import read
from carewise.llm.conversation_repair import repair_digest
from carewise.llm.edit_embedding import fingerprint_classes
from carewise.llm.exact_dedup import exact_duplicates
from carewise.llm.lattice_dedup import near_vectors
from carewise.llm.line_dedup import LineIndex
from carewise.llm.ngram_join import similar_components
from carewise.llm.packing import pack_documents
from carewise.llm.quality import page_sites, quality
from carewise.llm.secrets_crf import find_secrets, learn
from carewise.llm.url_filter import Rule, hosts_with_words, judge

# The share of documents that makes a line boilerplate is given as a number of documents.
LINE_LIMIT = 10


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex.build(docs, LINE_LIMIT)
    return index.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


STRIPPED = r"[\x20\x09-\x0D]+"
LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, {LOWERED.format(f"regexp_replace(regexp_replace(line, '^{STRIPPED}', ''), '{STRIPPED}$', '')")} AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {LINE_LIMIT}
), marked AS (
  SELECT doc_id, pos, line, f.key IS NOT NULL AS gone FROM keyed LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# The fold that language identification does not learn from.
HELD_OUT = 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.learn(docs.filter(language_id.fold(F.col("doc_id")) != HELD_OUT))
    found = language_id.identify(docs, filters)
    return found.select("doc_id", (language_id.fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")


# A document is kept when it is at least this likely to be good.
GOOD = 0.5


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality(docs, read(spark, sf_dir, "labels"), page_sites(read(spark, sf_dir, "pages")))
    return rated.drop("text_key").withColumn("kept", F.col("p_good") >= GOOD)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, learn(docs)).select("doc_id", "secrets")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = piece_lattice.encode(docs, columns=("ids", "scores", "other_ids", "decoded"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.concat_ws(",", F.transform("scores", lambda s: s.cast("string"))).alias("scores"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.to_json("other_ids"), 256).alias("other_ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), piece_lattice.MARK, " ")).alias("round_trip"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


URL_RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, URL_RULES, hosts_with_words(pages, BLOCKED_WORDS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}
), parsed AS (
  SELECT page_id, {LOWERED.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), fitting AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict FROM parsed p
  LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(BLOCKED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting
"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3])) FROM words WHERE len(w) > 2
), counted AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10
), halves AS MATERIALIZED (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM candidates
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE k = 3
), cuts AS (
  SELECT h.lang, h.phrase, a, cut, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score
  FROM halves h JOIN counted l ON l.lang = h.lang AND l.phrase = h.head JOIN counted r ON r.lang = h.lang AND r.phrase = h.rest
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covered AS (
  SELECT lang, phrase, max(around) AS around FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS around FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored JOIN totals USING (lang) LEFT JOIN covered USING (lang, phrase)
WHERE around IS NULL OR 100 * around < 50 * a
QUALIFY rank <= 2000
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(read(spark, sf_dir, "conversations"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP13_SQL = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
), reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scans": op7_secret_scans,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_url_filters": OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op13_embedding_near_dedup": OP13_SQL,
}
