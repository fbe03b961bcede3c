"""The registered queries: the same rows as their SQL counterparts, and the promised columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from carewise.llm import queries

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op2_document_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
                                  "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_quality_classifier": {"doc_id": "bigint", "kept": "boolean"},
    "op7_secret_scans": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_sentencepiece": {"doc_id": "bigint", "n_pieces": "bigint", "round_trip": "boolean"},
    "op10_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                              "sequence_id": "bigint", "offset": "bigint"},
    "op12_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
                                 "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
}


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = [tuple(None if v != v else v for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, engine, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(engine.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_promised_columns(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name].items() <= dict(found.dtypes).items()
    if name == "op8_sentencepiece":
        assert found.filter("not round_trip").count() == 0
    if name == "op10_best_fit_packing":
        bins = found.select("sequence_id").distinct().count()
        assert bins <= 1 + -(-found.agg({"length": "sum"}).first()[0] // 2048)
    elif name == "op12_conversation_repair":
        assert found.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    else:
        assert found.count() == 1000


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_secret_digests(spark):
    """The digest columns restate the spans of the patterns."""
    import hashlib

    from carewise.llm.secrets_crf import KINDS, base_spans

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_secret_scans(spark, sf).collect():
        spans = base_spans(texts[r["doc_id"]] or "")
        joined = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("crf")] == joined
