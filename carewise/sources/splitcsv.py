"""Scan of CSV files by byte ranges, also where quoted texts hold line breaks.

A file is read as lines by as many tasks as its size calls for. A line break belongs to a text where
the number of quotes before it in the file is odd. Quotes are counted per range first; running
sums over the ranges say how each one begins. A second pass puts lines together to records within
its range, and the few that cross a range's end are joined from their parts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carewise.session import broadcast_if_small, stored

QUOTE = '"'
RECORD, REST, OPEN = 0, 1, 2
PARTS = "file long, block long, kind int, record string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range in the order of its lines. What ends a record of the range before is a
    rest, as is a range that lies within one; a record that does not end in its range is open."""
    place, inside, kind = None, False, RECORD
    held: list[str] = []

    def done(out: list[tuple]) -> None:
        # The first record of a file is its header.
        if kind != RECORD or place[1] != 0 or not seen:
            out.append((*place, kind, "\n".join(held)))

    seen: list[bool] = []
    for batch in batches:
        out: list[tuple] = []
        for value, file, block, odd in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "odd"))):
            if place != (file, block):
                if held:
                    kind = REST if kind == REST else OPEN
                    done(out)
                place, inside, held = (file, block), odd, []
                kind = REST if odd else RECORD
                seen = [True] if block == 0 else []
            held.append(value)
            inside ^= value.count(QUOTE) % 2 == 1
            if not inside:
                done(out)
                held, kind, seen = [], RECORD, []
        yield _batch(out)
    if held:
        out, kind = [], REST if kind == REST else OPEN
        done(out)
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "kind", "record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): one row per record of the files under ``path``, without their headers and empty lines."""
    lines = _lines(spark, path)
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit(QUOTE), F.lit("")))
    counted = stored(lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")), "quotes")  # a row per range
    before = F.sum("quotes").over(W.partitionBy("file").orderBy("block")) - F.col("quotes")
    starts = stored(counted.select(F.col("file").alias("in_file"), F.col("block").alias("at"), (before % 2 == 1).alias("odd")), "range-starts")
    sent, small = broadcast_if_small(starts)
    if not small:
        lines = lines.withColumn("line", F.monotonically_increasing_id())
    marked = lines.join(sent, (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("at")))
    if not small:  # a shuffled join loses the order of lines
        marked = marked.repartition("file", "block").sortWithinPartitions("file", "block", "line")
    parts = marked.select("value", "file", "block", "odd").mapInArrow(_records, PARTS)
    parts = stored(parts, "csv-parts")
    whole = parts.filter(F.col("kind") == RECORD).select("record")
    # A record across ranges is an open part and the rests up to the next one: a few rows per range.
    order = W.partitionBy("file").orderBy("block", "kind")
    chained = parts.filter(F.col("kind") != RECORD).withColumn("chain", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    joined = chained.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "record"))).alias("p"))
    return whole.unionByName(joined.select(F.array_join("p.record", "\n").alias("record"))).filter(F.length("record") > 0)


def scan_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The files under ``path``, all with the same header, as a table; by default all columns are text."""
    if schema is None:
        header = spark.read.option("header", True).option("escape", QUOTE).csv(path)
        schema = StructType([header.schema[c] for c in header.columns])
    text = F.regexp_replace("record", "\r\\z", "")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = csv_records(spark, path).select(F.from_csv(text, kinds, {"escape": QUOTE}).alias("_row"))
    return parsed.select("_row.*")
