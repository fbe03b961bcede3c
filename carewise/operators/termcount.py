"""Counts of terms per task, whole or as summaries of a bounded size with a certified error."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

COUNT_SCHEMA = "term string, df long, cf long, error long"
# Rows of counted batches that a task holds before it sums or summarises them.
HELD_ROWS = 400_000
# Words that are counted at once; a longer document is counted alone.
COUNTED_WORDS = 131_072

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def count_terms(words: pa.ListArray, low: int, high: int, stop_words: Sequence[str]) -> pa.Table:
    """(term, df, cf) of the word lists of some documents: runs of ``low`` to ``high`` words that are no stop words."""
    flat, owner = pc.list_flatten(words), np.asarray(pc.list_parent_indices(words), dtype=np.int64)
    if stop_words:
        kept = pc.invert(pc.is_in(flat, pa.array(list(stop_words), flat.type)))
        flat, owner = flat.filter(kept), owner[np.asarray(kept)]
    coded = flat.dictionary_encode()
    names, codes = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
    size, tables = len(names), []
    term_names, term = names, codes
    for n in range(1, high + 1):
        if n > 1:
            # The run before and one more word of the same document.
            inside = owner[: len(owner) - n + 1] == owner[n - 1:]
            key, term = np.unique(term[: len(inside)][inside] * size + codes[n - 1:][inside], return_inverse=True)
            term_names = pc.binary_join_element_wise(term_names.take(pa.array(key // size)), names.take(pa.array(key % size)), " ")
            places = np.flatnonzero(inside)
        else:
            places = np.arange(len(codes))
        if n >= low and len(term):
            cf = np.bincount(term, minlength=len(term_names))
            once = np.unique(owner[places] * len(term_names) + term)
            df = np.bincount(once % len(term_names), minlength=len(term_names))
            tables.append(pa.table({"term": term_names, "df": df.astype(np.int64), "cf": cf.astype(np.int64)}))
        if n > 1 and n < high:
            # Places that begin no run of n words begin none of n + 1; they get the number behind all.
            full = np.full(len(owner), len(term_names), dtype=np.int64)
            full[places] = term
            term = full
            term_names = pa.concat_arrays([term_names.cast(pa.string()), pa.array([""], pa.string())])
    empty = pa.table({"term": pa.array([], pa.string()), "df": pa.array([], pa.int64()), "cf": pa.array([], pa.int64())})
    return pa.concat_tables([empty, *tables])


def _pieces(words: pa.ListArray) -> Iterator[pa.ListArray]:
    """A batch of word lists in pieces of ``COUNTED_WORDS`` words, so that no batch of long texts needs more memory."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(words):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + COUNTED_WORDS, side="right")))
        yield words.slice(first, end - first)
        first = end


def _summed(tables: list[pa.Table]) -> pa.Table:
    grouped = pa.concat_tables(tables).group_by("term").aggregate([("df", "sum"), ("cf", "sum")])
    return pa.table({"term": grouped.column("term"), "df": grouped.column("df_sum"), "cf": grouped.column("cf_sum")})


def counter(low: int, high: int, stop_words: Sequence[str], capacity: int | None) -> Callable:
    """A task's work on batches of word lists (words).

    Without a capacity all counts leave it, summed now and then. With one, only the ``capacity`` most
    frequent terms are kept at each such point; the largest count that goes is added to the error. What is
    missing from any count is then no more than the error, which the last row states.
    """

    def out(table: pa.Table, error: int | None = None) -> Iterator[pa.RecordBatch]:
        nothing = pa.nulls(table.num_rows, pa.int64())
        whole = table.append_column("error", nothing)
        if error is not None:
            whole = pa.concat_tables([whole, pa.table({"term": pa.array([None], pa.string()), "df": [0], "cf": [0], "error": [error]})])
        yield from whole.combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = error = 0
        for words in (piece for batch in batches for piece in _pieces(batch.column("words"))):
            held.append(count_terms(words, low, high, stop_words))
            rows += held[-1].num_rows
            if rows < HELD_ROWS:
                continue
            table = _summed(held)
            if capacity is None:
                yield from out(table)
                held, rows = [], 0
                continue
            if table.num_rows > capacity:
                table, gone = _kept(table, capacity)
                error += gone
            held, rows = [table], table.num_rows
        if held:
            table = _summed(held)
            if capacity is not None and table.num_rows > capacity:
                table, gone = _kept(table, capacity)
                error += gone
            yield from out(table, error if capacity is not None else None)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker may wait for its next task for long

    return run


def _kept(table: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    order = np.argsort(-table.column("cf").to_numpy(), kind="stable")
    return table.take(pa.array(order[:capacity])), int(table.column("cf").to_numpy()[order[capacity]])
