"""Terms counted and vectors made inside the tasks that read the texts.

A document's analysed tokens reach a task as one string and are counted there,
a batch of documents at a time, so that neither an exchange nor a table of every
(term, document) is needed and what a task holds doesn't grow with its input.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer

# tasks need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP_BYTES = 16_000_000   # text counted at once
STEP_ROWS = 100_000       # rows of a batch that leaves a task


def joined_tokens(analyzer: Analyzer, text: Column) -> Column:
    """The kept tokens of a text, which hold no space, as one string."""
    return F.array_join(analyzer.tokens(text), " ")


def _steps(batch: pa.RecordBatch, column: str):
    """The rows that hold a token, in parts of about ``STEP_BYTES``: the rows,
    their tokens and where each row's tokens begin (one more place at the end)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    batch, size = batch.filter(pc.greater(size, 0)), size.filter(pc.greater(size, 0)).to_numpy()
    ends, at = np.cumsum(size, dtype=np.int64), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, side="right")))
        rows = batch.slice(at, to - at)
        tokens = pc.split_pattern(rows.column(column), " ")
        offsets = tokens.offsets.to_numpy()
        yield rows, tokens.flatten().dictionary_encode(), offsets - offsets[0]
        at = to


def postings_of(docs: DataFrame, positions: bool = False) -> DataFrame:
    """(term, docno, tf, dl[, pos array<int>]) from (docno, words, copies):
    ``words`` of ``copies`` rows of equal length, one after the other. The rows
    of a document follow each other in one partition."""
    def task(batches):
        for batch in batches:
            for rows, tokens, offsets in _steps(batch, "words"):
                per_row, terms = np.diff(offsets), len(tokens.dictionary)
                doc = np.repeat(np.arange(len(per_row)), per_row)
                key = doc * terms + tokens.indices.to_numpy().astype(np.int64)
                copies = rows.column("copies").to_numpy()
                dl = per_row // copies
                if positions:
                    pos = (np.arange(len(key)) - np.repeat(offsets[:-1], per_row)) % np.repeat(dl, per_row)
                    order = np.lexsort((pos, key))
                    key, pos = key[order], pos[order].astype(np.int32)
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    met, starts = key[first], np.append(first, len(key))
                    tf = np.diff(starts)
                else:
                    met, tf = np.unique(key, return_counts=True)
                at = met // terms
                for i in range(0, len(met), STEP_ROWS):
                    p = slice(i, i + STEP_ROWS)
                    columns = {"term": tokens.dictionary.take(pa.array(met[p] % terms)),
                               "docno": rows.column("docno").take(pa.array(at[p])),
                               "tf": pa.array(tf[p], pa.int64()), "dl": pa.array(dl[at[p]], pa.int64())}
                    if positions:
                        s = starts[i:i + STEP_ROWS + 1]
                        columns["pos"] = pa.ListArray.from_arrays(pa.array(s - s[0], pa.int32()), pa.array(pos[s[0]:s[-1]]))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "term string, docno string, tf bigint, dl bigint" + (", pos array<int>" if positions else "")
    return docs.select("docno", "words", "copies").mapInArrow(task, schema)


def hashed_vectors(texts: DataFrame, dim: int) -> DataFrame:
    """``vector`` (array<double>) instead of ``words``: per token md5 names a
    coordinate and a sign, the sums have length 1. Texts whose coordinates all
    cancel have none and go."""
    kept = [c for c in texts.columns if c != "words"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in kept)

    def place(token: str) -> int:
        h = hashlib.md5(token.encode()).hexdigest()
        return (int(h[:4], 16) % dim) * 2 + int(h[4], 16) % 2

    def task(batches):
        for batch in batches:
            for rows, tokens, offsets in _steps(batch, "words"):
                codes = np.fromiter(map(place, tokens.dictionary.to_pylist()), np.int64, len(tokens.dictionary))
                code = codes[tokens.indices.to_numpy()]
                n = len(offsets) - 1
                cell = np.repeat(np.arange(n), np.diff(offsets)) * dim + code // 2
                sums = np.bincount(cell, 1.0 - 2.0 * (code % 2), minlength=n * dim).reshape(n, dim)
                norm = np.sqrt((sums * sums).sum(axis=1))
                some = norm > 0
                unit = sums[some] / norm[some, None]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim), pa.int32()), pa.array(unit.ravel()))
                found = rows.filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([*(found.column(c) for c in kept), vectors], names=[*kept, "vector"])

    return texts.mapInArrow(task, f"{schema}, vector array<double>")
