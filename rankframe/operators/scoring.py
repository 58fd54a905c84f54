"""The k best documents of many queries, found in the tasks that hold the documents.

A query batch meets nearly every document, so one row per (query, document) is
never made: a document's matched postings, which follow each other in a task, are
added up for a block of queries there, and only rows that can be among a query's k best
leave the task. What moves grows with the documents and with k rows a query and
task, not with their product.

A block is at most about ``BLOCK_ROWS`` query terms; its terms and queries are
numbered in the driver and broadcast. One pass over the postings scores up to
``PASS_BLOCKS`` blocks, as long as their distinct terms are no more than a block.

Terms that many documents and many queries share make most of the products. A
task counts its first ``WARM_DOCUMENTS`` and from then on adds these terms up by a
product of matrices, (document, term) by (term, query); the other terms' products
are still made one by one. Which terms they are changes no sum.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# tasks need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1_000_000   # query terms scored in one pass
CELLS = 1_000_000        # (document, query) sums held at once
MATCHES = 2_000_000      # (posting, query) products held at once, if a document allows
BUFFER_ROWS = 1_000_000  # rows kept beside k a query before they are cut again, by all blocks of a pass
PASS_BLOCKS = 2          # blocks scored in one pass
STEP_ROWS = 50_000       # postings looked at together
WARM_DOCUMENTS = 256     # documents counted before the shared terms are chosen
DENSE_SHARE = 0.008      # of all (document, query) that a shared term joins, at least
DENSE_CELLS = 2_000_000  # (shared term, query) weights of a block
SLACK = 2e-6             # scores further apart than this can't be equal to 6 places


@dataclass(frozen=True)
class Block:
    """The queries of a block: term number -> queries and weights."""
    first: np.ndarray    # place of a term's first entry; one more at the end
    query: np.ndarray
    weight: np.ndarray
    length: np.ndarray   # query number -> query length
    qids: pa.Array

    @staticmethod
    def number(qt: DataFrame) -> tuple["Block", pa.Array]:
        """The block of (qid, term, qtf, qlen) and its terms by number."""
        rows = qt.select("qid", "term", "qtf", "qlen").toArrow().combine_chunks()
        terms, qids = (_encoded(rows.column(name)) for name in ("term", "qid"))
        tid, query = terms.indices.to_numpy(), qids.indices.to_numpy()
        order = np.argsort(tid, kind="stable")
        first = np.zeros(len(terms.dictionary) + 1, np.int64)
        np.cumsum(np.bincount(tid, minlength=len(terms.dictionary)), out=first[1:])
        length = np.zeros(len(qids.dictionary))
        length[query] = rows.column("qlen").to_numpy()
        return Block(first, query[order].astype(np.int32), rows.column("qtf").to_numpy()[order], length,
                     qids.dictionary), terms.dictionary

    def among(self, tid: np.ndarray, terms: int) -> "Block":
        """The block with its i-th term numbered ``tid[i]`` among ``terms``."""
        order, n = np.argsort(tid), np.zeros(terms, np.int64)
        n[tid] = np.diff(self.first)
        place = _ranges(self.first[order], np.diff(self.first)[order])
        return Block(np.concatenate(([0], np.cumsum(n))), self.query[place], self.weight[place], self.length, self.qids)


def passes(parts: Iterable[DataFrame]) -> Iterator[tuple[list[Block], pa.Table]]:
    """The parts' blocks, some at a time, with the (term, tid) they share."""
    def shared():
        vocabulary = pa.table({"term": terms, "tid": pa.array(np.arange(len(terms)), pa.int32())})
        return [b.among(pc.index_in(own, value_set=terms).to_numpy(), len(terms)) for b, own in blocks], vocabulary

    blocks, terms = [], None
    for qt in parts:
        block, own = Block.number(qt)
        pa.default_memory_pool().release_unused()   # the rows' strings
        if not len(block.length):
            continue
        both = pc.unique(pa.concat_arrays([terms, own])) if blocks else own
        if blocks and (len(blocks) == PASS_BLOCKS or len(both) > BLOCK_ROWS):
            yield shared()
            blocks, both = [], own
        blocks.append((block, own))
        terms = both
    if blocks:
        yield shared()


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers on from each ``first``, one range after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _encoded(column) -> pa.DictionaryArray:
    column = column.cast(pa.string()).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode(null_encoding="encode")


class Best:
    """The rows of a task that can be among a query's k best, ties of the
    rounded score included."""

    def __init__(self, block: Block, k: int, buffer: int | None = None):
        self.block, self.k, self.buffer = block, k, buffer or BUFFER_ROWS
        self.floor = np.full(len(block.length), -np.inf)
        self.names: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.seen = self.held = 0
        self.parts: list[tuple] = []
        self.limit = self.buffer
        self.met = np.zeros(len(block.first) - 1, np.int64)   # documents of each term, until the shared ones are chosen
        self.column = self.matrix = self.has = None
        self.positive = bool((block.weight > 0).all())

    def choose(self) -> None:
        """The terms that most (document, query) share become columns."""
        block, queries, n = self.block, len(self.block.length), np.diff(self.block.first)
        share = self.met / self.seen * n / queries
        chosen = np.argsort(-share, kind="stable")[:min(DENSE_CELLS // queries, int((share >= DENSE_SHARE).sum()))]
        self.met = None
        if len(chosen):
            self.column = np.full(len(n), -1, np.int32)
            self.column[chosen] = np.arange(len(chosen))
            place = _ranges(block.first[chosen], n[chosen])
            cell, size = np.repeat(np.arange(len(chosen)) * queries, n[chosen]) + block.query[place], len(chosen) * queries
            self.matrix = np.bincount(cell, block.weight[place], minlength=size).reshape(-1, queries)
            self.has = (np.bincount(cell, minlength=size) > 0).reshape(-1, queries)

    def add(self, docno: pa.Array, dl: np.ndarray, base: np.ndarray, sizes: np.ndarray, tid: np.ndarray,
            weights: list[np.ndarray], lead_has_base: list[bool]) -> None:
        """Documents with their matched terms (``sizes`` a document)."""
        block, queries = self.block, len(self.block.length)
        self.names.append(docno)
        self.lengths.append(dl)
        per_posting = block.first[tid + 1] - block.first[tid]
        if self.met is not None and self.seen >= WARM_DOCUMENTS:
            self.choose()
        if self.met is not None:
            self.met += np.bincount(tid, minlength=len(self.met))
        if self.column is not None:
            column = self.column[tid]
            per_posting = np.where(column < 0, per_posting, 0)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        met = np.concatenate(([0], np.cumsum(per_posting)))[ends]   # products before each document
        at = 0
        while at < len(sizes):
            to = min(at + max(1, CELLS // queries), int(np.searchsorted(met, met[at] + MATCHES, side="right")) - 1)
            to = min(max(to, at + 1), len(sizes))
            part = slice(ends[at], ends[to])
            n = per_posting[part]
            doc = np.repeat(np.arange(to - at), sizes[at:to])
            place = _ranges(block.first[tid[part]], n)
            cell = np.repeat(doc * queries, n) + block.query[place]
            qtf, cells = block.weight[place], (to - at) * queries
            touched = np.zeros(cells, bool)
            touched[cell] = True
            shared = None
            if self.column is not None:
                at_column, width = column[part], len(self.matrix)
                among = at_column >= 0
                shared = doc[among] * width + at_column[among]
            sums = []
            for w, has_base in zip(weights, lead_has_base):
                s = np.bincount(cell, qtf * np.repeat(w[part], n), minlength=cells)
                if shared is not None:
                    w_shared = w[part][among]
                    more = (np.bincount(shared, w_shared, minlength=(to - at) * width).reshape(-1, width) @ self.matrix).ravel()
                    if not sums and self.positive and (w_shared > 0).all():
                        touched |= more > 0
                    elif not sums:
                        met_here = np.bincount(shared, minlength=(to - at) * width).reshape(-1, width) > 0
                        touched |= (met_here.astype(np.float32) @ self.has.astype(np.float32) > 0).ravel()
                    s = s + more
                sums.append(s + np.outer(base[at:to], block.length).ravel() if has_base else s)
            wanted = touched & (sums[0].reshape(-1, queries) >= self.floor - SLACK).ravel()
            chosen = np.flatnonzero(wanted)
            self.parts.append(((chosen % queries).astype(np.int32), self.seen + at + chosen // queries,
                               *[s[chosen] for s in sums]))
            self.held += len(chosen)
            if self.held > self.limit:
                self.cut()
            at = to
        self.seen += len(sizes)

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*self.parts)]

    def cut(self) -> None:
        """Only what the k-th score of a query doesn't rule out stays; of the
        rows with one exact score the k first by document."""
        query, doc, *sums = self.columns()
        met, doc_at = np.unique(doc, return_inverse=True)
        names = pa.concat_arrays(self.names).take(pa.array(met))
        place = np.empty(len(met), np.int64)
        place[pc.array_sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(met))
        order = np.lexsort((place[doc_at], -sums[0], query))
        query, doc, sums = query[order], doc[order], [s[order] for s in sums]
        kth = _places(query[1:] != query[:-1]) == self.k - 1
        self.floor[query[kth]] = sums[0][kth]
        equal = _places((query[1:] != query[:-1]) | (sums[0][1:] != sums[0][:-1]))
        keep = (sums[0] >= self.floor[query] - SLACK) & (equal < self.k)
        self.parts = [(query[keep], doc[keep], *[s[keep] for s in sums])]
        self.held = int(keep.sum())
        self.limit = self.held + self.buffer

    def rows(self, names: list[str]):
        """The rows of the task, in batches."""
        if not self.held:
            return
        self.cut()
        (query, doc, *sums), docno, dl = self.parts[0], pa.concat_arrays(self.names), np.concatenate(self.lengths)
        for i in range(0, len(query), 100_000):
            p = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [self.block.qids.take(pa.array(query[p])), docno.take(pa.array(doc[p])), pa.array(dl[doc[p]]),
                 *[pa.array(s[p]) for s in sums]], names=["qid", "docno", "dl", *names])


def _places(new: np.ndarray) -> np.ndarray:
    """Place of each row in its run; ``new`` tells where the next run begins."""
    start = np.flatnonzero(np.concatenate(([True], new)))
    return np.arange(len(new) + 1) - np.repeat(start, np.diff(np.append(start, len(new) + 1)))


def _steps(batches):
    """The batches, about ``STEP_ROWS`` rows at a time."""
    some, rows = [], 0
    for batch in batches:
        some.append(batch)
        rows += batch.num_rows
        if rows >= STEP_ROWS:
            yield pa.Table.from_batches(some)
            some, rows = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _documents(batches):
    """The rows in whole documents (equal docno and dl, one after the other):
    (rows, where each document begins). A batch's last document waits for the next."""
    held = None
    for table in _steps(batches):
        table = (pa.concat_tables([held, table]) if held else table).combine_chunks()
        docno = _encoded(table.column("docno")).indices.to_numpy()
        dl = table.column("dl").to_numpy()
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(dl), 1), bool), (docno[1:] != docno[:-1]) | (dl[1:] != dl[:-1]))))
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        held = table.slice(int(starts[-1])) if len(starts) else held
    if held:
        yield held, np.zeros(1, np.int64)


def best_of_documents(postings: DataFrame, blocks: list[Block], names: list[str], with_base: list[bool], k: int) -> DataFrame:
    """(qid, docno, dl, <names>...) from (docno, dl[, base], tid, w0, w1...), the
    rows of a document one after the other: a weight a model, times the query's.
    Models ``with_base`` add ``base`` times the query length. The first model decides."""
    # plain arrays: a broadcast value is pickled by name
    sent = [postings.sparkSession.sparkContext.broadcast((b.first, b.query, b.weight, b.length, b.qids)) for b in blocks]

    def task(batches):
        bests = [Best(Block(*b.value), k, BUFFER_ROWS // len(sent)) for b in sent]
        for rows, starts in _documents(batches):
            def column(name):
                return rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
            docs = rows.select(["docno", "dl"]).take(pa.array(starts))
            docno = docs.column("docno").cast(pa.string()).combine_chunks()
            docno = pa.concat_arrays(docno.chunks) if isinstance(docno, pa.ChunkedArray) else docno
            base = column("base")[starts] if any(with_base) else np.zeros(len(starts))
            dl, sizes, tid = docs.column("dl").to_numpy(), np.diff(np.append(starts, len(rows))), column("tid")
            # a null contribution adds nothing
            weights = [np.nan_to_num(column(f"w{i}")) for i in range(len(names))]
            for best in bests:
                best.add(docno, dl, base, sizes, tid, weights, with_base)
        for best in bests:
            yield from best.rows(names)

    schema = "qid string, docno string, dl bigint, " + ", ".join(f"`{n}` double" for n in names)
    return postings.mapInArrow(task, schema)
