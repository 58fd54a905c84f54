"""Cross-tokenizer alignment by lockstep, vectorised merging.

Two tokenizers cut the same bytes differently. The merge walks both token
sequences of a text at once: the pointer whose token ends first moves on, and
where both tokens end at the same byte the text is cut. All texts of a batch
walk together: one NumPy state vector holds the A and B pointers of every
document, each step moves all of them, writes the links (the two current
tokens, whose bytes overlap) and the cuts, and drops the documents that are
through. Between two cuts lies a group; every A and B token of a group are
linked.

A is the byte-level vocabulary of a ``tokenizers`` file; its merges run in
``tiktoken`` with the ids as ranks, which gives the same ids (tested over every
code point) at a quarter of the time. B is a ``sentencepiece`` model, asked once
per word and task, since no piece goes on behind a word's end (if one does,
once per text). Special tokens are plain text in both. The files are read on
the driver (their size is that of the vocabularies) and travel to the tasks by
broadcast.

Counting links over the corpus: texts are taken in blocks of ``BLOCK_CHARS``
code points. A block keeps its documents' distinct id pairs as numbers into the
block's own list of pairs, so only (block, pair) rows are counted and answered,
never (document, pair) rows: a pair that every document holds adds one row per
block. The highest count per A id has at most as many rows as the vocabulary
has ids and is broadcast. The blocks are written to the shared folder, so no
text is encoded twice and a lost executor repeats only its open blocks.

What a task holds is bounded by a block: texts are encoded in parts of
``PART_CHARS``, a part's ids become arrays at once, kept words have a bound in
number and in size, and the answers meet their blocks one block at a time. Row
groups of the written blocks are cut by ``ROW_GROUP_BYTES``.

Defined cases: a null or empty text, or one whose tokens' joined bytes differ
from a space and the text (a normaliser changed it), has no tokens: zeros and
an empty hash, and it counts for no pair; repeated rows count each; a null
doc_id stays null; a very long text is a block by itself; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder, written

# --- fixed values ---------------------------------------------------------------
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How A splits text before its merges.
A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 2_000_000
CROSS = 1_000_000      # pairs of large groups written out at once
CACHED_WORDS, CACHED_CHARS = 200_000, 4_000_000  # words whose ids a task keeps, and their size
PART_CHARS = 200_000    # encoded at once
ROWS = 256              # texts that go to Python at once
ROW_GROUP_BYTES = 16_000_000  # of the written blocks
# --- end of fixed values ----------------------------------------------------------

_WORD = re.compile(" +[^ ]*")


@dataclass(frozen=True)
class Files:
    """The two vocabulary files as they are on disk."""
    a: bytes
    b: bytes

    @staticmethod
    def read(folder: str = TOKENIZERS, a: str = A_FILE, b: str = B_FILE) -> "Files":
        with open(os.path.join(folder, a), "rb") as fa, open(os.path.join(folder, b), "rb") as fb:
            return Files(fa.read(), fb.read())


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself,
    the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        spec = json.loads(files.a)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte = byte_of_char()
        ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self._a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.a_bytes[k] = token
        self.b_bytes = [piece_bytes(self._b.id_to_piece(k)) for k in range(self._b.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # no piece goes on behind a word's end, so each run of spaces with its word is cut by itself
        self._split = all("▁" not in self._b.id_to_piece(k).lstrip("▁") for k in range(self._b.get_piece_size()))
        self._space = {" ": (self._b.piece_to_id("▁"),)}
        self._words: dict[str, tuple[int, ...] | None] = dict(self._space)
        self._chars = 0
        self._id = list(range(len(self.b_bytes)))  # one object an id, for all kept words

    def _b_ids(self, texts: list[str]) -> list[list[int] | None]:
        """B's ids of whole texts; None where its normaliser changes the bytes."""
        out = self._b.encode(texts, num_threads=1) if texts else []
        return [ids if b"".join(map(self.b_bytes.__getitem__, ids)) == (" " + t).encode() else None
                for t, ids in zip(texts, out, strict=True)]

    def _by_words(self, texts: list[str]) -> list[list[int] | None]:
        """The same, each new word encoded once."""
        cut = [_WORD.findall(" " + t) for t in texts]
        if len(self._words) > CACHED_WORDS or self._chars > CACHED_CHARS:
            self._words, self._chars = dict(self._space), 0
        new = [w for w in set(chain.from_iterable(cut)) if w not in self._words]
        self._chars += sum(map(len, new))
        for w, ids in zip(new, self._b_ids([w[1:] for w in new]), strict=True):  # the model adds the space itself
            self._words[w] = None if ids is None else tuple(map(self._id.__getitem__, ids))
        get, out = self._words.__getitem__, []
        for t, words in zip(texts, cut, strict=True):
            parts = list(map(get, words))
            out.append(self._b_ids([t])[0] if None in parts else list(chain.from_iterable(parts)))
        return out

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B; none where B changes the bytes (A can't: its
        tokens are the bytes)."""
        b = (self._by_words if self._split else self._b_ids)(texts)
        b = [ids if t and ids else [] for t, ids in zip(texts, b, strict=True)]
        return [self._a.encode_ordinary(" " + t) if ids else [] for t, ids in zip(texts, b, strict=True)], b


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts, in order, about ``PART_CHARS`` at a time."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > PART_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids one after the other, and how many each text has."""
    n = np.array([len(x) for x in ids], dtype=np.int64)
    return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(n.sum())), n


def merge(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray):
    """The lockstep merge. Tokens of all documents stand one after the other
    with the byte at which they end; ``starts`` are the documents' first tokens
    (and the number of tokens). Gives, per step of a document, the linked pair
    (A token, B token) and whether the text is cut behind it, in no order."""
    at_a, at_b = a_starts[:-1].copy(), b_starts[:-1].copy()
    stop = a_starts[1:]
    active = at_a < stop
    at_a, at_b, stop = at_a[active], at_b[active], stop[active]
    out_a, out_b, out_cut = [], [], []
    while len(at_a):
        end_a, end_b = a_ends[at_a], b_ends[at_b]
        cut = end_a == end_b
        out_a.append(at_a)
        out_b.append(at_b)
        out_cut.append(cut)
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        through = cut & (at_a == stop)   # both sequences end with the text
        if through.any():
            left = ~through
            at_a, at_b, stop = at_a[left], at_b[left], stop[left]
    if not out_a:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_cut)


class Batch:
    """Some texts, encoded and aligned."""

    def __init__(self, texts: list[str], tokenizers: Tokenizers):
        encoded = [[_joined(x) for x in tokenizers.encode(part)] for part in _parts(texts)]
        (self.a, self.n_a), (self.b, self.n_b) = [
            tuple(np.concatenate([none, *x]) for none, x in zip(_joined([]), zip(*side))) for side in zip(*encoded)
        ] or (_joined([]), _joined([]))
        self.a_starts, self.b_starts = _starts(self.n_a), _starts(self.n_b)
        at_a, at_b, cut = merge(self._ends(tokenizers.a_sizes[self.a], self.a_starts), self.a_starts,
                                self._ends(tokenizers.b_sizes[self.b], self.b_starts), self.b_starts)
        # groups: numbered through the batch; a token's group is the number of cuts before it
        last_a, last_b = np.zeros(len(self.a) + 1, dtype=bool), np.zeros(len(self.b) + 1, dtype=bool)
        last_a[at_a[cut] + 1] = True
        last_b[at_b[cut] + 1] = True
        self.groups = int(cut.sum())
        del at_a, at_b, cut
        self.group_a, self.group_b = (np.cumsum(x, dtype=np.int32)[:-1] for x in (last_a, last_b))
        self.a_of = np.bincount(self.group_a, minlength=self.groups)   # tokens of each group
        self.b_of = np.bincount(self.group_b, minlength=self.groups)
        self.doc_a = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_a)
        ends = np.searchsorted(self.group_a, np.arange(self.groups), side="right") - 1
        self.doc_of = self.doc_a[ends] if self.groups else np.zeros(0, dtype=np.int32)
        self.n_groups = np.bincount(self.doc_of, minlength=len(texts))
        self.n_links = np.bincount(self.doc_of, weights=self.a_of * self.b_of, minlength=len(texts)).astype(np.int64)

    @staticmethod
    def _ends(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = _starts(sizes)
        return total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id * width + B id, links) of every distinct pair of
        each document, by document, then pair."""
        first_b = _starts(self.b_of)
        per_a = self.b_of[self.group_a]        # each A token meets all B tokens of its group
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(per_a) // CROSS)) + 1, [len(per_a)]])
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = per_a[lo:hi]
            which = np.repeat(np.arange(lo, hi), n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[self.group_a[lo:hi]], n)
            key = (self.doc_a[which].astype(np.int64) << 40) | (self.a[which].astype(np.int64) * width + self.b[b])
            found.append(np.unique(key, return_counts=True))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        keys = np.concatenate([k for k, _ in found])
        links = np.concatenate([n for _, n in found])
        if len(found) > 1:
            keys, back = np.unique(keys, return_inverse=True)
            links = np.bincount(back, weights=links, minlength=len(keys)).astype(np.int64)
        return keys >> 40, keys & ((1 << 40) - 1), links

    def texts_of_groups(self, a_names: list[str], b_names: list[str]) -> Iterator[str]:
        """``a1,a2|b1;a3|b2,b3`` of every document. ``names`` hold each id
        twice: followed by a comma, and by the mark that ends its part."""
        last_a = np.diff(self.group_a, append=-1) != 0
        last_b = np.diff(self.group_b, append=-1) != 0
        order = np.empty(len(self.a) + len(self.b), dtype=np.int32)
        order[np.arange(len(self.a)) + _starts(self.b_of)[self.group_a]] = self.a + last_a * (len(a_names) // 2)
        order[np.arange(len(self.b)) + _starts(self.a_of)[self.group_b + 1]] = (
            len(a_names) + self.b + last_b * (len(b_names) // 2))
        names, starts = a_names + b_names, (self.a_starts + self.b_starts).tolist()
        return ("".join(map(names.__getitem__, order[s:e].tolist()))[:-1]
                for s, e in zip(starts[:-1], starts[1:], strict=True))


def names_of(ids: int, mark: str) -> list[str]:
    return [f"{k}," for k in range(ids)] + [f"{k}{mark}" for k in range(ids)]


_BLOCK = ("doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<long>, "
          "sha array<string>, entries array<int>, at array<int>, links array<int>, pair array<long>, held array<int>")


def block_row(ids: list, texts: list[str], tokenizers: Tokenizers, a_names: list[str], b_names: list[str]) -> tuple:
    batch = Batch(texts, tokenizers)
    doc, pair, links = batch.pairs(len(tokenizers.b_bytes))
    distinct, at, held = np.unique(pair, return_inverse=True, return_counts=True)
    sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in batch.texts_of_groups(a_names, b_names)]
    return (ids, batch.n_a, batch.n_b, batch.n_groups, batch.n_links, sha,
            np.bincount(doc, minlength=len(texts)), at, links, distinct, held)


def _encoder(files, chars: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(files.value)
        a_names, b_names = names_of(len(tokenizers.a_bytes), "|"), names_of(len(tokenizers.b_bytes), ";")
        columns = [c.split()[0] for c in _BLOCK.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split("<")[1][:-1]] for c in _BLOCK.split(", ")]

        def block() -> pa.RecordBatch:
            row = block_row(ids, texts, tokenizers, a_names, b_names)
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in zip(row, types)],
                names=columns)

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and size + len(text) > chars:
                    yield block()
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()
    return encode


@contextmanager
def _short_batches(spark) -> Iterator[None]:
    """What is run inside sends texts to Python ``ROWS`` at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Aligned:
    """The documents' blocks and the corpus-wide count of every linked pair."""

    def __init__(self, docs: DataFrame, files: Files | None = None, chars: int = BLOCK_CHARS):
        spark = docs.sparkSession
        files = files or Files.read()
        shipped = spark.sparkContext.broadcast(files)
        self.folder = shared_folder(spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        # a row is a whole block, so the size of a row group is looked at row by row
        with _short_batches(spark):
            self.blocks = written(rows.mapInArrow(_encoder(shipped, chars), _BLOCK)
                                  .withColumn("block", F.monotonically_increasing_id()), self.folder, "blocks",
                                  options={"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size.row.check.min": 1})
        import sentencepiece
        self.width = sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()
        self.asked = self.blocks.select("block", F.posexplode(F.arrays_zip("pair", "held"))).select(
            "block", "pos", "col.pair", "col.held")
        counts = checkpointed(self.asked.groupBy("pair").agg(F.sum("held").alias("n")))
        a = F.floor(F.col("pair") / self.width)
        most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most one row per id of A
        self.counts = counts.withColumn("a", a).join(F.broadcast(most), "a").select(
            "pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def link_table(self) -> DataFrame:
        """(a, b, docs, best): how many documents hold each id pair linked, and
        whether it is the highest of its A id."""
        return self.counts.select(F.floor(F.col("pair") / self.width).alias("a"), (F.col("pair") % self.width).alias("b"),
                                  F.col("n").alias("docs"), "best")

    def documents(self) -> DataFrame:
        """The sizes and digests of every document."""
        code = (2 * F.col("n") + F.col("best").cast("long")).alias("code")
        answers = self.asked.drop("held").join(self.counts, "pair").select(F.col("block").alias("of"), "pos", code)
        return (self.blocks.drop("pair", "held").groupBy("block").cogroup(answers.groupBy("of"))
                .applyInPandas(_digests, _DIGEST))


_DIGEST = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def _digests(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The rows of one block; ``answers`` are those of its distinct pairs."""
    r = next(blocks.itertuples(index=False))
    codes = np.zeros(len(answers), dtype=np.int64)
    codes[answers["pos"].to_numpy()] = answers["code"].to_numpy()
    doc = np.repeat(np.arange(len(r.doc_id)), r.entries)
    code, links = codes[r.at], np.asarray(r.links, dtype=np.int64)
    best, total = np.zeros(len(r.doc_id), dtype=np.int64), np.zeros(len(r.doc_id), dtype=np.int64)
    np.add.at(best, doc, links * (code & 1))
    np.add.at(total, doc, links * (code >> 1))
    return pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in r.doc_id], dtype="Int64"),
                         "n_a": r.n_a, "n_b": r.n_b,
                         "n_groups": r.n_groups, "n_links": r.n_links, "n_best": best, "count_sum": total,
                         "groups_sha256": r.sha}).astype({c: "int64" for c in ("n_a", "n_b", "n_groups", "n_links")})


def groups(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """(doc_id, groups): the alignment itself, as ``a1,a2|b1;a3|b2,b3``."""
    shipped = docs.sparkSession.sparkContext.broadcast(files or Files.read())

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = Tokenizers(shipped.value)
        a_names, b_names = names_of(len(tokenizers.a_bytes), "|"), names_of(len(tokenizers.b_bytes), ";")
        for batch in batches:
            if len(batch):
                done = Batch(batch["text"].to_list(), tokenizers)
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                    "groups": list(done.texts_of_groups(a_names, b_names))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
                       ).mapInPandas(align, "doc_id long, groups string")
