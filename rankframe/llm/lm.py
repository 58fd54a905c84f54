"""Language-model scores by deleted interpolation.

A bigram model mixes three estimates of a token w after its context h,

    P(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1),

with one set of weights for each bucket b of the context's frequency c(h)
(octaves). The weights are learned by expectation-maximisation on held-out
counts: the training documents of every ``HELD``-th block are deleted from
the counts, and the weights maximise the likelihood of the deleted tokens
under the rest.

Tokens are words (A-Z lower-cased) and one end mark per document, which is
also the first token's context.

*How it is spread.* Documents are dealt into blocks of about ``BLOCK_CHARS``
code points by a hash. A block's distinct n-grams, hashed and counted, go to
the parts of the hash space that own them (one sorted, packed array per block
and part, so an n-gram that is very common adds one entry per block). A part
sums its counts and answers each block with an array of totals in the order
of the block's own keys; the block, regrouped with the answers, scores its
documents. Blocks and parts both grow in number with the input, neither in
size; no vocabulary or count table meets in one place. N, V and the mixture
statistics (cells of quarter octaves) are the only numbers the driver sees.

Defined cases: a null or empty text is one end mark; a null doc_id counts as
the empty id; repeated rows count and are scored each; without training
rows N and V are 0 and the weights even; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import checkpointed, id_remainder

# --- fixed values ---------------------------------------------------------------
BLOCK_CHARS = 12_000_000
MIN_BLOCKS = 16
HELD = 8                # one block in so many is held out for the mixture weights
KEY_BITS = 56
BUCKETS = 24            # octaves of the context's frequency; bucket 0: unseen
GRID = 4                # cells an octave
EM_STEPS, EM_TOLERANCE, FLOOR = 200, 1e-7, 1e-6
# --- end of fixed values ----------------------------------------------------------


# ------------------------------------------------------------------- a block
class _Numbers(dict):
    """word → number in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered_tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of every token, the hash of each number (0: the end mark), and
    the position after each text's last token; ``texts`` as from ``squeezed``."""
    numbers = _Numbers({b"\n": 0})  # white space is no word
    out, ends, n = [np.zeros(0, np.int64)], [], 0
    for t in texts:
        words = zlib.decompress(t).lower().split()
        words.append(b"\n")
        out.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
        n += len(words)
        ends.append(n)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in numbers), dtype=np.uint64, count=len(numbers))
    return np.concatenate(out), hashes, np.array(ends, dtype=np.int64)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (a ^ (a >> np.uint64(31))) >> np.uint64(64 - KEY_BITS)


class Block:
    """The tokens of some documents as places in the block's distinct keys."""

    def __init__(self, texts, learned):
        tokens, hashes, self.ends = numbered_tokens(texts)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.learned = np.repeat(np.asarray(learned, dtype=bool), self.ends - self.starts)
        before = np.concatenate([[0], tokens])[:-1]  # a text's last token is the end mark
        pairs = hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[tokens]
        self.pair_keys, self.pair = np.unique(_mixed(pairs), return_inverse=True)
        keys = _mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.word_keys, self.word, self.context = keys[order], place[tokens], place[before]

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.learned.astype(np.float64)
        return (np.bincount(self.word, weights=w, minlength=len(self.word_keys)).astype(np.int64),
                np.bincount(self.pair, weights=w, minlength=len(self.pair_keys)).astype(np.int64))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the steps from key to key, each of as
    many bytes as the largest step needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    width = packed[0]
    low = np.frombuffer(packed, dtype=np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(low) + 1, 8), dtype=np.uint8)
    full[0] = np.frombuffer(packed, dtype=np.uint8, offset=1, count=8)
    full[1:, :width] = low
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as planes of bytes (the high ones are mostly zero), compressed."""
    return zlib.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def edges(parts: int) -> np.ndarray:
    return np.array([(i << KEY_BITS) // parts for i in range(1, parts)], dtype=np.uint64)


_SENT = "kind int, part int, block int, keys binary, counts binary"
_ANSWERED = "kind int, part int, block int, counts binary, total long, distinct long"


def _counter(parts: int):
    def count(docs: pd.DataFrame) -> pd.DataFrame:
        """What a block sends: kind 1 words, kind 2 pairs."""
        b = Block(docs["text"], docs["learned"])
        rows, block = [], int(docs["block"].iloc[0])
        for kind, keys, counts in zip((1, 2), (b.word_keys, b.pair_keys), b.own_counts(), strict=True):
            cuts = [0, *np.searchsorted(keys, edges(parts)).tolist(), len(keys)]
            for part, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if j > i:
                    rows.append((kind, part, block, pack_keys(keys[i:j]), pack_counts(counts[i:j])))
        return pd.DataFrame(rows, columns=["kind", "part", "block", "keys", "counts"])
    return count


def _answer(sent: pd.DataFrame) -> pd.DataFrame:
    """A part's answer to each block: the totals of its keys, in its order."""
    kind, part = int(sent["kind"].iloc[0]), int(sent["part"].iloc[0])
    keys = [unpack_keys(k) for k in sent["keys"]]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([unpack_counts(c) for c in sent["counts"]]),
                        minlength=len(every)).astype(np.int64)
    rows, at = [(kind, part, None, None, int(total.sum()), int((total > 0).sum()))], 0
    for block, k in zip(sent["block"], keys, strict=True):
        rows.append((kind, part, int(block), pack_counts(total[place[at:at + len(k)]]), None, None))
        at += len(k)
    return pd.DataFrame(rows, columns=["kind", "part", "block", "counts", "total", "distinct"]).astype(
        {"block": "Int32", "total": "Int64", "distinct": "Int64"})


def _totals(answers: pd.DataFrame, kind: int) -> np.ndarray:
    own = answers[answers["kind"] == kind].sort_values("part")
    return np.concatenate([unpack_counts(c) for c in own["counts"]]) if len(own) else np.zeros(0, np.int64)


# --------------------------------------------------------------------- mixture
@dataclass(frozen=True)
class Model:
    tokens: int             # N
    types: int              # V
    weights: np.ndarray     # BUCKETS x 3: of pair, word, even estimates


def bucket_of(contexts: np.ndarray) -> np.ndarray:
    """0: unseen; else 1 + octave."""
    out = np.zeros(len(contexts), dtype=np.int64)
    seen = contexts > 0
    out[seen] = np.minimum(1 + np.floor(np.log2(contexts[seen])).astype(np.int64), BUCKETS - 1)
    return out


def _cells(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Cell numbers: bucket, quarter octave of p2 and of p1 (1023: zero)."""
    def octave(p):
        out = np.full(len(p), 1023, dtype=np.int64)
        seen = p > 0
        out[seen] = np.minimum(np.round(-GRID * np.log2(p[seen])).astype(np.int64), 1022)
        return out
    return (bucket << 20) | (octave(p2) << 10) | octave(p1)


def learn_weights(cells: np.ndarray, counts: np.ndarray, types: int) -> np.ndarray:
    """Expectation-maximisation of the mixture weights, one set per bucket."""
    bucket, q2, q1 = cells >> 20, (cells >> 10) & 1023, cells & 1023
    p = np.column_stack([np.where(q2 == 1023, 0, 2.0 ** (-q2 / GRID)), np.where(q1 == 1023, 0, 2.0 ** (-q1 / GRID)),
                         np.full(len(cells), 1.0 / (types + 1))])
    whole = np.bincount(bucket, weights=counts, minlength=BUCKETS)
    w = np.full((BUCKETS, 3), 1 / 3)
    w[0] = 0, 0.5, 0.5
    for _ in range(EM_STEPS if len(cells) else 0):
        share = p * w[bucket]
        share *= (counts / share.sum(axis=1))[:, None]
        new = np.column_stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)])
        new = np.where(whole[:, None] > 0, new / np.maximum(whole, 1)[:, None], w)
        moved, w = np.abs(new - w).max(), new
        if moved < EM_TOLERANCE:
            break
    w = np.maximum(w, [0, FLOOR, FLOOR])
    w[0, 0] = 0
    return w / w.sum(axis=1, keepdims=True)


def _estimates(c2: np.ndarray, ch: np.ndarray, c1: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.divide(c2, ch, out=np.zeros(len(c2)), where=ch > 0), c1 / n if n else np.zeros(len(c1))


def _held_cells(tokens: int):
    def cells(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Cells of a block's learned tokens under the counts without the block."""
        if not len(docs):
            return pd.DataFrame({"cell": [], "n": []}).astype("int64")
        b = Block(docs["text"], docs["learned"])
        own1, own2 = b.own_counts()
        c1, c2 = _totals(answers, 1) - own1, _totals(answers, 2) - own2
        t = b.learned
        ch = c1[b.context[t]]
        p2, p1 = _estimates(c2[b.pair[t]], ch, c1[b.word[t]], tokens - int(t.sum()))
        cell, n = np.unique(_cells(bucket_of(ch), p2, p1), return_counts=True)
        return pd.DataFrame({"cell": cell, "n": n})
    return cells


_SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


def _scores(model: Model):
    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _SCORED.split(", ")]
        if not len(docs):
            return pd.DataFrame(columns=columns)
        b = Block(docs["text"], docs["learned"])
        c1, c2 = _totals(answers, 1), _totals(answers, 2)
        base = np.log10((c1 + 1) / (model.tokens + model.types + 1))[b.word]
        ch, cw = c1[b.context], c1[b.word]
        p2, p1 = _estimates(c2[b.pair], ch, cw, model.tokens)
        w = model.weights[bucket_of(ch)]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (model.types + 1)
        known = (cw > 0).astype(np.int64)
        return pd.DataFrame({
            "doc_id": docs["doc_id"].astype("Int64").array, "held_out": ~docs["learned"].to_numpy(dtype=bool),
            "n_tokens": b.ends - b.starts, "n_known": np.add.reduceat(known, b.starts),
            "train_tokens": np.full(len(docs), model.tokens, dtype=np.int64),
            "base_score": np.add.reduceat(base, b.starts), "score": np.add.reduceat(np.log10(p), b.starts)})[columns]
    return score


# ------------------------------------------------------------------------ jobs
def squeeze(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def squeezed(text: "F.Column") -> "F.Column":
    """Texts compressed one by one, for the shuffles."""
    @pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(squeeze)
    return packed(text)


def dealt(docs: DataFrame, learned: "F.Column", blocks: int) -> DataFrame:
    """(doc_id, text, learned, block), texts compressed; the block is a hash
    of the row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), squeezed(text).alias("text"),
                       learned.alias("learned"),
                       F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int").alias("block"))


def fit(rows: DataFrame, parts: int) -> tuple[Model, DataFrame]:
    """The model, and the parts' answers to the blocks of ``rows``."""
    sent = rows.groupBy("block").applyInPandas(_counter(parts), _SENT)
    answers = checkpointed(sent.groupBy("kind", "part").applyInPandas(_answer, _ANSWERED))
    n, v = answers.filter("block IS NULL AND kind = 1").agg(
        F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    answers = answers.filter("block IS NOT NULL").select("kind", "part", "block", "counts")
    held = F.col("block") % HELD == 0
    cells = (rows.filter(held).groupBy("block").cogroup(answers.filter(held).groupBy("block"))
             .applyInPandas(_held_cells(n), "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas())  # bounded number of cells
    return Model(n, v, learn_weights(cells["cell"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=np.float64),
                                     v)), answers


def score_documents(docs: DataFrame, learned: "F.Column | None" = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row; learned from the rows where ``learned`` holds."""
    learned = id_remainder("doc_id", 7) != 2 if learned is None else learned
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(MIN_BLOCKS, -(-chars // BLOCK_CHARS))
    rows = dealt(docs, learned, blocks)
    model, answers = fit(rows, parts=blocks)
    return (rows.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInPandas(_scores(model), _SCORED))
