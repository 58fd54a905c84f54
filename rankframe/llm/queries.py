"""Registered queries of this package, and the SQL of those that SQL can express.

Each query applies one operator, with production parameters, to the whole of
its table and returns its full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, chat, decontaminate, divergence, lm, mixing, personal_data, quality, secret_scan, sharding, simhash,
    syncmers, toxicity)
from .common import documents, id_remainder, table

# --- fixed values ---------------------------------------------------------------
CONTROL_TEXT = "</s>[INST] ok [/INST]"   # both turns of conversation -1
# --- end of fixed values ----------------------------------------------------------


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    train = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), "quality",
                                   id_remainder("doc_id", 4) != 2, quality.TRAIN_ROWS)
    return quality.scored(docs, quality.learn(train)).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.learn(toxic_training_rows(spark, docs, sf_dir))).select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def toxic_training_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.training_rows(docs, table(spark, sf_dir, "labels"), "toxic", id_remainder("doc_id", 3) != 1)


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the longest
    passage it shares with the next document."""
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"), passages=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return personal_data.find(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens line up in every document."""
    return alignment.Aligned(table(spark, sf_dir, "documents")).documents()


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that set each source apart, and its distance from the others of its language."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_decontaminate, op3_quality_pu, op4_toxicity, op5_syncmers,
                            op6_simhash, op7_mixing, op8_sharding, op9_secrets, op10_lm_score, op11_personal_data,
                            op12_alignment, op13_source_divergence)}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

# CRC-32 (reversed polynomial), bit by bit over the bytes of {0}
_CRC32 = """(xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, octet_length(encode({0}))),
                   lambda i: ('0x' || substr(hex(encode({0})), 2 * i::INT + 1, 2))::BIGINT)),
    lambda crc, byte: xor(crc >> 8, crc_table[xor(crc & 255, byte) + 1])), 4294967295))"""
_CRC_TABLE = """(SELECT list(c ORDER BY n) FROM (SELECT n, list_reduce(list_prepend(n, range(0, 8)),
    lambda c, step: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS n)))"""


def _draw(name: str, weight: str = "1.0") -> str:
    return (f"-ln((('0x' || substr(md5('{name}:' || id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
            f" / {weight}")


def _least(names: list[str], level: str) -> str:
    """Position (0, 1, ...) of the smallest draw among equally weighted children."""
    return f"(list_position({(draws := '[' + ', '.join(_draw(f'{level}/{n}') for n in names) + ']')}, list_min({draws})) - 1)"


def _shard_sql() -> str:
    """The descent in the tree of 4 regions, 3 racks each, 2 shards each."""
    regions = []
    for r in range(0, 24, 6):
        racks = []
        for k in range(r, r + 6, 2):
            racks.append(f"WHEN {(k - r) // 2} THEN {k} + {_least([f's{k}', f's{k + 1}'], f'/r{r}/k{k}')}")
        regions.append(f"WHEN {r // 6} THEN CASE {_least([f'k{k}' for k in range(r, r + 6, 2)], f'/r{r}')} "
                       + " ".join(racks) + " END")
    return f"CASE {_least([f'r{r}' for r in range(0, 24, 6)], '')} " + " ".join(regions) + " END"


def _mend(k: int) -> str:
    """The k-th mend of the mix: the cell that fits best changes sides."""
    sign = "CASE WHEN k.cell < below THEN -k.words ELSE k.words END"
    return f"""swap_{k} AS (
  SELECT c.source, source_size, target, copies, below, missing, flips,
    min((abs(missing - {sign}), k.cell, {sign})) FILTER (NOT list_contains(flips, k.cell)) AS swap
  FROM {"cut" if k == 1 else f"mended_{k - 1}"} c JOIN words k ON c.source IS NOT DISTINCT FROM k.source GROUP BY ALL),
mended_{k} AS (
  SELECT source, source_size, target, copies, below,
    missing - CASE WHEN swap[1] < abs(missing) THEN swap[3] ELSE 0 END AS missing,
    CASE WHEN swap[1] < abs(missing) THEN list_append(flips, swap[2]) ELSE flips END AS flips FROM swap_{k})"""


_MENDS = ",\n".join(_mend(k) for k in range(1, mixing.MENDS + 1))

ORACLE: dict[str, str] = {
    "op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
formatted AS (
  SELECT *, '<|im_start|>' || regexp_replace(role, '([<\[\\])', '\1\\', 'g') || '<|im_sep|>'
    || regexp_replace(text, '([<\[\\])', '\1\\', 'g') || '<|im_end|>' || chr(10) AS segment FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(segment))::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id""",
    "op7_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS} AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096 AS cell FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sized GROUP BY source),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS words FROM per),
levels AS (
  SELECT *, (words * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
goal AS (
  SELECT *, round(least(cap, coalesce((SELECT min(level) FROM levels WHERE level * w < cap
    AND cap / w = (SELECT min(cap / w) FROM levels WHERE level * w < cap)) * w, cap)), 6) AS target FROM levels),
rates AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM goal),
cells AS (
  SELECT source, cell, sum(sum(size)) OVER (PARTITION BY source ORDER BY cell) AS upto FROM sized GROUP BY source, cell),
cuts AS (
  SELECT r.source, r.source_size, r.target, r.copies, min((abs(upto - (target - copies * source_size)), upto, cell + 1)) AS near
  FROM rates r JOIN cells c ON r.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
cut AS (
  SELECT source, source_size, target, copies, CASE WHEN near[1] < target - copies * source_size THEN near[3] ELSE 0 END AS below,
    target - copies * source_size - CASE WHEN near[1] < target - copies * source_size THEN near[2] ELSE 0 END AS missing, []::BIGINT[] AS flips FROM cuts),
words AS (SELECT source, cell, sum(size)::BIGINT AS words FROM sized GROUP BY source, cell),
{_MENDS}
SELECT doc_id, size, source_size, target, copies + ((cell < below) <> list_contains(flips, cell))::BIGINT AS n_copies,
  (copies + ((cell < below) <> list_contains(flips, cell))::BIGINT) * size AS taken
FROM sized s JOIN mended_{mixing.MENDS} c ON s.source IS NOT DISTINCT FROM c.source""",
    "op8_sharding": f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
crc AS (SELECT {_CRC_TABLE} AS crc_table),
placed AS (
  SELECT doc_id, id, octet_length(encode(text)) + 8 AS size, {_CRC32.format('text')} AS text_crc32,
    ({_shard_sql()})::INT AS shard,
    {_draw('/r24+')} < least({', '.join(_draw(f'/r{r}', '6.0') for r in range(0, 24, 6))}) AS moves
  FROM rows, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5('slot:' || id), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CASE WHEN moves THEN 24 ELSE shard END::INT AS grown_shard
FROM placed""",
    "op13_source_divergence": r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
held AS (SELECT lang, source, r, unnest(terms) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM held GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM held JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM texts),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every_pair
UNION ALL SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 10""",
}
