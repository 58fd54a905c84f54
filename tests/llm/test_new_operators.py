"""Personal data, tokenizer alignment and source divergence against brute force."""
import hashlib
import os
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.llm import alignment, divergence, personal_data


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ----------------------------------------------------------------- personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and checked(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items())
                   for m in re.finditer(p, text or "") if holds(k, m[0]))
    return [f"{k}:{a}:{b}" for a, _, b, k in found]


PLANTED = [
    ("My name is Dr. Hannah Keller, call me.", "person", "Dr. Hannah Keller"),
    ("write to jane.roe [at] mail [dot] example [dot] com today", "masked_email", "jane.roe [at] mail [dot] example [dot] com"),
    ("phone (415) 555-2671, any time", "national_phone", "(415) 555-2671"),
    ("Bank account DE89 3704 0044 0532 0130 00 please", "iban", "DE89 3704 0044 0532 0130 00"),
    ("social security number 219-09-9999, kept", "ssn", "219-09-9999"),
]
NOT_PERSONAL = ["The The The The The", "version 1.2.3.4", "order 4111 1111 1111 1112", "page 219-00-9999x",
                "a plain text of words", "Martin is here. Die Alten gehen.", "987654321"]


@pytest.fixture(scope="module")
def private_docs(spark):
    rng = random.Random(5)
    pieces = ["a.b@c.de_x@y.org", "..@a.b", "x@y", "é.a@b.co é", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004",
              "4111 1111 1111 1111", "4111-1111 1111-1111 22", "+1 (415) 555-2671", "+1.", "++49 30 123456", "+4.(-)2",
              "日本🙂", "key=4111111111111111", " ", "\n", "word", "5500005555555559", "9", "10.0.0.1"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "1" * 50_000, "a" * 50_000, "@" * 2000, "1." * 20_000, "+1" * 3000, "4111 1111 1111 1111 x " * 2000]
    texts += [p[0] for p in PLANTED for _ in range(4)] + NOT_PERSONAL * 4
    texts += [f"mail person{k}@mail.example.com, ip 8.8.4.{k}, card 4111 1111 1111 1111 and +1 415 555 26{k:02}" for k in range(40)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "null id a@b.cd", "x"), (0, texts[0], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(4)


def test_personal_data_keeps_the_base_spans(private_docs):
    texts = {r.doc_id: r.text for r in private_docs.collect()}
    got = personal_data.find(private_docs).collect()
    assert len(got) == private_docs.count()
    added = defaultdict(list)
    for r in got:
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id][:200]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in BASE] == base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in BASE]
        assert r.n_added == len(spans) - len(base)
        for s in spans:
            kind, a, b = s.split(":")
            if kind not in BASE:
                added[texts[r.doc_id]].append((kind, texts[r.doc_id][int(a):int(b)]))
    for text, kind, value in PLANTED:
        assert (kind, value) in added[text], (text, added[text])
    for text in NOT_PERSONAL:
        assert not added[text], (text, added[text])


def test_personal_data_em_and_odd_tables(spark, odd_docs, no_docs):
    assert personal_data.find(no_docs).collect() == []
    assert personal_data.find(odd_docs).filter("spans = ''").count() == odd_docs.count()
    # planted reliabilities come back: 3 informative labelers of known accuracy, the others abstain
    rng = random.Random(11)
    rates = {"shape": 0.9, "gazetteer": 0.8, "edges": 0.75}
    votes = Counter()
    for _ in range(20_000):
        z = 1 if rng.random() < 0.3 else -1
        votes[tuple((z if rng.random() < rates[n] else -z) if n in rates else 0 for n in personal_data.LABELERS)] += 1
    cells = spark.createDataFrame([("card", *v, n) for v, n in votes.items()],
                                  "kind string, " + ", ".join(f"{n} int" for n in personal_data.LABELERS) + ", n long")
    got = personal_data.learn_reliability(cells, 200)
    assert abs(got.prior["card"] - 0.3) < 0.03
    for name, rate in rates.items():
        assert abs(got.rate["card"][name][1][1] - rate) < 0.04 and abs(got.rate["card"][name][0][-1] - rate) < 0.04, name
    # one step against plain Python
    step, start = personal_data.em_step(cells, personal_data.starting()), personal_data.starting()
    yes = total = 0.0
    for v, n in votes.items():
        p = [0.5, 0.5]
        for name, x in zip(personal_data.LABELERS, v):
            p = [p[c] * (start.rate["card"][name][c][x] if x else 1) for c in (0, 1)]
        yes, total = yes + n * p[1] / sum(p), total + n
    assert step.prior["card"] == pytest.approx((yes + personal_data.PSEUDO / 2) / (total + personal_data.PSEUDO))


def test_personal_data_uses_no_python_worker(spark, private_docs):
    plan = personal_data.find(private_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# --------------------------------------------------------------------- alignment
@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.Files.read())


def walk(text, tk):
    """Groups of token ids, one token at a time."""
    if not text:
        return []
    a, b = tk.encode([text])
    groups, here, i, j, at = [], ([], []), 0, 0, [0, 0]
    while i < len(a[0]) or j < len(b[0]):
        if at[0] <= at[1]:
            here[0].append(a[0][i])
            at[0] += len(tk.a_bytes[a[0][i]])
            i += 1
        else:
            here[1].append(b[0][j])
            at[1] += len(tk.b_bytes[b[0][j]])
            j += 1
        if at[0] == at[1]:
            groups.append(here)
            here = ([], [])
    return groups


def brute_alignment(rows, tk):
    held, per = Counter(), []
    for _, text in rows:
        groups = walk(text, tk)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        per.append((groups, links))
        held.update(links.keys())
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (doc, _), (groups, links) in zip(rows, per):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(n for k, n in links.items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def test_alignment_against_single_steps(spark, odd_docs, no_docs, tokenizers):
    rng = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "日本", "🙂", "</s>", "<s>", "<|endoftext|>", "<0x41>", "▁", "ﬁ", "\x00", "\t",
                "aaaa", "1234", "don't", "ß", "́", "​", "x" * 300]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a null id"), (1, texts[1]), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chars in (500, alignment.BLOCK_CHARS):
        assert rows_of(alignment.Aligned(docs, chars=chars).documents()) == brute_alignment(rows, tokenizers)
    odd = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(alignment.Aligned(odd_docs).documents()) == brute_alignment(odd, tokenizers)
    assert alignment.Aligned(no_docs).documents().collect() == []
    table = alignment.Aligned(docs).link_table().collect()
    held = Counter(k for _, t in rows for k in {(x, y) for a, b in walk(t, tokenizers) for x in a for y in b})
    assert {(r.a, r.b): r.docs for r in table} == held
    got = {r.doc_id: r.groups for r in alignment.groups(docs).collect()}
    assert got[3] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in walk(texts[3], tokenizers))


def test_alignment_tokens_are_the_files_own(tokenizers):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(os.path.join(alignment.TOKENIZERS, alignment.A_FILE))
    own.encode_special_tokens = True
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}?" for c in points[::7]] + ["<|endoftext|>x", "  a", "x  "]
    want = [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [tokenizers._a.encode_ordinary(" " + t) for t in texts] == want
    rng = random.Random(4)
    texts += ["".join(rng.choices(["a", " ", "  ", "▁", "\n", "the", "é", "日", "🙂", "<s>", "x" * 70, "\t", "\x00"], k=20)) for _ in range(2000)]
    a, b = tokenizers.encode(texts)
    for t, x, y in zip(texts, a, b):
        whole = tokenizers._b.encode(t)
        changed = b"".join(tokenizers.b_bytes[k] for k in whole) != (" " + t).encode()
        assert y == ([] if changed else whole), t
        if x:
            assert b"".join(tokenizers.a_bytes[k] for k in x) == b"".join(tokenizers.b_bytes[k] for k in y) == (" " + t).encode()


def test_large_groups_are_cut(monkeypatch):
    """Groups whose pairs exceed the chunk give the same counts."""
    class Fake:
        a_sizes = b_sizes = np.array([1, 50, 3])

        def encode(self, texts):
            return [[1, 0, 0] + [0] * 50 + [2] for _ in texts], [[2] * 17 + [1, 0, 0, 0, 0] for _ in texts]
    fake = Fake()
    whole = alignment.Batch(["a", "b"], fake).pairs(4)
    monkeypatch.setattr(alignment, "CROSS", 7)
    cut = alignment.Batch(["a", "b"], fake).pairs(4)
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]


def test_encoding_holds_no_more_than_a_part(tokenizers, monkeypatch):
    """Texts are encoded in parts, kept words are bounded in number and in size,
    with the same tokens."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", " ", "the ", "é", "日本", "x" * 40, "\n", "🙂"], k=rng.randint(0, 40))) for _ in range(300)]
    whole = alignment.Batch(texts, tokenizers)
    asked = []

    class Watched(alignment.Tokenizers):
        def encode(self, part):
            asked.append(sum(map(len, part)))
            return super().encode(part)
    for name, value in (("PART_CHARS", 500), ("CACHED_WORDS", 10**9), ("CACHED_CHARS", 2000)):
        monkeypatch.setattr(alignment, name, value)
    small = Watched(alignment.Files.read())
    held = []
    for k in range(0, 300, 20):
        alignment.Batch(texts[k:k + 20], small)
        held.append(small._chars)
    assert max(asked) <= max(500, max(map(len, texts))) and max(held) <= 2000 + 2 * 500
    parts = alignment.Batch(texts, small)
    for name in ("a", "b", "n_a", "n_b", "group_a", "group_b", "n_groups", "n_links"):
        assert getattr(whole, name).tolist() == getattr(parts, name).tolist()


def test_a_block_is_a_row_group_and_answered_by_itself(spark, tmp_path, monkeypatch):
    """Blocks aren't collected: row groups are cut, and no array of answers is gathered."""
    import glob

    import pyarrow.parquet as pq
    monkeypatch.setattr(alignment, "ROW_GROUP_BYTES", 1)
    docs = spark.createDataFrame([(k, f"some text w{k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    done = alignment.Aligned(docs, chars=60)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    files = [pq.ParquetFile(f).metadata for f in glob.glob(done.folder.removeprefix("file:") + "/blocks/part-*")]
    assert sum(f.num_rows for f in files) > 5 and all(f.num_row_groups == f.num_rows for f in files)
    out = done.documents()
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 40


# -------------------------------------------------------------------- divergence
def brute_audit(rows, min_docs):
    terms = lambda t: [x.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
                       for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        sources = [s for x, s in groups if x == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", o, -v, k) for k, (v, _, o) in enumerate(sorted(term), 1) if k <= 10]
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [1, 3])
def test_divergence_against_brute_force(spark, no_docs, min_docs, monkeypatch):
    rng = random.Random(9)
    words = ["Über", "über", "a", "B", "ab-cd", "日本", "🙂x", "z9z", "É", "ß"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(5)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", "Z", None, f"r{rng.randint(0, 4)}"]),
             " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))))
            for _ in range(150)]
    rows += [("xx", "only", "one text"), ("yy", "p", None), ("yy", "q", "123 !"), ("en", "s1", "very " * 30_000)]
    docs = spark.createDataFrame([(None, t, lang, s, "c", 1) for lang, s, t in rows],
                                 "doc_id long, text string, lang string, source string, term string, n int")
    want = brute_audit(rows, min_docs)
    assert rows_of(divergence.audit_sources(docs, min_docs)) == want
    monkeypatch.setattr(divergence, "SOURCES", 2)      # several blocks of sources and salts
    monkeypatch.setattr(divergence, "SALT_COUNTS", 100)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "CHUNK", 40)
    monkeypatch.setattr(divergence.compare, "__defaults__", (2,))
    assert rows_of(divergence.audit_sources(docs, min_docs)) == want
    empty = no_docs.withColumn("lang", F.lit("en"))
    assert divergence.audit_sources(empty).collect() == []


def test_shares_and_values_are_exact_beyond_64_bits(spark):
    cases = [(0, 1, 1), (10**13, 3 * 10**13, 10**9), (7, 0, 3), (999_999_999_999, 10**12, 1)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
    arrays = [np.array(x) for x in zip(*cases)]
    assert divergence.shares_of(*arrays).tolist() == got
    assert divergence.shares_of(*(x[[0, 2]] for x in arrays)).tolist() == [got[0], got[2]]
    pq = [(1, 1), (10**9 + 1, 1), (3, 10**9), (123_456_789, 987_654_321)]
    got = [r[0] for r in spark.createDataFrame(pq, "p long, q long").select(divergence.divergence(F.col("p"), F.col("q"))).collect()]
    assert got == [(p - q) ** 2 // (p + q) for p, q in pq]
