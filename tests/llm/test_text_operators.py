"""Operators on documents against brute force, and their defined odd cases."""
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import TEXTS
from pyspark.sql import functions as F

from rankframe.llm import decontaminate, lm, mixing, quality, secret_scan, sharding, simhash, syncmers, toxicity
from rankframe.llm.common import id_remainder, py_remainder, word_count
from rankframe.llm.components import components


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_id_remainder_and_words(odd_docs):
    for r in odd_docs.select("doc_id", "text", id_remainder("doc_id", 7).alias("m"), word_count("text").alias("n")).collect():
        assert r.m == py_remainder(r.doc_id, 7)
        assert r.n == len((r.text or "").encode().split())


# ------------------------------------------------------------- decontamination
def brute_leaks(text, items):
    """Every item whose normalised BM25 in some passage and whose overlaps reach the limits."""
    out = set()
    for part in decontaminate.parts(items):
        index = decontaminate.Index(part)
        words = decontaminate.words_of(text)
        for at, item in enumerate(part):
            best = 0
            for start in range(0, max(1, len(words) - index.stride), index.stride):
                held = set(words[start:start + 2 * index.stride])
                terms = [index.terms[w] for w in held if w in index.terms]
                best = max(best, sum(index.impacts[e][at % decontaminate.BLOCK] for t in terms
                                     for e in range(index.first[t], index.first[t + 1])
                                     if index.block_of[e] == at // decontaminate.BLOCK))
            share = []
            for p in (item.question, item.answer):
                n = min(5, len(p))
                grams = [p[i:i + n] for i in range(len(p) - n + 1)] if p else []
                have = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
                share.append(len(set(grams) & have) / len(set(grams)) if grams else 1.0)
            if best >= decontaminate.THRESHOLD - 1e-9 and min(share) >= decontaminate.OVERLAP:
                out.add(item.item_id)
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    voc = [f"v{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choices(voc, k=n))
    raw = [(i, f"{sentence(rng.randint(6, 40))}. {sentence(rng.randint(2, 9))}.") for i in range(60)]
    raw += [(100, "short"), (101, None), (102, ""), (103, raw[0][1]), (104, sentence(150))]
    texts = []
    for _ in range(60):
        parts = [sentence(rng.randint(0, 120))]
        if rng.random() < 0.7:
            words = re.split(" ", raw[rng.randrange(len(raw))][1] or "")
            if rng.random() < 0.5 and len(words) > 8:
                words[rng.randrange(len(words))] = "changed"
            parts.append(" ".join(words).upper())
        texts.append(" ".join([*parts, sentence(rng.randint(0, 120))]))
    items = spark.createDataFrame(raw, "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    got = {}
    for r in decontaminate.leaks(docs, items).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    split = [decontaminate.split_item(*r) for r in raw]
    want = {i: w for i, t in enumerate(texts) if (w := brute_leaks(t, split))}
    assert got == want and len(want) > 15
    kept = {r.doc_id for r in decontaminate.remove_leaks(docs, items).collect()}
    assert kept == {*range(60), 900, 901} - set(want)


def test_block_max_pivots_find_all():
    rng = random.Random(1)
    voc = [f"w{i}" for i in range(60)]
    for _ in range(60):
        items = [decontaminate.split_item(i, " ".join(rng.choices(voc, k=rng.randint(1, 12)))) for i in range(rng.randint(1, 40))]
        index = decontaminate.Index(items, 0.5)
        terms = np.unique(index.codes(rng.choices(voc, k=25)))
        terms = terms[terms < len(index.terms)]
        want = {at for at in range(len(items)) if sum(
            index.impacts[e][at % decontaminate.BLOCK] for t in terms for e in range(index.first[t], index.first[t + 1])
            if index.block_of[e] == at // decontaminate.BLOCK) >= 0.5 - 1e-9}
        assert set(index.candidates(terms)) == want


def test_decontamination_odd_cases(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "it was here, and then it went away again"), (None, "one"), (2, None)], "item_id long, text string")
    # an item without an id counts as well: document 5 is its text
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect()}
    assert got == {(1, 1), (9, 1), (5, None)}
    assert 5 not in {r.doc_id for r in decontaminate.remove_leaks(odd_docs, items).collect()}
    assert decontaminate.remove_leaks(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(odd_docs, items.limit(0)).count() == 0


def test_a_near_copy_is_found_whichever_sentence_was_changed(spark):
    """One word of any sentence changed, the short last one included; an answer
    that is given must still be there."""
    rng = random.Random(4)
    fresh = iter(f"v{k}" for k in range(10**6))
    items, docs = [], []
    for i in range(40):
        words = [next(fresh) for _ in range(rng.randint(50, 60))]
        cut = len(words) - rng.randint(2, 6)
        items.append((i, " ".join(words[:cut]) + ". " + " ".join(words[cut:]) + "."))
        for k, at in enumerate((0, cut // 2, cut, len(words) - 1)):
            copy = [*words[:at], "changed", *words[at + 1:]]
            docs.append((i * 10 + k, " ".join([next(fresh) for _ in range(200)] + copy + [next(fresh) for _ in range(90)])))
        docs.append((i * 10 + 9, " ".join([next(fresh) for _ in range(100)] + words[: len(words) // 2])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, asked).collect()}
    assert got == {(d, d // 10) for d, _ in docs if d % 10 != 9}
    other = asked.withColumn("answer", F.lit("another answer altogether"))
    assert decontaminate.leaks(frame, other).count() == 0


# --------------------------------------------------------------------- quality
def test_quality_finds_hidden_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 6)), rng.normal(0, 1, (900, 6)) + [3, 0, 0, 2, 0, 0]
    x = np.vstack([good, bad])
    trusted = np.zeros(len(x), dtype=bool)
    trusted[:2400] = True
    model = quality.fit(x, trusted)
    fresh_good, fresh_bad = rng.normal(0, 1, (500, 6)), rng.normal(0, 1, (500, 6)) + [3, 0, 0, 2, 0, 0]
    assert abs(model.prior - 3000 / 3900) < 0.06
    # the best possible rule finds 92.9% of the bad and 98.5% of the good ones here
    assert (model.score(fresh_good) >= 0.5).mean() > 0.96 and (model.score(fresh_bad) < 0.5).mean() > 0.90


def test_non_negative_gradient_is_the_risks_derivative():
    rng = np.random.default_rng(1)
    gp, gu, prior = rng.normal(1, 1, 7), rng.normal(0, 1, 9), 0.3
    risk = lambda p, u: (prior * np.logaddexp(0, -p).mean()
                         + max(0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()))
    grad = quality.non_negative_gradient(prior)(gp, gu)
    for k in range(16):
        step = np.zeros(16)
        step[k] = 1e-6
        slope = (risk(gp + step[:7], gu + step[7:]) - risk(gp - step[:7], gu - step[7:])) / 2e-6
        assert abs(slope - grad[k]) < 1e-6


def test_quality_odd_cases(odd_docs, no_docs, labels):
    train = toxicity.training_rows(odd_docs, labels, "quality", id_remainder("doc_id", 4) != 2)
    model = quality.learn(train)
    out = quality.scored(odd_docs.select("doc_id", "text"), model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    nobody = quality.learn(train.limit(0))
    assert {r.score for r in quality.scored(odd_docs.select("text"), nobody).collect()} == {0.5}
    assert quality.scored(no_docs.select("text"), model).count() == 0


# -------------------------------------------------------------------- toxicity
def test_folding():
    table = toxicity.Folding()
    same = ["idiot", "1d10t", "IDIOT", "ıdıоt", "ídïót", "i​d­iot", "ｉｄｉｏｔ", "іdiоt"]
    assert {toxicity.fold(t, table) for t in same} == {" idiot "}
    assert toxicity.fold("m@ron tr@$h", table).split() == ["maron", "trash"]
    assert toxicity.fold(None, table) == toxicity.fold("", table) == " "


def test_hits_boundaries_and_exceptions():
    table = toxicity.Folding()
    machine = toxicity.automaton(((" trash ", 2.0), (" vequ", 1.0)), (" trash can ",))
    weigh = lambda t: toxicity.weigh(toxicity.fold(t, table), machine)
    assert weigh("trash, trash! TR4SH") == 6 and weigh("trashy untrash") == 0
    assert weigh("the trash can of trash") == 2 and weigh("vequoir vequ unvequ") == 2
    assert toxicity.weigh(" x ", toxicity.automaton((), ())) == 0


def test_hits_against_a_naive_matcher():
    rng = random.Random(6)
    entries = ((" ab ", 1.0), (" abc", 2.0), (" b c ", 4.0), (" ca", 8.0))
    exceptions = (" ab ab ", " c abc", " b c a ")
    machine = toxicity.automaton(entries, exceptions)

    def places(text, pattern):
        return [(i, i + len(pattern)) for i in range(len(text)) if text.startswith(pattern, i)]
    for _ in range(300):
        text = " " + " ".join(rng.choice(["ab", "abc", "b", "c", "ca", "a", "abcd"]) for _ in range(rng.randint(0, 25))) + " "
        covers = [p for e in exceptions for p in places(text, e)]
        want = sum(w for e, w in entries for a, b in places(text, e) if not any(c <= a and b <= d for c, d in covers))
        assert toxicity.weigh(text, machine) == want, text
    long = " " + "ab ab abc ca " * 50_000   # hits and phrases in one pass
    started = time.time()
    assert toxicity.weigh(long, machine) > 0 and time.time() - started < 5


def test_toxicity_labels_of_equal_texts_and_few_rows(spark):
    """Equal texts count as toxic if one of them does, whatever the order; a
    word of a few toxic rows is learned, one of copies isn't."""
    rng = random.Random(7)
    plain = lambda: " ".join("".join(rng.choices("defgh", k=4)) for _ in range(30))
    rows = [(i, f"{plain()} zonkar {plain()} zonkar", 1) for i in range(5)] + [(10 + i, plain(), 0) for i in range(200)]
    copied = plain() + " vrumbel"
    rows += [(300 + i, copied + f" {i}", 1) for i in range(5)] + [(400, rows[0][1], 0), (401, rows[0][1], 0)]
    frames = [spark.createDataFrame(r, "doc_id long, text string, y int").repartition(n) for r, n in ((rows, 1), (rows[::-1], 5))]
    a, b = (toxicity.learn(f) for f in frames)
    assert a.entries == b.entries and np.allclose(a.curve, b.curve)
    learned = [p for p, w in a.entries if w != toxicity.SEED_WEIGHT]
    assert any(" zonkar ".startswith(p) for p in learned) and not any("vrum" in p for p in learned)


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["zonk", "grublix" + word()]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    copied = " ".join(word() for _ in range(40)) + " zonk"
    rows += [(1000 + i, copied + f" {i}", 1) for i in range(20)]  # copies don't teach their words
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    learned = {p for p, w in lexicon.entries if w != toxicity.SEED_WEIGHT}
    assert " zonk " in learned and any(p.startswith(" grub") and not p.endswith(" ") for p in learned)
    assert len(learned) < 6
    fresh = [("a", "abc def zonk gh ab cd z0nk"), ("b", "gruBLixaaaaa is grublixhhhhh"), ("c", "abc def gh ab cd ef")]
    got = {r.k: r.predicted for r in toxicity.scored(spark.createDataFrame(fresh, "k string, text string"), lexicon).collect()}
    assert got == {"a": 1, "b": 1, "c": 0}


def test_toxicity_odd_cases(odd_docs, no_docs, labels):
    train = toxicity.training_rows(odd_docs, labels, "toxic", id_remainder("doc_id", 3) != 1)
    lexicon = toxicity.learn(train)
    out = toxicity.scored(odd_docs.select("doc_id", "text"), lexicon).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert max(out, key=lambda r: r.score).doc_id == 10
    kept = toxicity.reject(odd_docs, lexicon)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 10").count() == 0
    assert toxicity.scored(odd_docs.select("text"), toxicity.learn(train.limit(0))).count() == len(TEXTS)
    assert toxicity.reject(no_docs, lexicon).count() == 0


# -------------------------------------------------------------------- syncmers
def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    if len(text) < k:
        return [(0, signed(xxhash.xxh64_intdigest(text.encode(), 42)))] if text else []
    order = [signed(xxhash.xxh64_intdigest(text[i:i + s].encode(), 42)) for i in range(len(text) - s + 1)]
    out = []
    for i in range(len(text) - k + 1):
        inner = order[i:i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            h = 42
            for v in inner:
                h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
            out.append((i, signed(h)))
    return out


def own_anchors(text):
    """The anchors, or the own hash of a text without any."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return brute_anchors(text) or ([(0, signed(xxhash.xxh64_intdigest(text.encode(), 42)))] if text else [])


def brute_fingerprint(found):
    return "".join(sorted({f"{(h % (1 << 64)) >> 32:08x}" for _, h in found})[:syncmers.SKETCH])


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    x, y = ({f[i:i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    union = sorted(x | y)[:syncmers.SKETCH]
    return sum(h in x and h in y for h in union) / len(union)


def test_anchors_and_edits_against_brute_force(odd_docs, spark):
    sample = [r for r in TEXTS if len(r[1] or "") < 40_000] + [(20, "ab" * 5000, "q"), (21, "x" * 16, "q"), (22, "y" * 15, "q")]
    docs = spark.createDataFrame(sample, "doc_id long, text string, source string")
    got_anchors = {}
    for r in syncmers.document_anchors(docs.filter("doc_id IS DISTINCT FROM 6")).collect():
        got_anchors.setdefault(r.doc_id, []).append((r.pos, r.hash))
    for d, t, _ in sample:
        if d != 6:
            assert sorted(got_anchors.get(d, [])) == own_anchors(t or "")
    for ranges in (1, 2, 7):
        got = Counter(tuple(r) for r in syncmers.edited_fingerprints(docs, ranges).collect())
        order = sorted(((d, t or "") for d, t, _ in sample), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
        want = Counter()
        for i, (d, t) in enumerate(order):
            after = order[(i + 1) % len(order)][1]
            half = len(t) // 2
            e = t[:len(t) - half] + after[:half]
            fps = [brute_fingerprint(own_anchors(x)) for x in (t, e, after)]
            want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), fps[0], fps[1],
                 brute_likeness(fps[0], fps[1]), brute_likeness(fps[0], fps[2])] += 1
        assert got == want


def test_syncmers_odd_cases(spark, odd_docs, no_docs):
    assert syncmers.edited_fingerprints(no_docs).count() == 0
    out = syncmers.edited_fingerprints(odd_docs).collect()
    assert len(out) == len(TEXTS) and {r.fingerprint for r in out if r.n_chars == 0} == {""}
    alone = syncmers.edited_fingerprints(spark.createDataFrame([(5, "abcdef" * 9)], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_short_texts_without_a_syncmer_keep_their_own_hash(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choices("abcdefghij klmnop", k=n)) for n in range(16, 25) for _ in range(12)]
    bare = [t for t in texts if not brute_anchors(t)]
    assert len(bare) > 15 and len(set(texts)) == len(texts)
    own = lambda t: brute_anchors(t) or [(0, xxhash.xxh64_intdigest(t.encode(), 42))]
    docs = spark.createDataFrame([*enumerate(texts), (-1, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in syncmers.edited_fingerprints(docs, 3).collect()}
    assert [d for d, r in out.items() if r.fingerprint == ""] == [-1]
    assert len({out[i].fingerprint for i in range(len(texts))}) == len(texts)
    for i, t in enumerate(texts):
        after = texts[i - 1] if i else ""
        e = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        fps = [brute_fingerprint(own(x)) if x else "" for x in (t, e, after)]
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (fps[0], fps[1])
        assert (out[i].near_edited, out[i].near_next) == (brute_likeness(fps[0], fps[1]), brute_likeness(fps[0], fps[2]))
    long = spark.createDataFrame([(2, "z" * 50), (1, bare[0])], "doc_id long, text string")
    taken = syncmers.edited_fingerprints(long).filter("doc_id = 2").first()  # takes all of a text without a syncmer
    assert taken.edited_fingerprint == brute_fingerprint(brute_anchors("z" * 25 + bare[0]))


def longest_common(t, after):
    """Length of the longest common substring, by a suffix automaton of ``t``."""
    links, moves, sizes, last = [-1], [{}], [0], 0
    for c in t:
        new, p = len(sizes), last
        sizes.append(sizes[last] + 1)
        moves.append({})
        links.append(0)
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = links[p]
        if p >= 0:
            q = moves[p][c]
            if sizes[q] == sizes[p] + 1:
                links[new] = q
            else:
                copy = len(sizes)
                sizes.append(sizes[p] + 1)
                moves.append(dict(moves[q]))
                links.append(links[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    best = at = size = 0
    for c in after:
        while at and c not in moves[at]:
            at = links[at]
            size = sizes[at]
        if c in moves[at]:
            at, size = moves[at][c], size + 1
        best = max(best, size)
    return best


def test_passages_are_common_substrings(spark):
    rng = random.Random(15)
    part = lambda n=300: "".join(rng.choices("abcdefghijklmnop qrstuvw", k=n))
    x, y, z, junk = (part() for _ in range(4))
    pairs = [(x + y + z, x + y + junk + y + z), (x + y, junk + y + x), (x, y), (x + junk + x, x), (part(30) + x + part(30), part(90) + x),
             (x + "\U0001f642" + y, x + "\U0001f600" + y), (x * 5, x * 3), (part(20), part(20)), ("", x),
             (x[:24], junk + x[:24] + z), (x + y, x[:150] + "#" + x[151:] + y)]
    pairs += [(part(rng.randint(0, 200)) + (s := part(rng.randint(25, 120))) + part(50), part(rng.randint(0, 90)) + s + part(9)) for _ in range(60)]
    docs = spark.createDataFrame(pairs, "a string, b string")
    found = docs.select("a", "b", syncmers.passage(syncmers.chosen_anchors(F.col("a")), syncmers.chosen_anchors(F.col("b"))).alias("n"))
    slack = 2 * (syncmers.K - syncmers.S - 1)
    for r in found.collect():
        true = longest_common(r.a, r.b)
        assert r.n <= true and (r.n >= true - slack or true < 25), (r.n, true, r.a[:40], r.b[:40])


def test_passages_in_long_texts_are_matched_by_position(spark):
    rng = random.Random(14)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    shared, x = words(60), words(4000)
    texts = [f"{words(5000)} {shared} {words(3000)}", f"{words(2500)} {shared} {words(4000)}", words(900), x, x, "", "ab" * 300,
             "ab" * 200, "short one", x[500:9000] + words(9) + x[9100:15000], x, words(40) + x[300:340] + words(40), x]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {100 - r.doc_id: r for r in syncmers.edited_fingerprints(docs, 3, passages=True).collect()}
    slack = 2 * (syncmers.K - syncmers.S - 1)
    for i, t in enumerate(texts):
        true = longest_common(t, texts[(i + 1) % len(texts)])
        assert out[i].passage_next <= true and (out[i].passage_next >= true - slack or true < 25)
    assert out[0].near_next < 0.05 and len(shared) - slack <= out[0].passage_next <= len(shared) + 2
    assert out[3].passage_next == len(x) and out[9].passage_next > 8400 and out[10].passage_next >= 16 and out[1].passage_next == 0


# --------------------------------------------------------------------- simhash
def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(fps, radius=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, x in enumerate(fps):
        for y in fps[i + 1:]:
            if ((x ^ y) & (2 ** 64 - 1)).bit_count() <= radius:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {f: find(f) for f in fps}


def test_simhash_fingerprints():
    for _, t, _ in TEXTS:
        if len(t or "") < 40_000:
            assert simhash.simhash(t) % (1 << 64) == brute_simhash(t)


def test_covering_masks_cover():
    rng = random.Random(2)
    full = (1 << 64) - 1
    for free in (full, full & ~0xFFFF0000FFFF, 0b1011011, 0b11111, 0):
        bits = [i for i in range(64) if free >> i & 1]
        masks = [m & full for m in simhash.covering_masks(4, free)]
        assert len(bits) < 5 or all(masks)  # progress in every cut
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(bits, min(4, len(bits))))
            assert any(m & diff == 0 for m in masks)


def test_links_join_all_within_radius(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                f ^= 1 << b
            fps.add(f - (1 << 64) if f >> 63 else f)
    dense = rng.getrandbits(62)
    fps |= {dense ^ x for x in range(300)}  # one bucket beyond the smallest bound in many tables
    fps.add(0)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (128, 2048):
        found = simhash.links(df, 4, bucket)
        assert found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
        roots = {r.node: r.root for r in components(found).collect()}
        want = brute_components(fps)
        smallest = {}
        for f, r in want.items():
            smallest[r] = min(f, smallest.get(r, f))
        assert {f: roots.get(f, f) for f in fps} == {f: smallest[r] for f, r in want.items()}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (1000, 1001), (1001, 1002), (1000, 1002)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400, 1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd_cases(odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(out) == len(TEXTS) and by[9] == {1} and by[2] == by[3] == by[4] == {2} and by[6] == {6}
    kept = simhash.keep_first(odd_docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd_docs.columns and ids[1] == ids[2] == ids[6] == 1 and not {3, 4, 9} & set(ids)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_components_of_one_name_each_keep_a_row(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (8, e), (None, None), (None, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text or "") for r in kept) == Counter(
        [(None, a), (None, b), (None, c), (7, d), (7, e), (None, "")])


# ---------------------------------------------------------------------- mixing
def brute_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Shares by weight, the excess over the limits shared again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap, left, open_ = {s: limit * n for s, n in sizes.items()}, share * sum(sizes.values()), set(sizes)
    got = dict.fromkeys(sizes, 0.0)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        part = {s: got[s] + left * w[s] / total for s in open_}
        left = sum(max(0, part[s] - cap[s]) for s in open_)
        got |= {s: min(part[s], cap[s]) for s in open_}
        open_ = {s for s in open_ if part[s] < cap[s]}
    return got


def test_targets_by_repeated_sharing(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i}": rng.choice([0, 1, 10, rng.randint(1, 5000)]) for i in range(n)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-3 for s in want)


def test_mix_takes_the_targets(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice("aabc") if i % 9 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in "a", "b", "c", None:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target + 1
        assert all(r.taken <= 2 * r.size and r.taken == r.size * r.n_copies for r in own)
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r)[:6] for r in out)
    copies = Counter(r.doc_id for r in mixing.emit(docs).collect())
    assert copies == Counter({r.doc_id: r.n_copies for r in out if r.n_copies})
    assert mixing.emit(odd_docs).columns == odd_docs.columns
    assert mixing.mix(odd_docs).count() == len(TEXTS) and mixing.mix(no_docs).count() == 0


# -------------------------------------------------------------------- sharding
def test_shards_slots_and_growth(spark, odd_docs, no_docs):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = sharding.shard_documents(docs).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.size == 8 + len(str(r.doc_id))
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 60 < sum(r.grown_shard == 24 for r in out) < 190
    assert all(80 < len(s) < 175 for s in slots.values())
    odd = sharding.shard_documents(odd_docs).collect()
    assert len(odd) == len(TEXTS) and {r.text_crc32 for r in odd if r.doc_id in (2, 3)} == {0}
    assert len({(r.shard, r.slot) for r in odd}) == len(TEXTS)
    full = sharding.shard_rows(odd_docs)
    assert set(odd_docs.columns) <= set(full.columns) and full.count() == len(TEXTS)
    assert sharding.shard_documents(no_docs).count() == 0


def test_movement_stays_in_the_changed_subtree(spark):
    before, after = sharding.tree(24), sharding.tree(24, weights={4: 3.0})  # region 0, rack 2
    df = spark.range(4000).select(sharding.shard_of("id", before).alias("a"), sharding.shard_of("id", after).alias("b"))
    moved = [(r.a, r.b) for r in df.collect() if r.a != r.b]
    assert moved and all(b < 6 for a, b in moved)          # only into the changed region
    inside = [(a, b) for a, b in moved if a < 6]
    assert all(b in (4, 5) for a, b in inside)             # and there only into the changed rack
    assert all(b == 4 for a, b in inside if a in (4, 5))   # and there only into the shard itself


def test_weights_are_followed(spark):
    tree = sharding.tree(3, weights={0: 1.0, 1: 2.0, 2: 0.0})
    n = Counter(r.s for r in spark.range(6000).select(sharding.shard_of("id", tree).alias("s")).collect())
    assert n[2] == 0 and abs(n[1] / 6000 - 2 / 3) < 0.03


# --------------------------------------------------------------------- secrets
def brute_base(text):
    """The contract's base spans, written with plain scanning."""
    out = []
    pattern = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                         r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for kind, rank, p, ok in (("assign", 0, pattern, lambda m: len(m[2]) >= 6),
                              ("access", 1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
                              ("hex", 2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(text) if ok(m)]
    return [s for *_, s in sorted(out)]


def test_secret_spans_and_ownership(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(6)]
    key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
    rows = [
        (1, f"é🙂 password = \"{hexes[0]}\" and token: short API_KEY='{key}'", "o1"),
        (2, f"TOKEN={hexes[1]} {hexes[1]}", "o1"), (3, f"tokeN {hexes[1]}", "o1"),
        (4, f"secret={hexes[2]}", "o1"), (5, f"x {hexes[2]}", "o2"), (6, f"{hexes[2]}", None),
        (7, "password: changeme123456789", "o3"), (8, "ſecret=abcdefgh paſſword=abcdefgh toKen=abcdefgh", "o3"),
        (9, None, "o3"), (10, "", None), (None, f"secret = {hexes[3]}", "o4"), (11, "password=token=abcdef", "o5"),
        (12, f"secret={hexes[4]}", "o1"), (13, f"secret={hexes[4]}", "o2"),
    ]
    out = {r.doc_id: r for r in secret_scan.scan_documents(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(out) == len(rows)
    for d, t, _ in rows:
        base = brute_base(t or "")
        kinds = Counter(s.split(":")[0] for s in base)
        assert (out[d].n_assign, out[d].n_access, out[d].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert out[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(out[d].spans.split(",")) | {""}
    live = lambda d: out[d].n_live
    assert (live(1), live(2), live(3), live(None)) == (2, 2, 1, 1)      # one owner each
    assert all(out[d].n_copied == 1 and live(d) == 0 for d in (4, 5, 6))  # three owners
    assert live(7) == 0 and out[7].n_plain == 1                           # a placeholder
    assert all((live(d), out[d].n_shared, out[d].most_owners) == (0, 1, 2) for d in (12, 13))  # two owners
    assert (out[4].most_owners, out[4].most_repositories, out[10].most_owners) == (3, 3, 0)
    f = secret_scan.ownership(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    counts = {r.hash: (r.repositories, r.owners) for r in f.collect()}
    assert counts[hashlib.sha256(hexes[1].encode()).hexdigest()] == (2, 1)
    assert counts[hashlib.sha256(hexes[2].encode()).hexdigest()] == (3, 3)


def test_kinds_follow_both_counts(spark):
    """Owners and repositories of random values against plain counting."""
    rng = random.Random(16)
    values = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(40)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = [(i, f"x {rng.choice(values[:k + 1])} y secret={rng.choice(values)}", f"o{min(rng.randint(0, k), 3)}")
            for k in range(40) for i in range(100 * k, 100 * k + rng.choice([1, 2, 14]))]
    out = secret_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    held = {v: ({o for _, t, o in rows if v in t}, {d for d, t, _ in rows if v in t}) for v in values}
    text = {d: t for d, t, _ in rows}
    seen = set()
    for r in out:
        spans = {s.split(":")[0]: s for s in r.spans.split(",")}
        for v in {v for v in values if v in text[r.doc_id]}:
            owners, repositories = held[v]
            random_looking = secret_scan.looks_random(v)
            want = ("copied" if len(owners) >= 3 or len(repositories) >= 10 else "plain" if not random_looking
                    else "live" if len(owners) == 1 else "shared")
            seen.add(want)
            at = text[r.doc_id].index(v)
            assert (f"{want}:{at}:{at + len(v)}" in r.spans.split(",")) == (want != "plain"), (v, want, r.spans)
        assert r.most_repositories == max(len(held[v][1]) for v in values if v in text[r.doc_id]), spans
    assert seen >= {"copied", "live", "shared"}


def test_long_tokens_in_one_pass():
    text = " ".join(f"{'xy1' * 12}{i}" if i % 2 else f"secret={'xy1' * 12}{i}" for i in range(30_000))
    started = time.time()
    covered = [(a, b) for a, b, *_ in secret_scan.base_spans(text)]
    got = secret_scan.token_spans(text, covered)
    assert time.time() - started < 5 and len(got) == 15_000
    rng = random.Random(17)
    for _ in range(100):
        short = "".join(rng.choice(["a1" * 20, " ", "x", "b2" * 17]) for _ in range(12))
        some = [(a, a + rng.randint(1, 60)) for a in rng.sample(range(200), 4)]
        assert secret_scan.token_spans(short, some) == [
            m.span() for m in secret_scan.TOKEN.finditer(short) if not any(a < m.end() and m.start() < b for a, b in some)
            and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]


def test_secrets_odd_cases(odd_docs, no_docs):
    assert secret_scan.scan_documents(odd_docs).count() == len(TEXTS)
    assert secret_scan.scan_documents(no_docs).count() == 0


# -------------------------------------------------------------------------- lm
def test_packing_round_trips():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
        counts = rng.integers(0, 1 << 40, n)
        assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()


def test_scores_against_brute_force(spark, odd_docs):
    rng = random.Random(7)
    voc = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(voc, weights=range(80, 0, -1), k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(d, t) for d, t, _ in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in rows]
    c1, c2 = Counter(), Counter()
    for d, ts in tokens:
        if py_remainder(d, 7) != 2:
            c1.update(ts)
            c2.update(zip([b"\n", *ts], ts))
    n, v = sum(c1.values()), len(c1)
    model, _ = lm.fit(lm.dealt(docs, id_remainder("doc_id", 7) != 2, 16), 16)
    assert (model.tokens, model.types) == (n, v)
    assert np.allclose(model.weights.sum(axis=1), 1) and model.weights[0, 0] == 0
    want = Counter()
    for d, ts in tokens:
        base = sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in ts)
        score = 0.0
        for h, w in zip([b"\n", *ts], ts):
            ch = c1[h]
            a, b, c = model.weights[min(1 + int(math.log2(ch)), lm.BUCKETS - 1) if ch else 0]
            score += math.log10(a * (c2[h, w] / ch if ch else 0) + b * c1[w] / n + c / (v + 1))
        want[d, py_remainder(d, 7) == 2, len(ts), sum(c1[w] > 0 for w in ts), n, round(base, 5), round(score, 5)] += 1
    got = Counter((*tuple(r)[:5], round(r.base_score, 5), round(r.score, 5)) for r in lm.score_documents(docs).collect())
    assert got == want


def test_mixture_weights_maximise_the_likelihood():
    """Expectation-maximisation against a grid search on one bucket."""
    p2, p1, types = np.array([0.5, 0.0, 0.25]), np.array([0.125, 0.5, 0.0]), 15
    counts = np.array([50.0, 30.0, 20.0])
    cells = lm._cells(np.full(3, 4), p2, p1)
    w = lm.learn_weights(cells, counts, types)[4]
    like = lambda a, b: (counts * np.log(a * p2 + b * p1 + (1 - a - b) / (types + 1) + 1e-12)).sum()
    best = max(like(a, b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101))
    assert like(w[0], w[1]) >= best - 1e-3


def test_probabilities_sum_to_at_most_one():
    """Over all types and one unseen one, after a seen context."""
    p2, p1, w, types = np.array([0.5, 0.5, 0, 0]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), 4
    assert abs((w[0] * p2 + w[1] * p1 + w[2] / (types + 1)).sum() + w[2] / (types + 1) - 1) < 1e-12


def test_lm_odd_cases(odd_docs, no_docs):
    out = lm.score_documents(odd_docs).collect()
    assert len(out) == len(TEXTS) and all(r.score <= 0 and math.isfinite(r.score) for r in out)
    assert lm.score_documents(no_docs).count() == 0
    nobody = lm.score_documents(odd_docs, F.lit(False)).collect()
    assert {r.train_tokens for r in nobody} == {0} and all(math.isfinite(r.score) for r in nobody)


@pytest.mark.parametrize("module", [chat_module for chat_module in (decontaminate, lm, mixing, quality, secret_scan,
                                                                    sharding, simhash, syncmers, toxicity)])
def test_docstrings_state_the_defined_cases(module):
    assert "Defined cases" in module.__doc__
