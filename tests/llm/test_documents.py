"""Document operators against brute force, exact round trips and library results."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spherion.llm import bpe, decontaminate, secrets, simhash_dedup, substring_dedup
from spherion.llm.fmindex import FmIndex

SCHEMA = "doc_id long, text string, key string, role int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def sentence(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# Secrets

ODD = ["", None, "password = hunter22x", "PassWord='abcdefgh'", "token: short", "api_key=ABCDEFGH1 apikey:12345678", "AKIA" + "A" * 16, "AKIAA", "AKIA" + "B" * 12 + "AKIAC", "a" * 31, "deadbeef" * 4, "x" + "0" * 70 + "g", "secret : passwordpassword=zzzzzzzzz", "ſecret=abcdefghij toKen=abcdefghij", "😀 passwd:" + "a" * 9, "tokentoken=abcdefgh"]


def base_spans(text):
    text = text or ""
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return [(s, e, secrets.BASE[k]) for s, k, e in sorted(out)]


def test_secrets_against_plain_expressions(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, ODD[3]), (99, "pad " * 50000 + "password=abcdefgh")]
    got = secrets.find_secrets(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        spans = base_spans(t)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
        want[i, *(sum(k == b for *_, k in spans) for b in secrets.BASE), digest] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert secrets.find_secrets(table(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "secret", "api_", "key", "AKIA", "=", ":", " ", '"', "abcdef12", "0123456789abcdef" * 2, "Z9", "é"]), max_size=14).map("".join))
def test_secret_spans(text):
    assert [s for s in secrets.scan(text) if s[2] in secrets.BASE] == base_spans(text)


def test_added_kinds_and_redaction(spark):
    body = "Zq" * 15
    import zlib

    value, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        tail = secrets.BASE62[rest] + tail
    good, bad = f"ghp_{body}{tail}", f"ghp_{body}000000"
    assert [k for *_, k in secrets.scan(good)] == ["token_crc"] and secrets.scan(bad) == []
    assert [k for *_, k in secrets.scan("card: 4111 1111 1111 1111")] == ["card"] and secrets.scan("card: 4111 1111 1111 1112") == []
    assert secrets.redact("x password=abcdefgh y") == "x [SECRET] y"
    docs = spark.createDataFrame([(1, "token=abcdefghijk", 17), (2, None, 0)], "doc_id long, text string, n_chars long")
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "[SECRET]", 8), (2, None, None)]


# BPE

@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_against_the_library(spark, reference, sf_dir):
    texts = ["", None, " \n\t", "Hello, it's 2024!", "<|startoftext|>A<|endoftext|>b <|endoftext", "ΑΣ σς İ ı", "é é", "a\x1cb\x85c", "漢字🙂🇫🇷ﬁ", "x" * 5000, "l'été d'ici"]
    rows = [*enumerate(texts), (0, ""), (None, "null id")] + [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = bpe.encode_documents(table(spark, rows), bpe.default_vocabulary()).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] for r in got)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbÉé ́Σσ'<|>0१½!?\n\x1c\x85 漢🙂"), max_size=24))
def test_bpe_odd_texts(reference, text):
    assert bpe.tokenizer(bpe.default_vocabulary()).encode(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# SimHash

def fingerprint(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [2000, 3])
def test_simhash_groups_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    r = random.Random(1)
    rows = [(1, ""), (2, None), (3, " \n"), (4, "one two"), (5, "ONE two")]
    for g in range(12):
        words = sentence(r, 120)
        for _ in range(6):
            copy = list(words)
            for _ in range(r.randrange(4)):
                copy[r.randrange(120)] = "edit"
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(1000, rows[7][1]), (1001, "y" * 200000)]
    got = simhash_dedup.simhash_groups(spark, table(spark, [*rows, (1000, rows[7][1]), (None, "one two")])).collect()
    fps = {i: fingerprint(t) for i, t in rows}
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got if r["doc_id"]} == {i: (fps[i], want[i]) for i in fps}
    assert len(got) == len(rows) + 2 and [r["component_id"] for r in got if r["doc_id"] is None] == [4]
    assert len(set(want.values())) < len(fps)
    assert simhash_dedup.simhash_groups(spark, table(spark, [])).count() == 0
    kept = simhash_dedup.drop_near_duplicates(spark, table(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == ["doc_id", "text", "key", "role"]


def test_every_near_fingerprint_is_linked(spark):
    r = random.Random(2)
    fps = {0}
    for _ in range(150):
        x = r.getrandbits(64)
        fps |= {x}
        for k in range(1, 6):
            y = x
            for b in r.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    edges = simhash_dedup.fingerprint_links(spark, spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    got = components(signed, [tuple(e) for e in edges])
    want = components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    assert got == want


# Substring dedup

def without_repeats(rows):
    words = {k: WORDS.findall(t or "") for k, (i, t) in enumerate(rows)}
    first = {}
    for k, (i, _) in enumerate(rows):
        for at in range(len(words[k]) - 12):
            w = tuple(words[k][at : at + 13])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        gone = [False] * len(words[k])
        for at in range(len(words[k]) - 12):
            if i is not None and first[tuple(words[k][at : at + 13])] < i:
                gone[at : at + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(words[k], gone) if not g)
        out[i, len(words[k]), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_substrings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    r = random.Random(3)
    passages = [sentence(r, n, 5000) for n in (12, 13, 14, 30, 80)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "one\x85two three \x0b\x0c\x1c x")]
    for i in range(60):
        words = sentence(r, r.randrange(80), 5000)
        for p in r.sample(passages, r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((r.randrange(40) + 10, r.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(200, rows[10][1]), (200, rows[10][1]), (None, rows[10][1]), (300, "z " * 60), (301, "z " * 40), (302, " ".join(sentence(r, 20000)))]
    got = substring_dedup.remove_repeats(spark, table(spark, rows)).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == without_repeats(rows)
    assert substring_dedup.remove_repeats(spark, table(spark, [])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=6, max_size=60), st.integers(1, 5))
def test_fm_index_counts(symbols, length):
    text = np.array([*symbols, 0])
    index = FmIndex(text, 5, length)
    at = np.arange(len(symbols) - length + 1)
    lo, hi = index.search(text, at, length)
    for k in at:
        want = {j for j in range(len(symbols) - length + 1) if symbols[j : j + length] == symbols[k : k + length]}
        assert set(index.suffixes[lo[k] : hi[k]].tolist()) == want


# Decontamination

def leaks(rows, items):
    split = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    out = {}
    for i, t in rows:
        words = split(t)
        for k, it in items:
            target = split(it)
            size = min(5, len(target))
            if not target:
                continue
            goal = Counter(tuple(target[j : j + size]) for j in range(len(target) - size + 1))
            m = sum(goal.values())
            own = [tuple(words[j : j + size]) for j in range(len(words) - size + 1)]
            for s in range(max(1, len(own) - m + 1)):  # a short text is its own one window
                held = own[s : s + m]
                shared = sum((Counter(held) & goal).values())
                if shared / (m + len(held) - shared) >= 0.8:
                    out[i, k] = max(out.get((i, k), 0), shared / (m + len(held) - shared))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    items = [(k, " ".join(sentence(r, n))) for k, n in enumerate((3, 5, 9, 14, 20, 45, 59))] + [(7, None), (8, "..."), (9, "la la la la la la la la la la"), (None, "null item id words here now")]
    rows = [(0, None), (1, ""), (2, "la " * 30), (None, "null item id words here now")]
    for i in range(3, 60):
        words = sentence(r, r.randrange(5, 150))
        for _, t in r.sample(items[:7], 2):
            copy = t.split()
            if r.random() < 0.5:
                copy[r.choice((0, -1, len(copy) // 2))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + r.choice(["", ",", "!"]) for w in copy]
        rows.append((i, " ".join(words)))
    docs = table(spark, [*rows, rows[5]])
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, start int")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.find_leaks(spark, docs, bench).collect()}
    want = leaks(rows, items)
    assert len(want) > 60 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 or got[k] < want[k] for k in got)
    assert decontaminate.find_leaks(spark, table(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(spark, docs, bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(spark, docs, bench)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_leaks_in_long_texts_of_long_items(spark):
    r = random.Random(9)
    items = [(k, sentence(r, n, 5000)) for k, n in enumerate((15, 300, 700))]
    rows = [(9, " ".join(sentence(r, 30000, 5000)))]
    for k, words in items:
        text = sentence(r, 12000, 5000)
        copy = list(words)
        copy[len(copy) // 2 :: 40] = ["changed"] * len(copy[len(copy) // 2 :: 40])
        text[7000:7000] = copy if k else words
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["word_start"]) for x in decontaminate.find_leaks(spark, table(spark, rows), bench).collect()}
    assert got == {(k, k, 7000) for k in range(3)}


def test_sampling_is_dense_enough():
    for m in range(1, 80):
        s = decontaminate.widest_stride([m])
        shared = int(np.ceil(1.6 * m / 1.8 - 1e-9))
        assert s == 1 or m // s > m - shared


def test_decontamination_runs_no_python(spark, sf_dir):
    plan = decontaminate.find_leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
