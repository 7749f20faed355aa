"""Vectors, pages, conversations, classifiers, components and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import differences, duck

from spherion.llm import chat_format, itq_dedup, quality, queries, toxicity, url_filter
from spherion.llm.components import connected_components
from spherion.llm.pairs import forest
from tests.llm.test_documents import components


# Components

def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    df = spark.createDataFrame([*edges, edges[0], (5, 5), (None, 7), (7, None), (-3, 400), (2**62, 400)], "x long, y long")
    got = {r["id"]: r["component"] for r in connected_components(spark, df).collect()}
    real = [e for e in [*edges, (-3, 400), (2**62, 400)] if e[0] != e[1]]
    assert got == components({v for e in real for v in e}, real)
    assert connected_components(spark, df.limit(0)).count() == 0


def test_forest():
    u, v = forest(np.array([5, 3, 9, 9]), np.array([3, 1, 8, 8]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(3, 1), (5, 1), (9, 8)]


# Embeddings

def links(rows):
    vec = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and all(np.isfinite(v)) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            vec[k] = x / np.sqrt(x @ x)
    pairs = [(a, b) for a in vec for b in vec if a < b and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] >= 0.95]
    count = Counter(k for p in pairs for k in p)
    ids = [i for i, _ in rows]
    root = components({i for i in ids if i is not None}, [(ids[a], ids[b]) for a, b in pairs if ids[a] != ids[b]])
    return pairs, count, root


@pytest.mark.parametrize("hot", [2000, 4])
def test_vectors_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(itq_dedup, "HOT", hot)
    r = np.random.default_rng(2)
    rows = [(0, None), (1, [0.0] * 64), (2, [float("nan")] + [1.0] * 63), (3, [None] + [1.0] * 63), (4, []), (5, [1.0, 2.0]), (6, [2.0, 4.0]), (7, [float("inf")] * 64)]
    for g in range(12):
        center = r.normal(size=64)
        for _ in range(8):
            rows.append((len(rows), (center + r.normal(size=64) * 0.12).astype(np.float32).tolist()))
    rows += [(500, rows[20][1]), (501, rows[20][1]), (501, rows[20][1]), (None, rows[20][1]), (502, [3 * x for x in rows[30][1]])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, code int, unit string")
    got = itq_dedup.near_duplicate_vectors(spark, df).collect()
    pairs, count, root = links(rows)
    assert len(got) == len(rows)
    found, want = sum(x["n_links"] for x in got), sum(count.values())
    assert 0.9 * want <= found <= want
    if found == want:
        assert Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == Counter((i, count[k], root.get(i)) for k, (i, _) in enumerate(rows))
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got if x["vec_id"] is not None)
    assert itq_dedup.near_duplicate_vectors(spark, df.limit(0)).count() == 0


def test_codes_are_balanced():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 64)) * np.linspace(0.1, 2, 64)
    bits = np.unpackbits(itq_dedup.codes(x, itq_dedup.learn(x, 64)).view(np.uint8).reshape(-1, 8), axis=1)
    assert np.abs(bits.mean(0) - 0.5).max() < 0.1


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1201])
def test_masks_of_many_turns(spark, n):
    rows = [(1, k, "assistant" if k % 2 else "user", f"é{k}</s>" if k % 7 == 0 else f"[ü{k}") for k in range(n)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat_format.conversation_digests(chat_format.format_conversations(df)).collect()}
    assert (got[2]["loss_chars"], got[2]["loss_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    if n:
        said = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
        assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (n, len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("dim", [1, 5, 64, 300])
def test_sketches_never_undercut_the_cosine(dim):
    r = np.random.default_rng(dim)
    x = r.normal(size=(300, dim)) * np.linspace(0.1, 2, dim) + r.normal(size=dim) * (dim % 2)
    x = np.vstack([x, x[:50] + r.normal(size=(50, dim)) * 0.05, -x[:5]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for sample in (x, x[:3], x[:0]):
        s = itq_dedup.sketches(x, itq_dedup.sketch_axes(sample, dim)).astype(np.float32)
        assert (s @ s.T + itq_dedup.SLACK >= x @ x.T).all()


# URLs

def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[: min((k for k in (path.find(c) for c in "?#") if k >= 0), default=len(path))]


def plain_rule(host, path):
    best = None
    for rule, verdict in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_urls_against_plain_rules(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "x://é.NET/es/1?y", "http://example.com/en/a#b", "http://WWW.example.com/en/", "http://notexample.com/en/", "ftp://h.net/fr/\n/x", "http://a://b/c", "http://h.org?x://y", "http://z.org/" + "a/" * 3000]
    rows = [(k, u, "h") for k, u in enumerate(odd)] + [(None, "http://casino-x.org/1", "h"), (3, "http://", "h")]
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 1)], "page_id long, bad int")
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.filter_urls(spark, pages, labels).collect()
    want = Counter((i, *plain_url(u), (plain_rule(*plain_url(u)) or (None,))[0]) for i, u, _ in rows)
    assert Counter((x["page_id"], x["host"], x["path"], x["rule"]) for x in got) == want
    assert all(x["verdict"] == plain_rule(x["host"], x["path"])[1] for x in got if x["rule"])
    assert [x["verdict"] for x in got if x["page_id"] is None] == ["allow"]
    assert url_filter.filter_urls(spark, pages.limit(0), labels).count() == 0


def test_templates_learn(spark):
    rows = [(k, f"http://h.org/spam/{k}.html", ) for k in range(60)] + [(100 + k, f"http://h.org/news/title-{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(60)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i, *_ in rows if i % 2 == 0], "page_id long, bad int")
    got = url_filter.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string"), labels, rules=()).collect()
    assert {(x["page_id"] < 60, x["verdict"], x["template"]) for x in got} == {(True, "block", "/spam/<n>.html"), (False, "allow", "/news/*")}


def plain_templates(paths):
    """path -> template for one host; ``paths`` maps a path to (pages, labelled, bad).  The tree, by recursion."""
    u = url_filter
    shape = lambda x: re.sub(r"[0-9]+", "<n>", x)
    out = {}
    smooth = lambda bad, labelled: (bad + u.PRIOR * u.PSEUDO) / (labelled + u.PSEUDO)

    def grow(own, level, node):
        rest = [p for p in own if len(parts[p]) > level]
        out.update({p: node for p in own if len(parts[p]) <= level})
        if sum(paths[p][0] for p in rest) < u.LEAST_PAGES:
            out.update({p: node + "/**" for p in rest})
            return
        values = {}
        for p in rest:
            values.setdefault(parts[p][level], []).append(p)
        sums = {v: [sum(paths[p][k] for p in ps) for k in range(3)] for v, ps in values.items()}
        pages, single = sum(x[0] for x in sums.values()), sum(x[0] == 1 for x in sums.values())
        wild = len(values) > u.FANOUT or (len(values) >= u.SINGLES and 2 * single > len(values))
        held = sorted((x[1] > 0, smooth(x[2], x[1]), v) for v, x in sums.items() if not wild or (x[0] * u.KEPT >= pages and x[0] >= u.LEAST_PAGES))
        groups = []
        for k, (known, share, v) in enumerate(held):
            if k:
                before, last, w = held[k - 1]
                error = (share * (1 - share) / (sums[v][1] + u.PSEUDO) + last * (1 - last) / (sums[w][1] + u.PSEUDO)) ** 0.5
            if not k or known != before or share - last > u.Z * error:
                groups.append([])
            groups[-1].append(v)
        names = {v: g[0] if len(g) == 1 else "{" + "|".join(sorted(g)) + "}" for g in groups for v in g}
        branches = {}
        for v, ps in values.items():
            branches.setdefault(names.get(v, "*"), []).extend(ps)
        for name, ps in branches.items():
            grow(ps, level + 1, f"{node}/{name}")

    parts = {p: [shape(x) for x in p.removeprefix("/").split("/")] for p in paths}
    grow(list(paths), 0, "")
    return out


def test_templates_against_recursion(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "DEPTH", 6)
    r = random.Random(8)
    rows, bad = [], {}
    for h in range(10):
        sections = [f"s{chr(97 + k)}" for k in range(r.randrange(2, 50))]
        for _ in range(r.randrange(5, 250)):
            path = "/".join([r.choice(sections[: r.randrange(1, len(sections) + 1)]), *(r.choice(["x", "y", str(r.randrange(99)), f"t{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}"]) for _ in range(r.randrange(5)))])
            rows.append((len(rows), f"http://h{chr(97 + h)}.org/{path}"))
            if r.random() < 0.6:
                bad[len(rows) - 1] = int(r.random() < (0.95 if path[1] < "f" else 0.02))
    rows += [(9000 + k, "http://deep.org/" + "a/" * 40 + str(k)) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {x["page_id"]: x for x in url_filter.filter_urls(spark, pages, spark.createDataFrame(list(bad.items()), "page_id long, bad int"), rules=()).collect()}
    hosts = {}
    for i, u in rows[:-6]:
        host, path = plain_url(u)
        x = hosts.setdefault(host, {}).setdefault(path, [0, 0, 0])
        hosts[host][path] = [x[0] + 1, x[1] + (i in bad), x[2] + bad.get(i, 0)]
    seen = set()
    for host, paths in hosts.items():
        templates = plain_templates(paths)
        sums = {}
        for p, t in templates.items():
            x = sums.setdefault(t, [0, 0])
            sums[t] = [x[0] + paths[p][1], x[1] + paths[p][2]]
        for i, u in rows[:-6]:
            if plain_url(u)[0] == host:
                t = templates[plain_url(u)[1]]
                verdict = "block" if (sums[t][1] + url_filter.PRIOR * url_filter.PSEUDO) / (sums[t][0] + url_filter.PSEUDO) > url_filter.PURITY else "allow"
                assert (got[i]["template"], got[i]["verdict"]) == (t, verdict), u
                seen.add((host, t, verdict))
    assert len(seen) > 50 and {v for *_, v in seen} == {"block", "allow"}
    assert {got[9000 + k]["template"] for k in range(6)} == {"/a" * 6 + "/**"}


# Conversations

def test_chat_against_sql(spark, sf_dir):
    assert differences(queries.op4_chat_formatting(spark, sf_dir), duck(sf_dir), queries.oracle_sql()["op4_chat_formatting"]) == []


def test_chat_round_trip(spark):
    r = random.Random(5)
    bits = ["</s>", "[INST]", "[/INST]", " ", "\n", "<<SYS>>", "<</SYS>>", "\\1", "\\2", "\\", "<", "[", "é😀", "ok", "<<ROLE>>", "<<:>>", "<</ROLE>>", "<s>"]
    rows = [(1, 0, None, None), (2, None, "user", "x"), (2, None, "user", "x"), (None, 1, "assistant", "null id"), (3, 1, "assistant", ""), (3, 0, "a<<:>>b", "</s>"), (4, 0, "user", "z" * 100000)]
    for c in range(10, 80):
        rows += [(c, t, r.choice(["system", "user", "assistant", "tool"]), "".join(r.choice(bits) for _ in range(r.randrange(6)))) for t in range(r.randrange(1, 6))]
    turns = spark.createDataFrame([(*x, "f") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x["conv_id"]: x for x in chat_format.conversation_digests(chat_format.format_conversations(turns)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        text = "".join(f"{role}\n{x}\n" for *_, role, x in own)
        learnt = "".join(x for *_, role, x in own if role == "assistant")
        x = got[c]
        assert (x["n_turns"], x["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (x["loss_chars"], x["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat_format.format_conversations(turns.limit(0)).count() == 0
    plan = chat_format.conversation_digests(chat_format.format_conversations(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Classifiers

DOCS = "doc_id long, text string, score string, y int"


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {x["doc_id"]: x for x in queries.op8_quality_classifier(spark, sf).collect()}
    labels = [(x["doc_id"], x["quality"]) for x in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(q, got[i]["predicted"]) for i, q in labels if got[i]["held_out"]]
    assert len(held) > 30 and np.mean([q == p for q, p in held]) >= 0.9
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(k, "good plain words here " * 9 if k % 2 else "BAD!! ### " * 30, "s", 9) for k in range(60)] + [(100, None, "s", 9), (101, "", "s", 9), (None, "x", "s", 9), (5, "twice", "s", 9), (200, "long words " * 30000, "s", 9)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (1, None), (1, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 65 and all(0 <= x["score"] <= 1 for x in got)
    right = [x["predicted"] == x["doc_id"] % 2 for x in got if x["doc_id"] is not None and x["doc_id"] < 60 and x["doc_id"] != 5]
    assert np.mean(right) == 1.0
    assert {x["score"] for x in quality.score_quality(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} >= {1, 3, 7}


def test_attention_gradient():
    r = np.random.default_rng(6)
    x, first, y = r.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1, 0, 1])
    model = quality.AttentionModel()
    loss = lambda: -np.mean(np.where(y, np.log(model.score(x, first)), np.log(1 - model.score(x, first))))
    before = loss()
    assert model.fit(x, first, y).score(x, first).shape == (3,) and loss() < before / 2


def test_toxicity(spark):
    r = random.Random(7)
    plain = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    rows, labels = [], []
    for k in range(600):
        words = plain(r.randrange(5, 200))
        if k % 8 == 0:
            for _ in range(r.randrange(1, 5)):
                words.insert(r.randrange(len(words)), r.choice(["Vile", "awful,", "nasty"]))
        rows.append((k, " ".join(words), "s", 9))
        labels.append((k, int(k % 8 == 0)))
    rows += [(1000, None, "s", 9), (1001, "", "s", 9), (None, "vile nasty", "s", 9), (1002, "w1 " * 60000 + "vile", "s", 9)]
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, known).collect()}
    assert len(got) == len(rows)
    held = [(i % 8 == 0, got[i]["predicted"] == 1) for i in range(600) if got[i]["held_out"]]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) >= 0.97
    assert got[1002]["predicted"] == 1 and got[1001]["predicted"] == 0 and got[None]["predicted"] == 1
    assert toxicity.score_toxicity(docs.limit(0), known).count() == 0
    assert {x["toxic"] for x in toxicity.score_toxicity(docs, known.limit(0)).collect()} == {0.0}


def test_toxicity_against_plain_features(spark):
    """Probabilities by plain Python from the chain's features and weights; features of a fold don't know its labels."""
    from spherion.llm.textkernel import word_hashes

    r = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        words = [f"w{r.randrange(200)}" for _ in range(r.randrange(3, 60))]
        toxic, low = k % 6 == 0, k % 5 == 0
        words += [r.choice(["Vile,", "nastyish", "nasty"]) for _ in range(3 * toxic)] + ["$$$", "junkword"] * low
        r.shuffle(words)
        rows.append((k, " ".join(words), "s", 9))
        labels.append((k, int(not low), int(toxic)))
    docs, known = spark.createDataFrame([*rows, rows[7]], DOCS), spark.createDataFrame([*labels, labels[3]], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known)
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, known).collect()}
    hashed = lambda b: int(word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    features = {int(f): k for k, f in enumerate(chain.evidence.features)}
    assert len(features) >= 3
    for i, text, *_ in rows[:80]:
        x, hits = [0.0] * chain.evidence.width, 0
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
            own = [hashed(word)] + [hashed(word[:n]) ^ n for n in toxicity.BEGINNINGS if len(word) > n]
            own = [features[f] for f in own if f in features]
            for f in own:
                x[f] = 1.0
            hits += any(chain.evidence.counted[f] for f in own)
        for k, least in enumerate(toxicity.COUNTS):
            x[len(features) + k] = float(hits >= least)
        for name, w in zip(toxicity.CHAIN, chain.links):
            p = 1 / (1 + np.exp(-(np.dot(x, w[:-1]) + w[-1])))
            assert abs(got[i][name] - p) < 1e-9
            x.append(p)
    sample = toxicity.training_sample(docs, known, 1000)
    ids = sorted(x["id"] for x in sample.collect())
    assert len(ids) == len(set(ids)) and 250 < len(ids) < 400
    from pyspark.sql import functions as F

    changed = sample.withColumn("text", F.when(F.expr("fold = 2 and toxic = 1"), F.concat("text", F.lit(" freshword"))).otherwise(F.col("text")))
    a, b = toxicity.chosen_features(sample), toxicity.chosen_features(changed)
    assert np.array_equal(a[2].features, b[2].features) and not np.array_equal(a[1].features, b[1].features)


# Pipeline

def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    """Null ids and texts, repeated rows, clashing columns and an empty table, stage by stage."""
    import corpus_pipeline

    own = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, __kept_id long, w string, root int"
    extra = (1, 0.5, 3, "w", 4)
    rows = [(*x, *extra) for x in own] + [(None, "null id here and there " * 20, "en", "s", 9, *extra), (5000, None, None, None, None, *extra), (5001, "", "en", "s", 0, *extra), (own[0][0], *own[0][1:], *extra)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= len(rows), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.near_dedup(spark, docs, sf_dir).where(f"doc_id = {own[0][0]}").count() <= 1
    assert corpus_pipeline.secret_scan(spark, docs, sf_dir).where("text is null").count() == 1
    out = corpus_pipeline.bpe(spark, docs, sf_dir)
    assert out.count() == len(rows) and out.where("n_tokens = 0").count() >= 2


def test_redaction_takes_whole_keys():
    from spherion.llm.secrets import redact

    body = ("A1b2" * 16 + "\n") * 5
    assert redact(f"x -----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}ab==\n-----END RSA PRIVATE KEY----- y") == "x [SECRET] y"
    assert redact(f"x -----BEGIN PRIVATE KEY-----\n{body}then prose, and more") == "x [SECRET]\nthen prose, and more"
    assert redact("x -----BEGIN PRIVATE KEY----- prose " * 2) == "x [SECRET] prose " * 2


def test_long_words_merge_as_short_ones(monkeypatch):
    from spherion.llm import bpe

    b, r = bpe.tokenizer(bpe.default_vocabulary()), random.Random(3)
    words = ["".join(r.choice(a) for _ in range(n)) for a in ("abcdefgh", "ab", "\u4e2d\u6587\u5b57") for n in (2, 7, 60, 190)]
    short = [b.encode_word(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [b.encode_word(w) for w in words] == short


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] and seen[1] > 0.7 * seen[0]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == seen[-1] and out.where("n_tokens > 0").count() > 0


def test_scratch_tables_are_released(spark):
    from spherion.llm.shared import release, written

    release(spark)
    table = written(spark, spark.range(3), "kept")
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert table.count() == 3 and os.path.isdir(path)
    assert release(spark) == 1 and not os.path.exists(path)
