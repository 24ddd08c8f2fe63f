"""The llm operators against brute force on small tables, and on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tarnbook.llm import decontaminate, fingerprint, graph, langid, mixing, ngram, quality, queries, rlz, segments, simhash, suffix, urls
from tarnbook.session import cut_lineage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, thash string, word string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, "x", "y", "z", "w") for i, t, lang, s in rows], SCHEMA).repartition(3)


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice("the of and Café rain über stone river cloud field maß señor walk light north train blue small".split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 20 + 7 * i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(30)]
    out += [(100, None, "en", "s0"), (101, "", None, None), (102, " \n\t ", "de", "s1"), (103, "word", "en", None), (104, "12 34", "en", "s1")]
    out += [(105, out[5][1], "en", "s0"), (106, out[5][1] + " end", "en", "s2"), (107, out[8][1], "de", "s0"), (108, "a" * 3000, "en", "s1")]
    out += [(109, prose(9, 60) + "\n" + prose(9, 60), "en", "s2"), (110, "ab cd " * 400, "en", "s0"), (111, "AB CD " * 60, "en", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [(1, "x", "en", "s")]).limit(0)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated ids and repeated rows."""
    return table(spark, [(None, prose(1, 80), "en", "s"), (None, None, None, None), (1, prose(1, 80), "en", "s"), (1, prose(1, 80), "en", "s"), (1, "other", "en", "t"), (2, "", "de", "s")])


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(3)
    links = {tuple(sorted(draw.sample(range(200), 2))) for _ in range(150)} | {(i, i + 1) for i in range(300, 340)}
    want = components_of({n for link in links for n in link}, links)
    got = graph.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def simhash_of(text, width=3):
    words = low(text or "").encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: simhash_of(t) for i, t, *_ in rows}
    assert {i: r["bits"] % (1 << 64) for i, r in got.items()} == prints
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == components_of(prints, links)


@pytest.mark.parametrize("budget", [0, 1, 3, 7])
def test_trie_links(spark, budget):
    draw = random.Random(budget)
    base = [draw.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(4):
            prints.add(b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 9))))
    prints = sorted(prints)
    want = {tuple(sorted((a - (a >> 63 << 64), b - (b >> 63 << 64)))) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin(a ^ b).count("1") <= budget}
    frame = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "bits long")
    assert {(r["a"], r["b"]) for r in simhash.trie_links(frame, budget).collect()} == want


def jaccard(a, b):
    a, b = (collections.Counter(low(x).split()) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    text = {i: t or "" for i, t, *_ in rows}
    ids = sorted(text)
    errors = []
    for i, k in zip(ids, ids[1:] + ids[:1]):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[k][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text[i])
        errors += [got[i]["near_edited"] - jaccard(text[i], edited)] if text[i].strip() else []
    assert np.mean(np.abs(errors)) < 0.15
    by_text = collections.defaultdict(set)
    for i in ids:
        by_text[text[i]].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert got[100]["fingerprint"] == got[101]["fingerprint"] == got[102]["fingerprint"] == "0000" * fingerprint.BINS * fingerprint.SAMPLES
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}


def test_likeness_is_weighted_jaccard(spark):
    """The collision rate of many samples comes near the generalised Jaccard similarity."""
    a = {k: 1 + k % 7 for k in range(300)}
    b = {k: 1 + (k * 3) % 5 for k in range(100, 400)}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(400)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(400))
    terms = [(d, k) for d, w in (("a", a), ("b", b)) for k, n in w.items() for _ in range(n)]
    frame = spark.createDataFrame(terms, "doc string, term long")
    found = {r["doc"]: r["signature"] for r in fingerprint.signatures(frame, ["doc"], 32, 16).collect()}
    got = spark.createDataFrame([(found["a"], found["b"])], "a string, b string").select(fingerprint.likeness("a", "b", 32, 16)).first()[0]
    assert abs(got - want) < 0.08


@pytest.mark.parametrize("often, own, shared", [(1000, 63, 0), (300, 200, 50), (5000, 20, 5)])
def test_likeness_of_skewed_weights(spark, often, own, shared):
    """A word that makes up most of a text counts by its weight, pair by pair, at the settings of the query."""
    texts, pairs, want = [], [], (often + shared) / (often + shared + 2 * own)
    for i in range(8):
        words = [f"often{i} " * often + " ".join(f"s{i}x{k}" for k in range(shared)) + " " + " ".join(f"{side}{i}x{k}" for k in range(own)) for side in "ab"]
        texts += [(2 * i, words[0], "en", "s"), (2 * i + 1, words[1], "en", "s")]
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(table(spark, texts)).collect()}
    pairs = [(found[2 * i], found[2 * i + 1]) for i in range(8)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(fingerprint.likeness("a", "b")).collect()]
    assert max(abs(g - want) for g in got) < 0.16 and abs(np.mean(got) - want) < 0.06


def shares(size, weights=(3, 1, 2), factor=1.5, most=2):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = set(), factor * sum(size.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(most * size[s] for s in fixed)
        over = [s for s in rest if left * weight[s] / sum(weight[r] for r in rest) >= most * size[s]]
        if not over:
            return {s: most * size[s] if s in fixed else left * weight[s] / sum(weight[r] for r in rest) for s in names}
        fixed |= set(over)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_mixing(docs, rows, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    got = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    by_source = collections.Counter()
    for i, _, _, s in rows:
        by_source[s] += size[i]
    want = shares(by_source)
    taken = collections.Counter()
    for i, _, _, s in rows:
        assert got[i]["size"] == size[i] and got[i]["source_size"] == by_source[s] and math.isclose(got[i]["target"], want[s])
        assert 0 <= got[i]["taken"] <= 2 * size[i]
        taken[s] += got[i]["taken"]
    assert sum(taken.values()) == round(1.5 * sum(size.values()))
    assert all(abs(taken[s] - want[s]) <= 2 * max(size.values()) for s in want)
    assert {r["doc_id"]: r["taken"] for r in mixing.mixed(docs.repartition(5)).collect()} == {i: r["taken"] for i, r in got.items()}


@pytest.mark.parametrize("most", [1 << 22, 5, 0])
def test_scoring(docs, rows, most):
    got = {r["doc_id"]: r for r in ngram.scored(docs, most=most).collect()}
    tokens = {i: WORD.findall(low(t or "")) + [None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i, ts in tokens.items() if not held[i] for w in ts)
    n, kinds = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(c[w] > 0 for w in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in ts), rel_tol=1e-9)
        assert r["score"] < 0
    if most:
        same = {r["doc_id"]: r["score"] for r in ngram.scored(docs).collect()}
        assert all(math.isclose(same[i], r["score"], rel_tol=1e-9) for i, r in got.items())


def test_next_token_probabilities_sum_to_one():
    weights = ngram.learn_weights([(0, 5, 0.0, 0.1), (3, 10, 0.4, 0.01), (3, 4, 0.0, 0.2)], 4)
    counts = np.array([4, 3, 2, 1, 0])  # four words and the unknown one
    after = np.array([2, 3, 0, 0, 0])
    for c1, c12 in ((5, after), (0, 0 * after)):
        p = 10 ** ngram._log_probability(c12, np.full(5, c1), counts, weights, 10, 4)
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("hot", [1 << 15, 2])
def test_relative_parsing(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(segments, "HOT_WINDOWS", hot)
    got = {r["doc_id"]: r for r in rlz.removal_report(rlz.duplicate_factors(docs, width=12), 12).collect()}
    first = {}
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - 11):
            first.setdefault(tuple(words[i][j : j + 12]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 11):
            if first[tuple(w[j : j + 12])] < i:
                gone[j : j + 12] = [True] * 12
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def repeated_bytes(texts, width, keep):
    seen = collections.defaultdict(list)
    for i in sorted(texts):
        for j in range(len(texts[i]) - width + 1):
            seen[texts[i][j : j + width]].append((i, j))
    out = {}
    for i, raw in texts.items():
        gone = bytearray(len(raw))
        for j in range(len(raw) - width + 1):
            where = seen[raw[j : j + width]]
            if len(where) > 1 and (keep == "none" or where[0] != (i, j)):
                gone[j : j + width] = b"\x01" * width
        out[i] = gone
    return out


@pytest.mark.parametrize("hot", [1 << 15, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup(docs, rows, hot, keep, monkeypatch):
    monkeypatch.setattr(segments, "HOT_WINDOWS", hot)
    got = {r["doc_id"]: r for r in suffix.removal_report(suffix.duplicate_spans(docs, width=40, keep=keep), 40).collect()}
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for i, gone in repeated_bytes(texts, 40, keep).items():
        kept = bytes(c for c, g in zip(texts[i], gone) if not g)
        want = (len(texts[i]), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


@pytest.mark.parametrize("hot", [1 << 15, 20])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup_of_a_hot_passage(spark, hot, keep, monkeypatch):
    """One passage in every text, at other places and cut, and runs of one letter: the hot keys are cut again and again."""
    monkeypatch.setattr(segments, "HOT_WINDOWS", hot)
    rng = random.Random(7)

    def prose(n):
        return "".join(rng.choice("abcdefghi é") for _ in range(n))

    passage = prose(500)
    texts = {i: prose(rng.randint(0, 300)) + passage[rng.choice((0, 0, 60)) :] + prose(rng.randint(0, 300)) for i in range(40)}
    texts |= {100: "z" * 900, 101: prose(50) + "z" * 450 + prose(50), 102: passage + passage, 103: passage[:259], 104: passage[:238]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.removal_report(suffix.duplicate_spans(docs, width=240, keep=keep), 240).collect()}
    raw = {i: t.encode() for i, t in texts.items()}
    for i, gone in repeated_bytes(raw, 240, keep).items():
        kept = bytes(c for c, g in zip(raw[i], gone) if not g)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest()), i


def test_relative_parsing_of_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(segments, "HOT_WINDOWS", 20)
    rng = random.Random(8)

    def prose(n):
        return [rng.choice("the of a lake river brook pond north".split()) + str(rng.randint(0, 3)) for _ in range(n)]

    passage = prose(120)
    texts = {i: prose(rng.randint(0, 80)) + passage[rng.choice((0, 20)) :] + prose(rng.randint(0, 80)) for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in rlz.removal_report(rlz.duplicate_factors(docs)).collect()}
    first = {}
    for i, t in texts.items():
        for j in range(len(t) - 49):
            first.setdefault(tuple(t[j : j + 50]), i)
    for i, t in texts.items():
        gone = set()
        for j in range(len(t) - 49):
            if first[tuple(t[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        assert got[i] == len(gone), i


@pytest.mark.parametrize("hot", [1 << 15, 20])
def test_the_first_copy_stays_though_its_row_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(segments, "HOT_WINDOWS", hot)
    rng = random.Random(1)
    passage, *ends = ("".join(rng.choice("abcdefghij") for _ in range(n)) for n in (60, 50, 50, 50, 50))
    first = (1, ends[0] + passage + ends[1])
    docs = spark.createDataFrame([first, first, (2, ends[2] + passage + ends[3])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix.removal_report(suffix.duplicate_spans(docs, width=40, keep="first"), 40).collect())
    assert got == [(1, 0), (1, 0), (2, 60)]


@pytest.mark.parametrize("block", [1 << 18, 100])
def test_hot_windows_make_no_rows_of_their_own(spark, block, monkeypatch):
    """Near copies: every text has the passage with another letter changed.  Rows follow the texts, not the windows."""
    monkeypatch.setattr(segments, "HOT_WINDOWS", 20)
    monkeypatch.setattr(segments, "BLOCK_WINDOWS", block, raising=False)
    stored = []

    def counted(df, *args):
        kept = cut_lineage(df, *args)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(segments, "cut_lineage", counted)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghi ") for _ in range(900))
    texts = {i: passage[: 20 * i] + "Z" + passage[20 * i + 1 :] for i in range(1, 41)} | {None: passage[100:700]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    raw = {-1 if i is None else i: t.encode() for i, t in texts.items()}
    for keep in ("none", "first"):
        got = {r["doc_id"]: r["n_removed"] for r in suffix.removal_report(suffix.duplicate_spans(docs, width=240, keep=keep), 240).collect()}
        for i, gone in repeated_bytes(raw, 240, keep).items():
            assert got[None if i < 0 else i] == sum(gone), i
    # About 240 windows of each text hold its letter; in the old way each of them was a row.
    assert max(stored) < 40 * 60


@pytest.mark.parametrize("keep", ["smaller", "none", "first"])
def test_segments_that_stand_once_are_stored_once(spark, keep, monkeypatch):
    """Of texts of which two share a passage, little is stored or shuffled after the segments; the texts are shuffled once."""
    stored = []

    def counted(df, *args):
        kept = cut_lineage(df, *args)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(segments, "cut_lineage", counted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(11)
        words = {i: [f"w{rng.randint(0, 10**9)}" for _ in range(300)] for i in range(40)}
        words[30][100:180] = words[20][50:130]
        words[35][7:70] = words[20][60:123]
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
        docs = cut_lineage(docs)
        if keep == "smaller":
            out = rlz.removal_report(rlz.duplicate_factors(docs))
            got = {r["doc_id"]: r["n_removed"] for r in out.collect()}
            assert {i: n for i, n in got.items() if n} == {30: 80, 35: 63}
        else:
            out = suffix.removal_report(suffix.duplicate_spans(docs, width=240, keep=keep), 240)
            got = {r["doc_id"]: r["n_removed"] for r in out.collect()}
            raw = {i: " ".join(w).encode() for i, w in words.items()}
            assert got == {i: sum(gone) for i, gone in repeated_bytes(raw, 240, keep).items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # The segments themselves are stored first; before, their classes were as many again.
    assert max(stored[1:]) < stored[0] / 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_suffix_ranks_are_in_suffix_order():
    data = np.frombuffer(b"mississippi banana mississippi", dtype=np.uint8)
    rank = suffix.suffix_ranks(data, 12)
    heads = [bytes(data[i : i + 12]) for i in range(len(data))]
    for i in range(len(data)):
        for j in range(len(data)):
            assert (rank[i] < rank[j]) == (heads[i] < heads[j])


def test_quality(spark, docs):
    good = [(i, prose(i, 40), "en", "s") for i in range(200)]
    bad = [(i, " ".join(f"{w}%%%" for w in prose(i, 40).split()).upper(), "en", "s") for i in range(200, 300)]
    frame = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(frame, labels).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == int(r["doc_id"] < 200) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    same = {r["doc_id"]: r["score"] for r in quality.judged(frame, labels).collect()}
    assert same == {i: r["score"] for i, r in got.items()}


def test_pairs_in_linear_time():
    draw = np.random.default_rng(1)
    m = quality.Machine(0.3, draw.normal(size=20), draw.normal(size=(20, quality.FACTORS)))
    ids, values = np.array([2, 5, 7, 11, 0, 3]), draw.normal(size=6)
    got, _ = m.logits(np.array([0, 4, 6]), ids, values)
    for r, (a, b) in enumerate(((0, 4), (4, 6))):
        want = m.bias + sum(m.weights[i] * v for i, v in zip(ids[a:b], values[a:b]))
        want += sum(m.factors[ids[i]] @ m.factors[ids[j]] * values[i] * values[j] for i in range(a, b) for j in range(i + 1, b))
        assert math.isclose(got[r], want)


def test_urls(spark):
    rows = ["https://a.net/x", "https://www.example.net/en/7", "https://Example.COM/de/1?q", "http://x.org/fr/", "http://x.org/FR/", "http://net/", "http://b.net", None, "no scheme", "http://cheap-pills.example.com/en/1", "http://museum.example.com/en/1#a?b", "http://h.org?x=/fr/", "://h/p"]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    want = [("a.net", "/x", "net/", "block"), ("www.example.net", "/en/7", "example.net/en/", "allow"), ("example.com", "/de/1", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"), ("x.org", "/FR/", None, None), ("net", "/", "net/", "block"), ("b.net", "", None, None), ("", "", None, None), ("", "", None, None), ("cheap-pills.example.com", "/en/1", None, "block"), ("museum.example.com", "/en/1", None, "allow"), ("h.org", "", None, None), ("h", "/p", None, None)]
    for i, (host, path, rule, verdict) in enumerate(want):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), rows[i]
        assert got[i]["verdict"] == verdict or verdict is None
    held = [("https://www.free-casino-bets.example.org", "/", 1), ("https://city-library.example.org", "/", 0)]
    model = urls.train()
    assert [int(p >= 0.5) for p in model.probability([h[8:] for h, _, _ in held], [p for _, p, _ in held], 2)] == [1, 0]


def all_segmentations(word, theta):
    """Summed probability of all ways to write a word as a sequence of pieces."""
    return 1.0 if not word else sum(p * all_segmentations(word[len(piece) :], theta) for piece, p in theta.items() if word.startswith(piece))


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces([b"a", b"ab", b"b", b"bab"])
    theta = np.full((pieces.size, 1), 1e-9)
    values = {b"a": 0.3, b"ab": 0.25, b"b": 0.2, b"bab": 0.15}
    for p, v in zip([b"a", b"ab", b"b", b"bab"], values.values()):
        theta[256 + [b"a", b"ab", b"b", b"bab"].index(p)] = v
    words = [b"abab", b"b", b"babab", b"aaab"]
    got = np.exp(langid.Lattice(words, pieces).log_probability(theta))[:, 0]
    assert np.allclose(got, [all_segmentations(w, values) for w in words], rtol=1e-6)


def test_language(spark):
    en = [(i, " ".join(random.Random(i).choices("the of river stone walk light blue north and".split(), k=12)), "en", "s") for i in range(60)]
    de = [(i, " ".join(random.Random(i).choices("der und straße über fluss stein licht blau nord".split(), k=12)), "de", "s") for i in range(60, 120)]
    extra = [(200, None, "en", "s"), (201, "123 !!", "en", "s"), (202, "", None, "s")]
    got = {r["doc_id"]: r for r in langid.identified(table(spark, en + de + extra)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in en + de)
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_decontamination(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(5, 60)))) for i in range(40)] + [(98, None), (99, "")]
    texts, want = [], set()
    for k in range(240):
        words = draw.choices(vocabulary, k=50)
        if k % 2:
            i, item = items[k % 40]
            held = item.split()
            for _ in range(len(held) // 10):
                held[draw.randrange(len(held))] = "edit"
            words[20:20] = held
            want.add((k, i))
        texts.append((k, " ".join(words).upper() if k % 3 == 0 else " ".join(words), "en", "s"))
    texts += [(300, None, "en", "s"), (301, "", "en", "s")]
    found = decontaminate.leaks(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want and len(got) >= 0.95 * len(want)
    clean = decontaminate.clean(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, *_ in texts} - {d for d, _ in got}


@pytest.mark.parametrize("n", [3, 9, 15, 16, 31, 32, 59, 64, 100, 255, 400])
def test_decontamination_finds_all_within_the_bound(spark, n):
    """Items at the largest number of edits allowed, of each kind, are all found; with one more none is."""
    draw = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(vocabulary, k=n))) for i in range(10)]

    def edited(words, edits, kind):
        words = list(words)
        for e, at in enumerate(sorted(draw.sample(range(n), edits), reverse=True)):
            put = [f"edit{draw.random()}"]
            how = kind if kind < 3 else e % 3
            words[at : at + (how != 1)] = [] if how == 2 else put
        return words

    texts = []
    for i, item in items:
        for kind in range(4):
            around = [draw.choices(vocabulary, k=30) for _ in range(2)]
            texts.append((4 * i + kind, " ".join(around[0] + edited(item.split(), n // 5, kind) + around[1]), "en", "s"))
        texts.append((1000 + i, " ".join(draw.choices(vocabulary, k=30) + edited(item.split(), n // 5 + 1, 0)), "en", "s"))
    found = decontaminate.leaks(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    code = collections.defaultdict(itertools.count().__next__)
    coded = {x: np.array([code[w] for w in x.split()]) for _, x, *_ in items + texts}
    want = {(d, i, decontaminate.edit_distance_within(coded[item], coded[text])[0]) for i, item in items for d, text, *_ in texts}
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == {(d, i, k) for d, i, k in want if k <= n // 5}
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(4 * i + kind, i) for i, _ in items for kind in range(4)}


def test_edit_distance():
    def plain(item, text):
        best = list(range(len(item) + 1))
        out = best[-1]
        for t in text:
            row = [0]
            for i, w in enumerate(item):
                row.append(min(best[i] + (w != t), best[i + 1] + 1, row[i] + 1))
            best, out = row, min(out, row[-1])
        return out

    draw = random.Random(2)
    for _ in range(50):
        a, b = (np.array([draw.randrange(4) for _ in range(draw.randint(0, 9))]) for _ in range(2))
        assert decontaminate.edit_distance_within(a, b)[0] == plain(a.tolist(), b.tolist())


OPERATORS = {
    "fingerprints": lambda d: fingerprint.edited_fingerprints(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "mixing": lambda d: mixing.mixed(d),
    "scoring": lambda d: ngram.scored(d),
    "parsing": lambda d: rlz.removal_report(rlz.duplicate_factors(d)),
    "quality": lambda d: quality.judged(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "language": lambda d: langid.identified(d),
    "suffix": lambda d: suffix.removal_report(suffix.duplicate_spans(d)),
    "leaks": lambda d: decontaminate.leaks(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_and_repeated_ids(odd, name):
    n = OPERATORS[name](odd).count()
    assert n == {"fingerprints": 2, "leaks": 0}.get(name, 6)


def test_urls_of_an_empty_table(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def run_pipeline(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    return docs


def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(8)
    syllables = "ba co di fu ge ho ki lo mu na pe qui ro sa te vu".split()

    def text(n):
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(n))

    item, passage = text(25), text(90)
    rows = [(i, text(80), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50, rows[3][1], "en", "s0"), (51, rows[4][1].replace(" ", "\n"), "en", "s1"), (7, text(70), "en", "s1"), (52, text(30) + " " + item + " " + text(30), "en", "s1")]
    rows += [(53, text(40) + " " + passage, "en", "s2"), (54, passage + " " + text(40), "en", "s2"), (55, None, "en", "s0"), (56, "12 %%", "en", "s0"), (None, text(60), None, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, rows)
    kept, counts = [], []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mix":
            assert out.columns == docs.columns
        docs = out.cache()
        kept.append({r["doc_id"]: r for r in docs.collect()})
        counts.append(docs.count())
    language, near, passages, clean, mixed = kept
    assert set(language) == {i for i, *_ in rows} - {55, 56}
    assert set(near) == set(language) - {50, 51} and counts[1] == counts[0] - 2  # two texts of one id both stay
    assert passage in passages[53]["text"] and passage not in passages[54]["text"] and passages[54]["n_chars"] == len(passages[54]["text"])
    assert all(passages[i]["text"] == t for i, t, *_ in rows[:40] if i != 7)
    assert set(clean) == set(passages) - {52}
    assert set(mixed) <= set(clean) and all(r["taken"] <= 2 * r["size"] for r in mixed.values())


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert run_pipeline(spark, nothing, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
