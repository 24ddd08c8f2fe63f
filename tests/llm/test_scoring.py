"""Scores of the language model against a brute-force model, a hot bigram among the texts."""

import collections
import math
import zlib

import numpy as np
import pytest

from tarnbook.llm import langid, ngram, urls


def words_of(i):
    draw = np.random.default_rng(i)
    return [f"w{int(x)}" for x in draw.zipf(1.6, 40 + i % 30) % 200]


@pytest.fixture(scope="module")
def texts():
    out = {i: words_of(i) for i in range(300)}
    # One bigram holds over a third of all tokens.
    out |= {i: ["hot"] * 400 for i in range(300, 330)}
    out |= {400: [], 401: ["unseen", "words", "only"], 402: out[7]}
    return out


def brute(texts):
    """Log10 probability of every text: weights by expectation-maximisation over single tokens, each deleted from its counts."""
    steps = {i: list(zip([None, *w], [*w, ""])) for i, w in texts.items()}
    train = [s for i in steps if zlib.crc32(str(i).encode()) % 5 != 1 for s in steps[i]]
    pairs, after = collections.Counter(train), collections.Counter(a for a, _ in train)
    single = collections.Counter(b for _, b in train)
    # A word counts as a context wherever it stands, and the start once a text.
    seen = {a: after[a] if a is None else single[a] for a in after}
    total, kinds = len(train), len(single)

    def bucket(c):
        return int(math.log2(c)) + 1 if c > 0 else 0

    kept = collections.defaultdict(collections.Counter)
    for (a, b), n in pairs.items():
        c12, c1, c2 = n - 1, seen[a] - 1, single[b] - 1
        kept[bucket(c1)][c12 / c1 if c1 else 0.0, c2 / (total - 1), 1 / (kinds + 1)] += n

    def fit(table):
        p, n = np.array(list(table)), np.array(list(table.values()))
        w = np.array([0.5, 0.4, 0.1])
        for _ in range(ngram.EM_ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = np.maximum((share * n[:, None]).sum(axis=0) / n.sum(), ngram.FLOOR)
            w /= w.sum()
        return w

    common = fit(sum(kept.values(), collections.Counter()))
    weights = {b: fit(t) for b, t in kept.items()}

    def probability(a, b):
        c1 = seen.get(a, 0)
        w = weights.get(bucket(c1), common)
        if not c1:
            w = np.array([0.0, w[1], w[2]]) / (w[1] + w[2])
        return w[0] * (pairs[a, b] / c1 if c1 else 0.0) + w[1] * single[b] / total + w[2] / (kinds + 1)

    return {i: sum(math.log10(probability(a, b)) for a, b in s) for i, s in steps.items()}


@pytest.mark.parametrize("most, block", [(ngram.FREQUENT, 2 << 20), (ngram.FREQUENT, 1000), (40, 1000)])
def test_scores(spark, texts, most, block, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in ngram.scored(docs, most=most).collect()}
    want = brute(texts)
    assert got.keys() == want.keys()
    # The table the weights are learned from has four steps a doubling.
    assert all(math.isclose(got[i], want[i], rel_tol=0.01) for i in want)


def test_owner_gets_one_number_of_a_block_for_a_hot_bigram(spark, texts):
    docs = spark.createDataFrame([(i, 0, True, "hot " * 1000) for i in range(50)], "doc_id long, thash long, train boolean, text string").repartition(2)
    table = ngram.frequent_words(ngram.word_counts(docs), ngram.FREQUENT)
    words = spark.sparkContext.broadcast(table)
    rows = docs.mapInArrow(ngram._blocks(words, 3), ngram.BLOCK).collect()
    assert len(rows) <= 4
    for r in rows:
        n = np.concatenate([ngram._loose(p["n"], np.uint32) for p in r["parts"]])
        assert len(n) == 3 and n.max() > 999


def test_url_words_the_table_does_not_hold():
    """Every fifth word is left out of the table in turn and judged by the others."""
    rows = urls.labelled_urls()
    order = sorted(set(urls.BLOCKED_WORDS) | set(urls.ALLOWED_WORDS))
    right = []
    for fold in range(5):
        out = set(order[fold::5])
        model = urls.train([r for r in rows if r[0].split(".example.")[0].split(".")[-1] not in out])
        for label, own in ((1, urls.BLOCKED_WORDS), (0, urls.ALLOWED_WORDS)):
            hosts = [f"{w}.example.com" for w in own if w in out]
            got = model.probability(hosts, ["/"] * len(hosts), len(hosts)) >= 0.5
            right += [(label, bool(g) == bool(label)) for g in got]
    shares = [np.mean([ok for label, ok in right if label == x]) for x in (0, 1)]
    print(shares)
    assert min(shares) > 0.5


def test_all_segmentations_of_long_words():
    """Pieces and words over any length count whole, against a plain recursion in logarithms."""
    vocabulary = [b"a", b"ab", b"b", b"bab", "é".encode(), b"aab" * 9, b"ba" * 20]
    pieces = langid.Pieces(sorted(vocabulary))
    names = {**{bytes([i]): [i] for i in range(256)}}
    for i, v in enumerate(sorted(vocabulary)):
        names.setdefault(v, []).append(256 + i)
    draw = np.random.default_rng(3)
    theta = draw.random((pieces.size, 2)) ** 8 + 1e-9
    theta /= theta.sum(axis=0)

    def plain(word):
        alpha = [np.zeros(2)]
        for end in range(1, len(word) + 1):
            ways = [alpha[a] + np.log(theta[i]) for a in range(max(0, end - 40), end) for i in names.get(word[a:end], [])]
            alpha.append(np.logaddexp.reduce(ways))
        return alpha[-1]

    words = [("ba" * 30).encode(), ("aab" * 40).encode(), ("é" * 50).encode(), b"xyz" * 40, b"ab", b"", ("abbaéba" * 300).encode(), b"ba" * 20]
    for word in words:
        parts = langid._parts(word, pieces)
        assert b"".join(parts) == langid.WORD_MARK + word
        got = sum(langid.Lattice([parts[i] for i in kind], pieces).log_probability(theta).sum(axis=0) for kind in langid._apart(parts))
        assert np.allclose(got, plain(langid.WORD_MARK + word), rtol=1e-9), word
    # Expected uses in logarithms are those in plain numbers.
    lattice = langid.Lattice([b"abab", b"bab"], pieces)
    once = lattice.expected(theta[:, :1], np.array([2.0, 3.0]))
    lattice.plain = False
    assert np.allclose(once, lattice.expected(theta[:, :1], np.array([2.0, 3.0])))
    assert len(langid.read_vocabulary()) > 31_700 and max(map(len, langid.read_vocabulary())) > 16
