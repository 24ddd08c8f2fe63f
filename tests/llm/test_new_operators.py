"""Token-id files, spelling variants and hard negatives against brute force, and on awkward rows."""

import collections
import heapq
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from tarnbook.llm import huffman, negatives, queries, spelling

DOCS = "doc_id long, text string, lang string, uid long, n long, ids string, thash string, value string, word string, key string, block string, id string, content string, file string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", 1, 2, "x", "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows], DOCS).repartition(parts)


def words_of(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeéßñ") for _ in range(draw.randint(6, 9))) for _ in range(n))


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t\v\f\r "), (4, "Don't 've ÀÉ x́ <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b 日本 🙂 it's|pipe"), (5, "word " * 9000), (6, "z" * 70_000),
    (7, words_of(1, 300)), (7, words_of(1, 300)), (7, words_of(2, 30)), (None, "null id here"), (None, None), (8, "\x00 nul \x1c sep   em   nbsp İ Σ ΑΣ"), (-3, "negative"),
]


# --- token ids --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths_are_optimal(seed):
    draw = random.Random(seed)
    counts = [draw.randint(1, 200) if seed % 2 else 1 << draw.randint(0, 9) for _ in range(7)]

    def cost(lengths):
        return sum(c * int(n) for c, n in zip(counts, lengths))

    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert cost(huffman.code_lengths(np.array(counts), 20)) == total
    for longest in (3, 4):
        found = huffman.code_lengths(np.array(counts), longest)
        best = min(cost(n) for n in itertools.product(range(1, longest + 1), repeat=7) if sum(2.0**-k for k in n) <= 1)
        assert found.max() <= longest and sum(2.0 ** -int(k) for k in found) <= 1 and cost(found) == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, dtype=int), 3)
    assert huffman.code_lengths(np.array([5]), 16).tolist() == [1] and len(huffman.code_lengths(np.array([], dtype=int), 16)) == 0


def test_blocks_round_trip_from_any_checkpoint():
    draw = np.random.default_rng(1)
    ids = np.minimum(draw.geometric(0.01, 3000), 900).astype(np.int64) * 7
    kinds, counts = np.unique(ids, return_counts=True)
    code = huffman.Code.of(kinds, counts, 12)
    kind, body = next(huffman.records(memoryview(code.record() + b"\n")))
    again = huffman.Code.read(body)
    assert (again.code == code.code).all() and (again.length == code.length).all() and code.lengths.max() <= 12
    # Canonical: codes count up by length, then id, and no code is the beginning of another.
    codes = sorted((int(code.length[k]), int(k)) for k in kinds)
    bits = [f"{int(code.code[k]):0{n}b}" for n, k in codes]
    assert bits == sorted(bits) and not any(b.startswith(a) for a, b in zip(bits, bits[1:]))
    record = huffman.block_record(code, np.array([(5, 3000, 0)], dtype=huffman._DOC), ids)
    (_, body), = huffman.records(memoryview(record + b"\n"))
    assert struct.unpack_from("<IIII", body)[3] == math.ceil(3000 / huffman.CHECK)
    for first, last in ((0, None), (256, 512), (300, 301), (2999, 3000), (1000, 2600), (7, 7)):
        docs, found = huffman.read_block(again, body, first, last)
        assert docs["id"].tolist() == [5] and found.tolist() == ids[first:last].tolist()
    with pytest.raises(ValueError):
        list(huffman.records(memoryview(record[:-3])))


@pytest.mark.parametrize("sizes", [{}, {"block_ids": 100, "file_ids": 3000}, {"block_ids": 1, "file_ids": 100_000, "longest": 9}])
def test_ids_of_files(spark, sizes):
    rows = AWKWARD if sizes.get("block_ids") != 1 else [r for r in AWKWARD if len(r[1] or "") < 3000]
    tokens = tokenizers.Tokenizer.from_file(huffman.public_path(huffman.VOCABULARY))
    path = huffman.stored_ids(table(spark, rows), **sizes)
    got = huffman.read_ids(spark, path, with_ids=True).orderBy("start", "n_tokens").collect()
    want = sorted((-math.inf if i is None else i, tokens.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((-math.inf if r["doc_id"] is None else r["doc_id"], list(r["ids"])) for r in got) == want
    assert [-math.inf if r["doc_id"] is None else r["doc_id"] for r in got] == [i for i, _ in want]  # files in ascending order of ids
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()))
        start += r["n_tokens"]


def test_ids_of_sf(spark):
    """The query against direct encoding of every whole text."""
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_token_ids"](spark, folder).collect()}
    tokens, start = tokenizers.Tokenizer.from_file(huffman.public_path(huffman.VOCABULARY)), 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    for d in docs:
        ids = tokens.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_files_of_nothing(spark):
    path = huffman.stored_ids(table(spark, [(1, "x")]).limit(0))
    assert huffman.read_ids(spark, path).collect() == []


def test_vocabulary_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError):
        huffman.Tokens(huffman.public_path("byte_bpe_50k.json"))


# --- spelling variants ------------------------------------------------------------------------------------------------


def brute_words(rows, least=7, count=2, every=31):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute_variants(words, times=10):
    near = {w: [u for u in words if apart(w, u)] for w in words}
    best = {w: min(near[w], key=lambda u: (-words[u], u)) for w in words if near[w]}
    form = {w: u for w, u in best.items() if words[u] >= times * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def variant_rows():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdé") for _ in range(draw.randint(7, 10))) for _ in range(12)] + ["x" * 40, "Étrangère"]
    out = []
    for i, w in enumerate(base):
        for n in (400, 30, 2, 2):
            out += [w] * n
            k = draw.randrange(len(w))
            w = draw.choice([w[:k] + draw.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + draw.choice("cdß") + w[k + 1 :]])
    out += ["".join(p) for p in itertools.permutations("abcdefgh", 8)][:400] * 2  # words of the same letters
    draw.shuffle(out)
    rows = [(i, " ".join(out[i::40]) + (". UPPERCASED×ab÷cd uppercased×ab÷cd" if i % 3 else "")) for i in range(40)]
    return rows + AWKWARD


@pytest.mark.parametrize("block", [1 << 15, 20, 3])
def test_variants(spark, block):
    rows = variant_rows()
    words = brute_words(rows)
    want = brute_variants(words)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(table(spark, rows), block_words=block).collect()}
    assert got == want
    assert sum(v[2] is not None for v in want.values()) >= 10 and any(v[4] != v[2] for v in want.values() if v[2])  # chains of forms


@pytest.mark.parametrize("every", [0, 1, 5])
def test_word_counts(spark, every):
    rows = variant_rows()
    got = {r["word"]: r["n"] for r in spelling.word_counts(table(spark, rows), every=every, least_letters=3).collect()}
    assert got == brute_words(rows, least=3, every=every)


@pytest.mark.parametrize("crowded, frontier", [(64, 1 << 20), (2, 50), (0, 1000)])
def test_trie_search_is_complete(crowded, frontier, monkeypatch):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    monkeypatch.setattr(spelling, "FRONTIER", frontier)
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abcdeghé") for _ in range(draw.randint(3, 6))).encode("latin-1") for _ in range(400)} | {"".join(p).encode() for p in itertools.permutations("abcd")} | {b"a" * 50, b"a" * 49, b"a" * 48 + b"ba"})
    block = spelling.Block(words)
    found = {(words[a], block.words[b]) for x, y in block.near(words) for a, b in zip(x.tolist(), y.tolist())}
    assert found == {(a, b) for a in words for b in words if apart(a.decode("latin-1"), b.decode("latin-1"))}
    # The search itself leaves out most pairs before any word is looked at.
    reached = sum(int((block.begin[leaf + 1] - block.begin[leaf]).sum()) for _, leaf in block.trie.search(spelling.vectors(words)))
    assert len(found) <= reached < len(words) ** 2 / 4


def test_variants_of_nothing(spark):
    empty = table(spark, [(1, "x")])
    assert spelling.variants(empty.limit(0)).collect() == [] and spelling.variants(empty).collect() == []


def test_variants_of_sf(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(rows))
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries.QUERIES["op13_spelling"](spark, folder).collect()}
    assert got == want


# --- hard negatives ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, uid long, q string, center string, far string, block string, low string, high string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 0, "x", "x", "x", "x", "x", "x", "x") for i, v, l in rows], VECTORS).repartition(3)


def brute_negatives(rows, every=10, positives=5, negatives_=10):
    rows = [(i, [math.floor(max(-(1 << 23), min(1 << 23, 256 * float(np.float32(x))))) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, q, l) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j, m) for n, (j, v, m) in enumerate(rows) if n != k]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for p, _, pid, _ in [s for s in scored if s[3] == l][:positives]:
            window = [s for s in scored if s[3] != l and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives_]
            out += [(i, pid, r + 1, s[2], -p, -s[0]) for r, s in enumerate(window)]
    return collections.Counter(out)


def vector_rows(seed, n=150, dims=6):
    draw = np.random.default_rng(seed)
    rows = [(int(i), draw.normal(size=dims).tolist(), int(draw.integers(0, 3))) for i in range(n)]
    rows += [(int(n + i), (np.array(rows[3][1]) + draw.normal(size=dims) / 500).tolist(), int(i % 2)) for i in range(40)]  # a crowd
    rows += [(300, rows[5][1], 0), (300, rows[5][1], 0), (301, rows[5][1], 1), (310, [0.0] * dims, 0), (320, [], 1), (330, [5.0, 2.0], 2)]  # copies, zero, empty, short
    rows += [(340, None, 1), (350, [1.0, None] + [0.0] * (dims - 2), 1), (360, [math.nan] * dims, 1), (370, [math.inf] * dims, 1), (380, [1.0] * dims, None), (None, [0.5] * dims, 1), (390, [1e30] * dims, 0)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "leaf_rows": 4}, {"block_rows": 40, "most_centers": 2, "leaf_rows": 3, "base": 2.0}])
def test_negatives(spark, sizes):
    rows = vector_rows(len(sizes))
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, **sizes).collect()
    want = brute_negatives(rows)
    assert collections.Counter(tuple(r) for r in got) == want and len(want) > 100


def test_negatives_of_nothing(spark):
    empty = vectors(spark, [(1, [1.0], 1)])
    assert negatives.hard_negatives(empty.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(10, [], 1), (20, [], 1), (30, [], 2)]), F.col("vec_id") % 10 == 0).count() == 2


def test_cover_tree_holds_its_rows():
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(size=(20, 3)) + 30 * c for c in draw.normal(size=(40, 3))])
    tree = negatives.cover_tree(points, 8)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and tree.leaf.sum() > 30
    for k in range(len(tree.center)):
        inside = points[tree.order[tree.begin[k] : tree.end[k]]]
        assert np.linalg.norm(inside - points[tree.center[k]], axis=1).max() <= tree.radius[k] + 1e-9
        if k:
            assert tree.parent[k] < k and tree.begin[tree.parent[k]] <= tree.begin[k] and tree.end[k] <= tree.end[tree.parent[k]]


def test_search_skips_far_nodes():
    """On rows in clusters most leaves are never verified, and the results are those of all rows."""
    import pyarrow as pa

    draw = np.random.default_rng(4)
    q = np.concatenate([np.rint(200 * c + draw.normal(size=(25, 8))) for c in draw.normal(size=(60, 8))]).astype(np.int64)
    most2 = float((q * q).sum(axis=1).max())
    block = negatives.Block(np.arange(len(q)), pa.array(np.arange(len(q))), np.zeros(len(q), dtype=np.int64), q, negatives.cover_tree(negatives.augmented(q, most2), 8), most2)
    seen, whole = [], block.scores
    block.scores = lambda queries, rows: seen.append(len(queries) * len(rows)) or whole(queries, rows)
    few = np.arange(0, len(q), 50)
    bottom = np.full(len(few), -(1 << 62))
    a, r, s = block.search(few, q[few], np.zeros(len(few), dtype=np.int64), bottom, -bottom, bottom, True, 5)
    for n, k in enumerate(few):
        scores = q @ q[k]
        order = [int(x) for x in np.lexsort((np.arange(len(q)), -scores)) if x != k][:5]
        assert r[a == n].tolist() == order and s[a == n].tolist() == scores[order].tolist()
    assert sum(seen) < len(few) * len(q) / 4
