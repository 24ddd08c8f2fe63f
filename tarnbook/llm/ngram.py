"""LM scoring: a bigram model by deleted interpolation, its weights learned for buckets of context frequency.

Bigrams are counted where they are owned and scores are added up where the texts are.  Texts are stored in blocks; a block
sends every owner the distinct bigrams it has of it, with their training counts, as one packed row.  The owner adds the counts up,
answers each block (:func:`_counted`) and makes the table the weights are learned from; the block adds up the scores of its
documents (:func:`_block_scores`).  However frequent a bigram is, its owner gets one number of a block.  There are as many packed
rows as blocks times owners, as a shuffle has pieces, and never more than tokens.

Word counts are needed beside bigram counts.  The words of ``FREQUENT`` or fewer highest counts (all words of one count, or
none) are broadcast, a table of at most 50 MB; tokens with a word outside it get their counts by joins instead
(:func:`_rare`).  Nothing is left out either way.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.llm.text import U64, Chunk, arrow_rows, chunks, fold_of, mix
from tarnbook.session import cut_lineage

FREQUENT = 1 << 22
TOKENS_PER_OWNER = 2_000_000
BLOCK_BYTES = 2 << 20
END = U64(0x1F83D9ABFB41BD6B)
START = U64(0x5BE0CD19137E2179)
EM_ROUNDS = 40
FINE = 4  # cells per doubling of a probability, in the table the weights are learned from
FLOOR = 1e-6

TOKENS = "doc_id long, thash long, train boolean, c12 long, c1 long, c2 long, own boolean"
BLOCK = "block long, docs binary, doc binary, reps binary, parts array<struct<owner: int, key: binary, n: binary>>"
PARTS = pa.list_(pa.struct([("owner", pa.int32()), ("key", pa.binary()), ("n", pa.binary())]))
COUNTED = "block long, owner int, c12 binary, cells binary"


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _loose(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=kind)


def _tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, token and text of every token: each text's words and one end, after a start."""
    chunk = chunk.lower()
    words, first = chunk.word_hashes(), chunk.words[2]
    n = len(first) - 1
    size = np.diff(first) + 1
    text = np.repeat(np.arange(n), size)
    ends = np.cumsum(size) - 1
    token = np.empty(len(text), dtype=U64)
    is_end = np.zeros(len(text), dtype=bool)
    is_end[ends] = True
    token[is_end], token[~is_end] = END, words
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - size + 1] = START
    return context, token, text


@dataclass
class Words:
    """Counts of words (hashes, sorted): N, V and the number of training texts; ``complete`` if no training word is missing."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    texts: int
    complete: bool

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Place of each word; START and words that are not in the table have the two places after the last."""
        one, back = np.unique(words, return_inverse=True)
        n = len(self.hashes)
        at = np.searchsorted(self.hashes, one)
        known = np.zeros(len(one), dtype=bool)
        inside = at < n
        known[inside] = self.hashes[at[inside]] == one[inside]
        at[~known] = n + 1
        at[one == START] = n
        return at[back]

    def all_counts(self) -> np.ndarray:
        return np.append(self.counts.astype(np.int64), [self.texts, 0])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` of all training texts, the end counted once a text."""

    def run(batches):
        for b in batches:
            for chunk in chunks(b.column(0), BLOCK_BYTES):
                one, n = np.unique(_tokens(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counted = rows.where("train").select("text").mapInArrow(run, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> Words:
    """The broadcast table: all words with a count of at least a power of two, the least that gives no more than ``most`` words."""
    bands = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("tokens"))
    rows = sorted(bands.collect(), key=lambda r: -r["band"])
    held, least = 0, 64
    for r in rows:
        if held + r["kinds"] > most:
            break
        held, least = held + r["kinds"], r["band"]
    table = counts.where(F.col("n") >= F.lit(2**least)) if least < 63 else counts.limit(0)
    table = table.toArrow()
    hashes = table.column("word").to_numpy().view(U64)
    order = np.argsort(hashes)
    end = counts.where(F.col("word") == int(END.view(np.int64))).first()
    return Words(
        hashes[order], table.column("n").to_numpy()[order], sum(r["tokens"] for r in rows), sum(r["kinds"] for r in rows),
        end["n"] if end else 0, held == sum(r["kinds"] for r in rows),
    )


def _stats(words):
    """Per text: tokens, known tokens and base score, over the tokens whose count is in the table."""

    def run(batches):
        w = words.value
        counts = w.all_counts()
        for b in batches:
            out = []
            for chunk in chunks(b.column(3), BLOCK_BYTES):
                _, token, text = _tokens(chunk)
                n = len(chunk.bounds) - 1
                at = w.ids(token)
                c = counts[at]
                base = w.base(c)
                if not w.complete:
                    base[at == len(w.hashes) + 1] = 0.0
                out.append((np.bincount(text, minlength=n), np.bincount(text, weights=c > 0, minlength=n).astype(np.int64), np.bincount(text, weights=base, minlength=n)))
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cols[0].astype(np.int64)), pa.array(cols[1]), pa.array(cols[2])],
                names=["doc_id", "thash", "train", "n_tokens", "n_known", "base"],
            )

    return run


def _blocks(words, owners: int):
    """Blocks of texts: the distinct bigrams of tokens whose two words are in the table, by owner, and the documents they are in."""

    def run(batches):
        w = words.value
        width = len(w.hashes) + 2
        for b in batches:
            ids = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            ids[0] = b.column(0).fill_null(-1).to_numpy()
            null = ~b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for chunk in chunks(b.column(3), BLOCK_BYTES):
                context, token, text = _tokens(chunk)
                c, t = w.ids(context), w.ids(token)
                if not w.complete:
                    here = (c != width - 1) & (t != width - 1)
                    c, t, text = c[here], t[here], text[here]
                if not len(c):
                    continue
                at = slice(*chunk.rows)
                train = ids[2][at].astype(np.int64)
                key = c * width + t
                owner = (mix(key.astype(U64)) % U64(owners)).astype(np.int64)
                order = np.lexsort((key, owner))
                key, text, owner = key[order], text[order], owner[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                reps = np.diff(first, append=len(key))
                taught = np.add.reduceat(train[text], first)
                key, owner = key[first], owner[first]
                cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])).tolist()
                parts = [
                    {"owner": int(owner[i]), "key": _squeeze(np.diff(key[i:j], prepend=0)), "n": _squeeze(taught[i:j].astype(np.uint32))}
                    for i, j in zip(cuts, [*cuts[1:], len(key)])
                ]
                names = np.concatenate([np.diff(ids[0][at], prepend=0), ids[1][at], train + 2 * null[at].astype(np.int64)])
                small = np.uint16 if len(train) < 1 << 16 else np.uint32
                block = int.from_bytes(os.urandom(8), "little", signed=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *[pa.array([x], pa.binary()) for x in (_squeeze(names), _squeeze(text.astype(small)), _squeeze(reps.astype(np.uint32)))], pa.array([parts], PARTS)],
                    names=["block", "docs", "doc", "reps", "parts"],
                )

    return run


def _docs_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text hashes, training flags and null flags of a block's documents."""
    ids, hashes, flags = _loose(raw, np.int64).reshape(3, -1)
    return np.cumsum(ids), hashes, flags % 2 == 1, flags >= 2


def _doc_index(raw: bytes, docs: int) -> np.ndarray:
    return _loose(raw, np.uint16 if docs < 1 << 16 else np.uint32).astype(np.int64)


def _counted(words):
    """For one owner: the training count of every bigram of every block; one row without a block has the cells of all its bigrams."""

    def run(table: pa.Table) -> pa.Table:
        w = words.value
        counts = w.all_counts()
        width = len(counts)
        keys = [np.cumsum(_loose(k, np.int64)) for k in table.column("key").to_pylist()]
        n = np.concatenate([_loose(x, np.uint32) for x in table.column("n").to_pylist()])
        one, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=n).astype(np.int64)
        answers = np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])
        seen = total > 0
        cells = _cells(total[seen], counts[one[seen] // width], counts[one[seen] % width], w.tokens, total[seen])
        owner = table.column("owner").to_pylist()
        return pa.table(
            [
                pa.array([*table.column("block").to_pylist(), None], pa.int64()), pa.array([*owner, owner[0]], pa.int32()),
                pa.array([*[_squeeze(x) for x in answers], None], pa.binary()),
                pa.array([*[None] * len(keys), _squeeze(np.concatenate([np.asarray(c, dtype=np.float64) for c in cells]))], pa.binary()),
            ],
            names=["block", "owner", "c12", "cells"],
        )

    return run


def _block_scores(words, weights: np.ndarray):
    """The log probability of a block's documents, from its bigrams and the owners' answers."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        w = words.value
        counts = w.all_counts()
        width = len(counts)
        answer = dict(zip(answers.column("owner").to_pylist(), answers.column("c12").to_pylist()))
        cols = [[], [], [], []]
        for row in blocks.to_pylist():
            ids, hashes, _, null = _docs_of(row["docs"])
            key = np.concatenate([np.cumsum(_loose(p["key"], np.int64)) for p in row["parts"]])
            c12 = np.concatenate([_loose(answer[p["owner"]], np.int64) for p in row["parts"]])
            log = _log_probability(c12, counts[key // width], counts[key % width], weights, w.tokens, w.kinds)
            doc = _doc_index(row["doc"], len(ids))
            s = np.bincount(doc, weights=np.repeat(log, _loose(row["reps"], np.uint32)), minlength=len(ids))
            for col, x in zip(cols, (ids, hashes, s, null)):
                col.append(x)
        ids, hashes, s, null = [np.concatenate(c) if c else np.zeros(0) for c in cols]
        return pa.table(
            [pa.array(ids.astype(np.int64), mask=null.astype(bool)), pa.array(hashes.astype(np.int64)), pa.array(s), pa.array(np.zeros(len(s))), pa.array(np.zeros(len(s), dtype=np.int64))],
            names=["doc_id", "thash", "s", "b", "k"],
        )

    return run


def bucket_of(c1: np.ndarray) -> np.ndarray:
    """Bucket of a context: 0 if it was not seen, else one more than the logarithm of its count."""
    return np.where(c1 > 0, np.floor(np.log2(np.maximum(c1, 1))) + 1, 0).astype(np.int64)


def _parts(c12, c1, c2, tokens) -> tuple[np.ndarray, np.ndarray]:
    return np.where(c1 > 0, c12 / np.maximum(c1, 1), 0.0), c2 / max(tokens, 1)


def _cells(c12, c1, c2, tokens: int, times=None):
    """Cells of the table for the weights, of training tokens (or ``times`` of each), each deleted from the counts it is predicted by."""
    times = np.ones(len(c12)) if times is None else times
    c12, c1, c2 = c12 - 1, c1 - 1, c2 - 1
    two, one = _parts(c12, c1, c2, tokens - 1)
    place = [np.where(p > 0, np.floor(FINE * np.log2(np.maximum(p, 1e-300))), 1000).astype(np.int64) for p in (two, one)]
    key = (bucket_of(c1) * 4096 + place[0] + 2048) * 4096 + place[1] + 2048
    cell, back = np.unique(key, return_inverse=True)
    return cell, np.bincount(back, weights=times), np.bincount(back, weights=times * two), np.bincount(back, weights=times * one)


CELLS = "cell long, n long, two double, one double"


def _cell_batch(parts: list) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2]), pa.array(cols[3])], names=["cell", "n", "two", "one"])


def learn_weights(rows, kinds: int) -> np.ndarray:
    """Weights of bigram, word and uniform estimate for every bucket, by expectation-maximisation.

    ``rows`` are (bucket, tokens, mean bigram estimate, mean word estimate).  A bucket without tokens takes the weights of all
    tokens together; one without seen contexts gives the bigram no weight.
    """
    table = np.array(rows, dtype=float).reshape(-1, 4)
    zero = 1.0 / (kinds + 1)

    def fit(part: np.ndarray) -> np.ndarray:
        w = np.array([0.5, 0.4, 0.1])
        p = np.column_stack([part[:, 2], part[:, 3], np.full(len(part), zero)])
        for _ in range(EM_ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * part[:, 1:2]).sum(axis=0) / part[:, 1].sum()
            w = np.maximum(w, FLOOR)
            w /= w.sum()
        return w

    common = fit(table) if len(table) else np.array([0.5, 0.4, 0.1])
    weights = np.tile(common, (66, 1))
    for b in np.unique(table[:, 0]).astype(int):
        weights[b] = fit(table[table[:, 0] == b])
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _log_probability(c12, c1, c2, weights: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    two, one = _parts(c12, c1, c2, tokens)
    w = weights[bucket_of(c1)]
    return np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (kinds + 1))


def _rare(rows: DataFrame, counts: DataFrame, words, texts: int) -> DataFrame:
    """The tokens with a word outside the broadcast table, with their counts from joins (:data:`TOKENS`)."""

    def run(batches):
        w = words.value
        unknown = len(w.hashes) + 1
        for b in batches:
            for chunk in chunks(b.column(3), BLOCK_BYTES):
                context, token, text = _tokens(chunk)
                c, t = w.ids(context), w.ids(token)
                here = np.flatnonzero((c == unknown) | (t == unknown))
                row = pa.array(text[here] + chunk.rows[0])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).take(row) for i in range(3)], pa.array(context[here].view(np.int64)), pa.array(token[here].view(np.int64)), pa.array(t[here] == unknown)],
                    names=["doc_id", "thash", "train", "w1", "w2", "own"],
                )

    found = cut_lineage(rows.mapInArrow(run, "doc_id long, thash long, train boolean, w1 long, w2 long, own boolean"))
    pairs = cut_lineage(found.where("train").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c12")))
    start = counts.sparkSession.range(1).select(F.lit(int(START.view(np.int64))).alias("word"), F.lit(texts).cast("long").alias("n"))
    known = counts.unionByName(start)
    joined = found.join(pairs, ["w1", "w2"], "left")
    joined = joined.join(known.select(F.col("word").alias("w1"), F.col("n").alias("c1")), "w1", "left")
    joined = joined.join(counts.select(F.col("word").alias("w2"), F.col("n").alias("c2")), "w2", "left")
    zero = F.lit(0).cast("long")
    return cut_lineage(joined.select("doc_id", "thash", "train", *[F.coalesce(c, zero).alias(c) for c in ("c12", "c1", "c2")], "own"))


def scored(docs: DataFrame, text: str = "text", id_col: str = "doc_id", folds: int = 5, held_out: int = 1, most: int = FREQUENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from rows whose crc32 of the id as text, modulo ``folds``, is not ``held_out``; a row without an id is
    neither taught nor held out.  Tokens are the lower-cased (A-Z) runs of anything but space and the characters 9 to 13, and one
    end; a null text has the end only.  The probability of a token is a mixture of its maximum-likelihood estimate after
    the token before (a start before the first), that without context, and a uniform one over the known words and one unknown
    word.  The mixture depends on how often the context was seen, in buckets of doubling counts; its weights maximise the
    likelihood of the training tokens, each deleted from the counts that predict it.  With no training text all words are
    unknown.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    fold = fold_of(id_col, folds)
    # Where ids don't tell rows apart, a hash of the text goes with them.
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
    content = F.lit(0).cast("long") if ids["n"] == ids["d"] else F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), content.alias("thash"),
        F.coalesce(fold != held_out, F.lit(False)).alias("train"), F.col(text).alias("text"),
    )
    counts = cut_lineage(word_counts(rows))
    table = frequent_words(counts, most)
    words = spark.sparkContext.broadcast(table)
    tokens, kinds = table.tokens, table.kinds
    owners = max(8, -(-tokens // TOKENS_PER_OWNER))
    blocks = cut_lineage(rows.mapInArrow(_blocks(words, owners), BLOCK))
    asked = blocks.select("block", F.inline("parts"))
    answers = cut_lineage(asked.groupBy("owner").applyInArrow(_counted(words), COUNTED))
    rare = None if table.complete else _rare(rows, counts, words, table.texts)

    def packed_cells(batches):
        for b in batches:
            yield _cell_batch([tuple(_loose(x, np.float64).reshape(4, -1)) for x in b.column(0).to_pylist()])

    def rare_cells(batches):
        for b in batches:
            yield _cell_batch([_cells(*[b.column(c).to_numpy() for c in (3, 4, 5)], tokens)])

    cells = answers.where("block is null").select("cells").mapInArrow(packed_cells, CELLS)
    if rare is not None:
        cells = cells.unionByName(rare.where("train").mapInArrow(rare_cells, CELLS))
    # Buckets and steps of probabilities: a table of bounded size.
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).orderBy("cell").toArrow()
    cell, n, two, one = [cells.column(c).to_numpy() for c in ("cell", "n", "two", "one")]
    weights = learn_weights(np.column_stack([cell // (4096 * 4096), n, two / n, one / n]), kinds)

    def rare_scores(batches):
        for b in batches:
            c12, c1, c2 = [b.column(c).to_numpy() for c in (3, 4, 5)]
            own = b.column(6).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(_log_probability(c12, c1, c2, weights, tokens, kinds)), pa.array(np.where(own, table_base(c2), 0.0)), pa.array((own & (c2 > 0)).astype(np.int64))],
                names=["doc_id", "thash", "s", "b", "k"],
            )

    def table_base(c):
        return np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))

    schema = "doc_id long, thash long, s double, b double, k long"
    answered = answers.where("block is not null").select("block", "owner", "c12").groupBy("block")
    parts = blocks.groupBy("block").cogroup(answered).applyInArrow(_block_scores(words, weights), schema)
    if rare is not None:
        parts = parts.unionByName(rare.mapInArrow(rare_scores, schema))
    sums = parts.groupBy("doc_id", "thash").agg(F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("k").alias("k"))
    stats = rows.mapInArrow(_stats(words), "doc_id long, thash long, train boolean, n_tokens long, n_known long, base double")
    stats = stats.groupBy("doc_id", "thash", "train").agg(
        F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("base").alias("base"), F.count(F.lit(1)).alias("copies")
    )
    joined = stats.join(sums.withColumnRenamed("doc_id", "id2").withColumnRenamed("thash", "hash2"), stats["doc_id"].eqNullSafe(F.col("id2")) & (stats["thash"] == F.col("hash2")), "left")
    # Equal rows have one text: their sums are those of all copies.
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return joined.withColumn("copy", copy).select(
        "doc_id", F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.expr("coalesce(k, 0) div copies")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("b"), F.lit(0.0)) / F.col("copies")).alias("base_score"), (F.col("s") / F.col("copies")).alias("score"),
    )
