"""Language identification by unigram piece models summed over all segmentations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.llm.text import _byte_values, arrow_rows, chunks, fold_of, prefix_hashes, range_hashes
from tarnbook.session import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_PER_LANGUAGE = 1000
EM_ROUNDS = 4
FEW_LANGUAGES = 10_000
MOST_KNOWN = 1 << 21  # numbers: a word has one for each language
LONGEST_PLAIN = 32  # bytes; probabilities of longer stretches could be too small for a plain number and are kept as logarithms
SMOOTHING = 0.01
UNDETERMINED = "und"
WORD_MARK = "▁".encode()


class Pieces:
    """The vocabulary as a hash table: ordinary pieces by their bytes, and one piece for each single byte."""

    def __init__(self, vocabulary: list[bytes]):
        self.size = 256 + len(vocabulary)
        data = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        ends = np.cumsum([len(v) for v in vocabulary])
        starts = ends - [len(v) for v in vocabulary]
        h = range_hashes(prefix_hashes(_byte_values(0)[data]), starts, ends)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], (order + 256).astype(np.int32)
        self.lengths = sorted({len(v) for v in vocabulary})
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.hashes & np.uint64((1 << 20) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their ids."""
        maybe = np.flatnonzero(self.sieve[h & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        return maybe[hit], self.ids[at[hit]]


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Ordinary pieces of a public sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p)


class Lattice:
    """All segmentations of some words into pieces: edges in the order of their end within the word."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.array([len(w) for w in words], dtype=np.int64)
        self.ends = np.cumsum(length)
        self.starts = self.ends - length
        # Node i of a word of n bytes stands before its byte i; words have n + 1 nodes.
        shift = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(data))
        relative = place - np.repeat(self.starts, length)
        left = np.repeat(self.ends, length) - place
        sums = prefix_hashes(_byte_values(0)[data])
        found = [(place + shift, np.full(len(data), 1), data.astype(np.int32), relative + 1)]
        longest = int(length.max(initial=0))
        for n in pieces.lengths:
            if n > longest:
                break
            fits = np.flatnonzero(left >= n)
            hit, ids = pieces.find(range_hashes(sums, fits, fits + n))
            at = fits[hit]
            found.append((at + shift[at], np.full(len(at), n), ids, relative[at] + n))
        source = np.concatenate([f[0] for f in found])
        width = np.concatenate([f[1] for f in found])
        ids = np.concatenate([f[2] for f in found])
        level = np.concatenate([f[3] for f in found])
        # By length, byte pieces apart: within a group no two edges begin or end at one node.
        group = level * (2 * longest + 2) + width * 2 + (ids < 256)
        order = np.argsort(group, kind="stable")
        self.source, self.target, self.ids = source[order], (source + width)[order], ids[order]
        group = group[order]
        self.cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else np.zeros(1, int)
        self.first = self.starts + np.arange(len(words))
        self.last = self.ends + np.arange(len(words))
        self.nodes = len(data) + len(words)
        self.plain = longest <= LONGEST_PLAIN

    def forward(self, theta: np.ndarray) -> np.ndarray:
        """Summed probability of all segmentations up to every node, for each column of ``theta``."""
        alpha = np.zeros((self.nodes, theta.shape[1]))
        alpha[self.first] = 1.0
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            alpha[self.target[a:b]] += alpha[self.source[a:b]] * theta[self.ids[a:b]]
        return alpha

    def backward(self, theta: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.nodes, theta.shape[1]))
        beta[self.last] = 1.0
        for a, b in zip(self.cuts[-2::-1], self.cuts[:0:-1]):
            beta[self.source[a:b]] += beta[self.target[a:b]] * theta[self.ids[a:b]]
        return beta

    def log_forward(self, logs: np.ndarray) -> np.ndarray:
        """The same in logarithms, which never get too small."""
        alpha = np.full((self.nodes, logs.shape[1]), -np.inf)
        alpha[self.first] = 0.0
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            alpha[self.target[a:b]] = np.logaddexp(alpha[self.target[a:b]], alpha[self.source[a:b]] + logs[self.ids[a:b]])
        return alpha

    def log_backward(self, logs: np.ndarray) -> np.ndarray:
        beta = np.full((self.nodes, logs.shape[1]), -np.inf)
        beta[self.last] = 0.0
        for a, b in zip(self.cuts[-2::-1], self.cuts[:0:-1]):
            beta[self.source[a:b]] = np.logaddexp(beta[self.source[a:b]], beta[self.target[a:b]] + logs[self.ids[a:b]])
        return beta

    def log_probability(self, theta: np.ndarray) -> np.ndarray:
        return np.log(self.forward(theta)[self.last]) if self.plain else self.log_forward(np.log(theta))[self.last]

    def expected(self, theta: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece, words weighted by ``counts`` (one column)."""
        word_of = np.searchsorted(self.first, np.arange(self.nodes), "right") - 1
        if not self.plain:
            logs = np.log(theta)
            alpha, beta = self.log_forward(logs)[:, 0], self.log_backward(logs)[:, 0]
            whole = alpha[self.last][word_of[self.source]]
            use = np.exp(alpha[self.source] + logs[self.ids, 0] + beta[self.target] - whole) * counts[word_of[self.source]]
            return np.bincount(self.ids, weights=use, minlength=len(theta))
        alpha, beta = self.forward(theta)[:, 0], self.backward(theta)[:, 0]
        share = np.zeros(self.nodes)
        share[:] = (counts / alpha[self.last])[word_of]
        use = alpha[self.source] * theta[self.ids, 0] * beta[self.target] * share[self.source]
        return np.bincount(self.ids, weights=use, minlength=len(theta))


def _parts(word: bytes, pieces: Pieces) -> list[bytes]:
    """A lower-cased word with its mark; a long one is cut wherever no piece spans the cut.

    Every segmentation has its border there, so the sum over all segmentations is the product of the parts' sums.
    """
    whole = WORD_MARK + word.decode("utf-8", "replace").lower().encode()
    if len(whole) <= LONGEST_PLAIN:
        return [whole]
    sums = prefix_hashes(_byte_values(0)[np.frombuffer(whole, dtype=np.uint8)])
    spans = np.zeros(len(whole) + 2, dtype=np.int64)
    for n in pieces.lengths:
        if n > 1:
            starts = np.arange(max(0, len(whole) - n + 1))
            hit = pieces.find(range_hashes(sums, starts, starts + n))[0]
            np.add.at(spans, hit + 1, 1)
            np.add.at(spans, hit + n, -1)
    free = np.flatnonzero(np.cumsum(spans[: len(whole)])[1:] == 0) + 1
    edges = [0, *free.tolist(), len(whole)]
    return [whole[x:y] for x, y in zip(edges, edges[1:])]


def _apart(parts: list[bytes]) -> list[np.ndarray]:
    """Which parts are short enough for plain numbers, and which are not; a kind without parts is left out."""
    long = np.array([len(p) > LONGEST_PLAIN for p in parts], dtype=bool)
    return [x for x in (np.flatnonzero(~long), np.flatnonzero(long)) if len(x)]


def estimate(words: list[bytes], counts: np.ndarray, pieces: Pieces, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Piece probabilities from word counts by expectation-maximisation over all segmentations."""
    parts, weight = [], []
    for word, n in zip(words, counts.tolist()):
        for part in _parts(word, pieces):
            parts.append(part)
            weight.append(n)
    theta = np.full((pieces.size, 1), 1.0 / pieces.size)
    if not parts:
        return theta[:, 0]
    weight = np.array(weight, dtype=float)
    lattices = [(Lattice([parts[i] for i in kind], pieces), weight[kind]) for kind in _apart(parts)]
    for _ in range(rounds):
        use = sum(lattice.expected(theta, n) for lattice, n in lattices) + SMOOTHING
        theta = (use / use.sum())[:, None]
    return theta[:, 0]


@dataclass
class Model:
    """Languages, their piece probabilities (one column each) and their logarithmic shares of the sample."""

    languages: list[str]
    theta: np.ndarray
    prior: np.ndarray
    vocabulary: list[bytes]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", vocabulary: str = VOCABULARY, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit one piece model per language on a sample of about ``sample`` texts of each, chosen by a hash of the id.

    Rows without a text or a language teach nothing.  The words of the sample are counted in Spark and each language is fitted
    in a task of its own; the sample's bound is what a task and the driver see at most.  The vocabulary is a public file and
    is read on the driver.
    """
    pieces = read_vocabulary(vocabulary)
    known = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes)
    # Languages are labels, so there are few; if not, the join is a plain one.
    few = sizes.count() <= FEW_LANGUAGES
    chosen = known.join(F.broadcast(sizes) if few else sizes, "lang").where(F.shiftrightunsigned(F.xxhash64("id", F.lit(9)), 11) * F.lit(2.0**-53) < F.lit(float(sample)) / F.col("n"))
    words = chosen.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word != ''")
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        theta = estimate([w.encode() for w in frame["word"]], frame["n"].to_numpy(), Pieces(pieces))
        return pd.DataFrame({"lang": [key[0]], "theta": [theta.tobytes()]})

    rows = sorted(counted.groupBy("lang").applyInPandas(fit, "lang string, theta binary").collect(), key=lambda r: r["lang"])
    seen = {r["lang"]: r["n"] for r in sizes.collect()}
    languages = [r["lang"] for r in rows]
    theta = np.stack([np.frombuffer(r["theta"]) for r in rows], axis=1) if rows else np.zeros((256 + len(pieces), 0))
    share = np.array([float(seen[x]) for x in languages])
    return Model(languages, theta, np.log(share / share.sum()) if len(share) else share, pieces)


class Known:
    """Log probabilities of the words met so far, by hash; it starts anew when it has ``MOST_KNOWN`` of them."""

    def __init__(self, languages: int):
        self.hashes, self.values = np.zeros(0, dtype=np.uint64), np.zeros((0, languages))

    def look_up(self, hashes: np.ndarray, compute) -> np.ndarray:
        """Values of distinct hashes; ``compute(places)`` gives those of the places that are not known yet."""
        at = np.searchsorted(self.hashes, hashes)
        found = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == hashes[inside]
        values = np.empty((len(hashes), self.values.shape[1]))
        values[found] = self.values[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            values[new] = compute(new)
            if self.values.size > MOST_KNOWN:
                self.__init__(self.values.shape[1])
            merged = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(merged)
            self.hashes, self.values = merged[order], np.concatenate([self.values, values[new]])[order]
        return values


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language predicted and its score, in columns of the two ``names``.

    A text's probability in a language is the product over its words of the summed probability of all their
    segmentations; the score is the posterior of the likeliest language.  Texts that are null or have no letter, and all
    texts if no language is known, are ``und`` with score 0.  Columns of the two names, if there are any, are replaced.
    """
    arrow_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    languages, theta, prior, vocabulary = model.languages, model.theta, model.prior, model.vocabulary
    where = kept.index(text)

    def scored(chunk, pieces, known) -> tuple[np.ndarray, list[bool]]:
        starts, ends, first = chunk.words
        total = np.tile(prior, (len(chunk.bounds) - 1, 1))
        raw = chunk.data.tobytes()
        bounds = chunk.bounds.tolist()
        letters = [_has_letter(raw[a : min(a + 64, b)]) or _has_letter(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        if len(starts):
            hashes, one, back = np.unique(chunk.word_hashes(), return_index=True, return_inverse=True)

            def compute(places: np.ndarray) -> np.ndarray:
                parts, owner = [], []
                for i, (s, e) in enumerate(zip(starts[one[places]].tolist(), ends[one[places]].tolist())):
                    for part in _parts(raw[s:e], pieces):
                        parts.append(part)
                        owner.append(i)
                value = np.empty((len(parts), len(languages)))
                for kind in _apart(parts):
                    value[kind] = Lattice([parts[i] for i in kind], pieces).log_probability(theta)
                return np.add.reduceat(value, np.searchsorted(owner, np.arange(len(places))), axis=0)

            by_word = known.look_up(hashes, compute)
            sums = np.vstack([np.zeros(len(languages)), np.cumsum(by_word[back], axis=0)])
            total += sums[first[1:]] - sums[first[:-1]]
        return total, letters

    def run(batches):
        pieces, known = Pieces(vocabulary), Known(len(languages))
        for batch in batches:
            labels, scores = [], []
            for chunk in chunks(batch.column(where)):
                if not languages:
                    labels += [UNDETERMINED] * (len(chunk.bounds) - 1)
                    scores += [0.0] * (len(chunk.bounds) - 1)
                    continue
                total, letters = scored(chunk, pieces, known)
                best = total.argmax(axis=1)
                weight = np.exp(total - total.max(axis=1, keepdims=True))
                share = weight.max(axis=1) / weight.sum(axis=1)
                labels += [languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters)]
                scores += [s if ok else 0.0 for s, ok in zip(share.tolist(), letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    return docs.select(*kept).mapInArrow(run, schema)


def identified(docs: DataFrame, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: trained on all folds but one (by crc32 of the id), applied to every row.

    Null texts, empty ones and those without a letter are ``und`` with score 0; a row without an id is not held out, and teaches
    if it has text and language; repeated rows have equal results; of languages equally likely the first by name is taken.
    """
    fold = fold_of("doc_id", folds)
    model = train(docs.where(fold != held_out), **options)
    rows = docs.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
