"""Benchmark decontamination by a random-walk embedding of edit distance and bit-sampling LSH."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.session import cut_lineage
from tarnbook.llm.text import U64, arrow_rows, chunks, mix

SIMILARITY = 0.8
BLOCK_ITEMS = 20_000
SIEVE = 1 << 16
WORD_SIEVE = 1 << 11


class Walk:
    """The embedding of windows of one size: which places of it make the key, and the walk's random bits.

    The embedding of a window writes, in every step, the word the walk stands on, and then goes one word on or stays, by a
    random bit of the step and the word.  Two windows at a small edit distance fall into step again after an edit, so
    their embeddings differ in few places.  Past its last word a window's embedding is blank.  The windows are so small that
    all places are taken: equal windows have equal keys, and few others do.
    """

    def __init__(self, size: int):
        draw = np.random.default_rng([size, 0])
        self.size, self.places = size, list(range(3 * size))
        self.salts = [U64(int(x)) for x in draw.integers(1, 1 << 63, 3 * size // 64 + 1)]

    def bits(self, words: np.ndarray) -> list[np.ndarray]:
        return [mix(words ^ salt) for salt in self.salts]

    def keys(self, words: np.ndarray, start: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray]:
        """Key of every window, by the words at the sampled places; ``keep(level, keys)`` may drop windows on the way."""
        bits = self.bits(words)
        blank = U64(0x5BF0_3635)
        last = len(words) - 1
        at, key = start, np.zeros(len(start), dtype=U64)
        step = 0
        for level, place in enumerate(self.places):
            while step < place:
                bit = (bits[step // 64][np.minimum(at, last)] >> U64(step % 64)) & U64(1)
                at = np.minimum(at + bit.astype(np.int64), start + self.size)
                step += 1
            word = np.where(at < start + self.size, words[np.minimum(at, last)], blank)
            key = mix(key * U64(0x9E3779B97F4A7C15) + word)
            if keep is not None:
                good = keep(level, key)
                start, at, key = start[good], at[good], key[good]
        return start, key


def most_edits(n: int, similarity: float) -> int:
    """The edits (in words) at which an item of ``n`` words is still held."""
    return int((1 - similarity) * n + 1e-9)


def window_size(n: int, edits: int) -> int:
    """The words of a window, of which an item of ``n`` words has one more than it may have edits."""
    return n // (edits + 1)


def offsets(n: int, edits: int) -> list[int]:
    """Where the windows of an item begin.  They are apart, so an edit falls into one at most and one is left as it was."""
    return [i * n // (edits + 1) for i in range(edits + 1)]


class Index:
    """Keys of all windows of all items, for each window size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float):
        self.items = items
        #: For each item, which low bits its words have.
        self.has = np.zeros((len(items), WORD_SIEVE), dtype=bool)
        for i, (_, words) in enumerate(items):
            self.has[i, words & U64(WORD_SIEVE - 1)] = True
        by_size = defaultdict(list)
        for i, (_, words) in enumerate(items):
            edits = most_edits(len(words), similarity)
            for offset in offsets(len(words), edits) if len(words) else []:
                by_size[window_size(len(words), edits)].append((i, offset))
        self.tables = []
        text = np.concatenate([w for _, w in items]) if items else np.zeros(0, dtype=U64)
        base = np.append(0, np.cumsum([len(w) for _, w in items])).astype(np.int64)
        for size, places in sorted(by_size.items()):
            start = np.array([base[i] + o for i, o in places], dtype=np.int64)
            walk = Walk(size)
            levels: list[tuple[np.ndarray, np.ndarray]] = []

            def note(level, key, levels=levels):
                sieve = np.zeros(SIEVE, dtype=bool)
                sieve[key & U64(SIEVE - 1)] = True
                levels.append((sieve, np.unique(key)))
                return np.ones(len(key), dtype=bool)

            _, key = walk.keys(text, start, note)
            order = np.argsort(key, kind="stable")
            self.tables.append((walk, levels, key[order], [places[o] for o in order]))

    def likely(self, i: int, words: np.ndarray, starts: list[int], edits: int, low: int, high: int) -> list[int]:
        """The starts around which the text has as many words of the item as are left after the edits; no others can hold it."""
        n = len(self.items[i][1])
        begin, end = max(low, starts[0] - edits), min(high, starts[-1] + n + edits)
        before = np.zeros(end - begin + 1, dtype=np.int64)
        np.cumsum(self.has[i][words[begin:end] & U64(WORD_SIEVE - 1)], out=before[1:])
        at = np.array(starts)
        shared = before[np.minimum(at + n + edits, high) - begin] - before[np.maximum(at - edits, low) - begin]
        return at[shared >= n - edits].tolist()

    def candidates(self, words: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """Text, item and place of the item's first word, for all windows of the chunk's texts that share a key with one."""
        found = set()
        if not len(words):
            return found
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for walk, levels, keys, places in self.tables:
            n = len(words) - walk.size + 1
            if n <= 0:
                continue
            start = np.arange(n)
            start = start[start + walk.size <= first[text[:n] + 1]]

            def known(level, key, levels=levels):
                sieve, exact = levels[level]
                good = sieve[key & U64(SIEVE - 1)]
                maybe = np.flatnonzero(good)
                at = np.minimum(np.searchsorted(exact, key[maybe]), len(exact) - 1)
                good[maybe] = exact[at] == key[maybe]
                return good

            start, key = walk.keys(words, start, known)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for s, a, b in zip(start.tolist(), low.tolist(), high.tolist()):
                for item, offset in places[a:b]:
                    found.add((int(text[s]), item, s - offset))
        return found


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest number of edits (in words) from the item to any run of words of the text, and where that run ends."""
    column = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for word in item:
        change = np.empty_like(row)
        change[0] = row[0] + 1
        change[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(change - column) + column
    end = int(row.argmin())
    return int(row[end]), end


def runs_of(starts: list[int], n: int, edits: int, low: int, high: int) -> list[tuple[int, int]]:
    """The parts of a text (from ``low`` to ``high``) that can hold an item whose first word is near one of the starts."""
    out: list[tuple[int, int]] = []
    for start in starts:
        a, b = max(low, start - edits), min(high, start + n + edits)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for chunk in chunks(pc.utf8_lower(pa.array(texts, pa.string()))):
        h, first = chunk.word_hashes(), chunk.words[2]
        out += [h[a:b] for a, b in zip(first, first[1:])]
    return out


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, distance, similarity``: every pair of a document and an item it holds a near copy of.

    Words are runs of anything but space and the characters 9 to 13, lower-cased.  A document holds an item if a run of
    its words is at an edit distance of at most ``(1 - similarity)`` times the item's words.  An item has one more window
    than that many edits, apart from each other, so wherever it is held a window stands unchanged; equal windows have equal
    keys, so no pair is missed.  Every run of a text around a window of equal key is compared exactly, so a pair reported is
    right and its distance the smallest.  Items are the stated query set: they are taken in blocks of about ``BLOCK_ITEMS``,
    each compared with all texts.  Items without words match nothing; null texts
    are empty; rows that repeat an id count as one document.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    arrow_rows(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, similarity double"
    query = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-query.count() // BLOCK_ITEMS))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in range(blocks):
        rows = query.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        part = texts.mapInArrow(_matcher([r["item_id"] for r in rows], [r["text"] for r in rows], similarity), schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("similarity").alias("similarity"))


def _matcher(ids: list, texts: list[str | None], similarity: float):
    def run(batches):
        items = [(i, w) for i, w in zip(ids, _words(texts)) if len(w)]
        index = Index(items, similarity)
        for batch in batches:
            docs, names, distances = [], [], []
            for chunk in chunks(pc.utf8_lower(batch.column(1))):
                words, first = chunk.word_hashes(), chunk.words[2]
                best: dict[tuple[int, int], int] = {}
                starts = defaultdict(list)
                for row, i, start in sorted(index.candidates(words, first)):
                    starts[row, i].append(start)
                for (row, i), places in starts.items():
                    item = items[i][1]
                    most = most_edits(len(item), similarity)
                    low, high = int(first[row]), int(first[row + 1])
                    if any(low <= s <= high - len(item) and np.array_equal(words[s : s + len(item)], item) for s in places):
                        best[row, i] = 0
                        continue
                    places = index.likely(i, words, places, most, low, high)
                    if not places:
                        continue
                    distance = min(edit_distance_within(item, words[a:b])[0] for a, b in runs_of(places, len(item), most, low, high))
                    if distance <= most:
                        best[row, i] = distance
                for (row, i), distance in best.items():
                    docs.append(row + chunk.rows[0])
                    names.append(i)
                    distances.append(distance)
            size = [len(items[i][1]) for i in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs, pa.int64())), pa.array([items[i][0] for i in names]).cast(pa.int64()) if names else pa.array([], pa.int64()),
                 pa.array(distances, pa.int32()), pa.array([1 - d / n for d, n in zip(distances, size)], pa.float64())],
                names=["doc_id", "item_id", "distance", "similarity"],
            )

    return run


def clean(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item; a null id is kept, as no leak can be told of it."""
    # Stored, so that the join knows how few ids there are and does not move the texts.
    found = cut_lineage(leaks(docs, items, text, id_col, **options).select(F.col("doc_id").alias("__leaked")).where("__leaked is not null").distinct())
    return docs.join(found, docs[id_col] == found["__leaked"], "left_anti")
