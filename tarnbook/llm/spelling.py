"""Spelling variants of a corpus' words by a trie over letter-group counts.

A word is seen as a vector: how often it has each of some groups of letters.  One inserted, deleted or replaced letter changes
that vector by one surplus and one deficit at most.  Words are arranged in a trie whose levels are the successive counts;
a depth-first search from the root spends the budget of one surplus and one deficit on the way down, and only the words
of the leaves it reaches are compared letter by letter.

The trie is cut where a node has few enough words.  The upper part is small and is sent to all tasks; the words go down it
with the same search to the nodes below the cut, each of which is built and searched in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.llm.text import LOWER, arrow_rows, chunks
from tarnbook.session import cut_lineage

LEAST_LETTERS = 7
LEAST_COUNT = 2
DELETED_EVERY = 31
TIMES = 10
#: The levels of the trie, from the root on; other letters follow, by code point modulo 4.
GROUPS = "e a i o n t r s h d l c u m gq pb fw vy kjxz".split()
LEVELS = len(GROUPS) + 4
BLOCK_WORDS = 1 << 15
MOST_BLOCKS = 1 << 15
FLUSH_WORDS = 1 << 19
FRONTIER = 1 << 20
CROWDED = 64  # words of a leaf from which on they are looked up by halves
WIDE = 32  # letters; longer words are compared one by one
LONG_RUN = 64  # bytes; the crc32 of longer runs is taken one by one

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_GROUP = np.array([next((g for g, s in enumerate(GROUPS) if chr(c) in s), len(GROUPS) + c % 4) for c in range(256)])


# --- words ------------------------------------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    """crc32 of every byte after a zero state, from the library's own function."""
    return np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


def _crcs(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of many byte ranges, each going on from a crc32 of what stands before it; one byte of all of them at a time."""
    long = ends - starts > LONG_RUN
    if long.any():
        out = np.empty(len(starts), dtype=np.uint32)
        out[~long] = _crcs(states[~long], data, starts[~long], ends[~long])
        out[long] = [zlib.crc32(data[a:b].tobytes(), s) for s, a, b in zip(states[long].tolist(), starts[long].tolist(), ends[long].tolist())]
        return out
    table, state = _crc_table(), states ^ np.uint32(0xFFFFFFFF)
    left = np.argsort(starts - ends, kind="stable")  # longest first, so that those still running are a prefix
    sizes = (ends - starts)[left]
    begin, at = starts[left], state[left]
    for k in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -k, "left"))
        at[:n] = table[(at[:n] ^ data[begin[:n] + k]) & np.uint32(0xFF)] ^ (at[:n] >> np.uint32(8))
    out = np.empty_like(at)
    out[left] = at
    return out ^ np.uint32(0xFFFFFFFF)


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of the letters A-Z, a-z and U+00C0 to U+00FF (the bytes C3 and what follows)."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    return starts, ends


def _words_of(data: np.ndarray, bounds: np.ndarray, ids: list[str], least: int, every: int) -> pa.Array:
    """The words of some texts: letter runs with the marked ones shortened, those with enough letters."""
    starts, ends = _runs(data, bounds)
    if not len(starts):
        return pa.array([], pa.binary())
    data = LOWER[data]
    head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    h = _crcs(head[np.searchsorted(bounds, starts, "right") - 1], data, starts, ends)
    letter = (data & 0xC0) != 0x80  # the first byte of a code point
    rank = np.append(0, np.cumsum(letter))
    length = rank[ends] - rank[starts]
    keep = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    if every:
        marked = np.flatnonzero(h % np.uint32(every) == 0)
        place = np.flatnonzero(letter)[rank[starts[marked]] + h[marked] % length[marked]]
        keep[place] = False
        keep[place[data[place] == 0xC3] + 1] = False
        length[marked] -= 1
    sizes = np.add.reduceat(keep, starts, dtype=np.int64)
    # reduceat sums up to the next start: between two runs nothing is kept.
    offsets = np.append(0, np.cumsum(sizes))
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of letters in one text")
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[keep].tobytes())])
    return words.filter(pa.array(length >= least))


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = DELETED_EVERY) -> DataFrame:
    """``word, n``: distinct words of all whole texts and their number.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  Where ``every`` divides the crc32 of
    ``<id>:<word>`` the word loses the code point at that crc32 modulo its length (``every`` 0: none does).  Null texts have none,
    a null id is an empty one, repeated rows count as often as they are there.  Tasks count before the shuffle.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(found: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from found.set_column(0, "word", found.column("word").cast(pa.string())).select(["word", "n"]).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for chunk in chunks(batch.column("text")):
                words = _words_of(chunk.data, chunk.bounds, ids[slice(*chunk.rows)], least_letters, every)
                found = pc.value_counts(words)
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                if sum(t.num_rows for t in held) > 2 * FLUSH_WORDS:
                    held = [flush()]
                    if held[0].num_rows > FLUSH_WORDS:
                        yield from out(held.pop())
        if held:
            yield from out(flush())

    found = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_count)


# --- the trie ---------------------------------------------------------------------------------------------------------


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words in Latin-1 as one array of letters, and where each begins (and end)."""
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))))


def vectors(words: list[bytes]) -> np.ndarray:
    """The letter-group counts of words, one row each; counts stop at 255, which never makes two vectors less alike."""
    letters, bounds = _flat(words)
    cell = np.repeat(np.arange(len(words)), np.diff(bounds)) * LEVELS + _GROUP[letters]
    counts = np.bincount(cell, minlength=len(words) * LEVELS).reshape(len(words), LEVELS)
    return np.minimum(counts, 255).astype(np.uint8)


class Trie:
    """A trie over rows of counts: at each level the count of every node, and where its children begin."""

    def __init__(self, rows: np.ndarray, depths: np.ndarray | None = None):
        """``rows`` in lexicographic order, distinct; with ``depths`` a row ends after so many levels and is a leaf there."""
        self.levels = rows.shape[1]
        first = np.zeros(len(rows), dtype=np.int64)  # the level from which on a row differs from the one before
        if len(rows) > 1:
            differs = rows[1:] != rows[:-1]
            first[1:] = np.argmax(differs, axis=1)
        depths = np.full(len(rows), self.levels) if depths is None else depths
        self.counts, self.children, self.leaf, begins = [], [], [], []
        for level in range(self.levels):
            # A node begins where a row that is long enough differs at this level or before it.
            begin = np.flatnonzero((depths > level) & ((first <= level) | (np.arange(len(rows)) == 0)))
            begins.append(begin)
            self.counts.append(rows[begin, level].astype(np.int16))
            self.leaf.append(np.where(depths[begin] == level + 1, begin, -1))
        for level in range(self.levels - 1):
            ends = np.append(begins[level][1:], len(rows))
            low = np.searchsorted(begins[level + 1], begins[level])
            self.children.append((low, np.searchsorted(begins[level + 1], ends)))

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``queries`` and leaves with one surplus and one deficit between them at most.

        The search is depth-first in portions: a portion goes one level down at a time; one that grows beyond
        :data:`FRONTIER` is split, and the halves follow one after the other.
        """
        if not len(queries) or not self.counts or not len(self.counts[0]):
            return
        step = max(1, FRONTIER // len(self.counts[0]))
        stack = []
        for at in range(0, len(queries), step):
            to = min(len(queries), at + step)
            q = np.repeat(np.arange(at, to), len(self.counts[0]))
            stack.append((0, q, np.tile(np.arange(len(self.counts[0])), to - at), np.zeros(len(q), np.int8), np.zeros(len(q), np.int8)))
        stack.reverse()
        while stack:
            level, q, node, more, less = stack.pop()
            diff = queries[q, level].astype(np.int16) - self.counts[level][node]
            more, less = more + np.maximum(diff, 0), less + np.maximum(-diff, 0)
            ok = (more <= 1) & (less <= 1)
            q, node, more, less = q[ok], node[ok], more[ok].astype(np.int8), less[ok].astype(np.int8)
            leaf = self.leaf[level][node]
            done = leaf >= 0
            if done.any():
                yield q[done], leaf[done]
                q, node, more, less = q[~done], node[~done], more[~done], less[~done]
            if not len(q):
                continue
            low, high = (c[node] for c in self.children[level])
            n = high - low
            upto = np.cumsum(n)
            child = np.repeat(low - upto + n, n) + np.arange(upto[-1])
            q, more, less = np.repeat(q, n), np.repeat(more, n), np.repeat(less, n)
            parts = -(-len(q) // FRONTIER)
            for part in range(parts - 1, -1, -1):
                cut = slice(part * len(q) // parts, (part + 1) * len(q) // parts)
                stack.append((level + 1, q[cut], child[cut], more[cut], less[cut]))


def _one_apart(a: bytes, b: bytes) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first :data:`WIDE` letters of words, zeros after them, and the lengths."""
    letters, bounds = _flat(words)
    sizes = np.diff(bounds)
    out = np.zeros((len(words), WIDE + 1), dtype=np.uint8)
    row, column = np.repeat(np.arange(len(words)), sizes), np.arange(len(letters)) - np.repeat(bounds[:-1], sizes)
    short = column < WIDE
    out[row[short], column[short]] = letters[short]
    return out, sizes


class Block:
    """The words below some node: their trie, and what verifies them."""

    def __init__(self, words: list[bytes]):
        rows = vectors(words)
        order = np.lexsort(rows.T[::-1])
        self.words = [words[k] for k in order]
        rows = rows[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1)) if len(rows) else np.zeros(0, dtype=bool)
        self.begin = np.append(np.flatnonzero(new), len(rows))
        self.trie = Trie(rows[new])
        self.matrix, self.sizes = _matrix(self.words)
        self._halves: dict[int, dict[tuple[bool, bytes], list[int]]] = {}

    def _by_half(self, leaf: int, word: bytes) -> set[int]:
        """The words of a crowded leaf that share a half with ``word``: one edit leaves the first or the last half as it is."""
        if leaf not in self._halves:
            table: dict[tuple[bool, bytes], list[int]] = {}
            for k in range(self.begin[leaf], self.begin[leaf + 1]):
                for key in _halves(self.words[k]):
                    table.setdefault(key, []).append(k)
            self._halves[leaf] = table
        return {k for key in _halves(word) for k in self._halves[leaf].get(key, ())}

    def near(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``words`` and in the block of the pairs that are one letter apart."""
        matrix, sizes = _matrix(words)
        for q, leaf in self.trie.search(vectors(words)):
            crowded = self.begin[leaf + 1] - self.begin[leaf] > CROWDED
            pairs = [(a, k) for a, l in zip(q[crowded].tolist(), leaf[crowded].tolist()) for k in self._by_half(l, words[a])]
            q, leaf = q[~crowded], leaf[~crowded]
            n = self.begin[leaf + 1] - self.begin[leaf]
            upto = np.append(0, np.cumsum(n))
            a, b = np.repeat(q, n), np.repeat(self.begin[leaf] - upto[:-1], n) + np.arange(upto[-1])
            if pairs:
                more = np.array(pairs, dtype=np.int64)
                a, b = np.append(a, more[:, 0]), np.append(b, more[:, 1])
            for at in range(0, len(a), FRONTIER):
                yield self._verified(words, matrix, sizes, a[at : at + FRONTIER], b[at : at + FRONTIER])

    def _verified(self, words: list[bytes], matrix: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.abs(sizes[a] - self.sizes[b]) <= 1
        a, b = a[ok], b[ok]
        wide = np.maximum(sizes[a], self.sizes[b]) > WIDE
        for k in np.flatnonzero(wide):
            wide[k] = _one_apart(words[a[k]], self.words[b[k]])
        long = np.maximum(sizes[a], self.sizes[b]) > WIDE
        x, y = matrix[a], self.matrix[b]
        swap = sizes[a] > self.sizes[b]
        x[swap], y[swap] = y[swap], x[swap]  # y is the longer one
        equal = sizes[a] == self.sizes[b]
        differs = x != y
        count = differs.sum(axis=1)
        # From the first difference on, the shorter word goes on one letter later in the longer one.
        first = np.where(count > 0, np.argmax(differs, axis=1), WIDE)
        shifted = (x[:, :-1] != y[:, 1:]) & (np.arange(WIDE) >= first[:, None])
        near = np.where(equal, count == 1, ~shifted.any(axis=1))
        near = np.where(long, wide, near)
        return a[near], b[near]


def _halves(word: bytes) -> set[tuple[bool, bytes]]:
    """First and last halves under which a word is found by every word one letter away, whatever their lengths."""
    out = set()
    for n in (len(word) - 1, len(word), len(word) + 1):  # the other word's length
        short = min(n, len(word))
        h = short // 2
        out |= {(True, word[:h]), (False, word[len(word) - (short - h - (n == len(word))) :] if short - h - (n == len(word)) > 0 else b"")}
    return out


# --- the search over all words ----------------------------------------------------------------------------------------


def _keyed(words: DataFrame) -> DataFrame:
    """Words with their count vectors as a binary key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            key = pa.Array.from_buffers(pa.binary(LEVELS), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=[*batch.schema.names, "key"])

    return words.select("word", "n").mapInArrow(keyed, "word string, n long, key binary")


def _prefix(depth: int) -> Column:
    return F.substring("key", 1, depth)


def cut_of(keyed: DataFrame, block_words: int, most_blocks: int) -> list[tuple[bytes, int]]:
    """The cut of the trie: prefixes of nodes with ``block_words`` words at most, or whole keys with more, and their sizes.

    One level is counted at a time, below the nodes that are still too large; the driver sees nodes, not words.  The bound
    grows with the number of words, so that there are some ``most_blocks`` large nodes at most.
    """
    total = keyed.count()
    bound = max(block_words, -(-total // most_blocks))
    done: list[tuple[bytes, int]] = []
    large = [b""] if total else []
    for depth in range(1, LEVELS + 1):
        if not large:
            break
        rows = keyed
        if depth > 1:
            open_ = keyed.sparkSession.createDataFrame([(bytearray(p),) for p in large], "open binary")
            rows = keyed.join(F.broadcast(open_), _prefix(depth - 1) == F.col("open"), "left_semi")
        found = [(bytes(r["node"]), r["n"]) for r in rows.groupBy(_prefix(depth).alias("node")).agg(F.count(F.lit(1)).alias("n")).collect()]
        large = [node for node, n in found if n > bound and depth < LEVELS]
        done += [(node, n) for node, n in found if n <= bound or depth == LEVELS]
    return sorted((node, -(-n // bound)) for node, n in done)


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``word, n_near, near_n, near``: for each of ``words`` (``word, n``; distinct) with a word one letter away, how many there are,
    and the one with the largest n (ties: smallest by code points).

    Letters must be in Latin-1.  A word is stored in one block of the trie and asked for in all blocks its budget reaches.
    A node of more words than a block that cannot be split (words of the very same letter groups) is dealt to several blocks by
    hash, and asked in all of them.  Partial results have one row per word and block.
    """
    spark = words.sparkSession
    keyed = cut_lineage(_keyed(words))
    cut = cut_of(keyed, block_words, most_blocks)
    if not cut:
        return words.select("word", F.lit(None).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near")).limit(0)
    depths = np.array([len(node) for node, _ in cut])
    rows = np.zeros((len(cut), LEVELS), dtype=np.uint8)
    for k, (node, _) in enumerate(cut):
        rows[k, : len(node)] = np.frombuffer(node, dtype=np.uint8)
    shares = np.array([n for _, n in cut])
    firsts = np.append(0, np.cumsum(shares))[:-1]
    top = spark.sparkContext.broadcast((rows, depths, shares, firsts))
    names = ["block", "asks", "word", "n"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, depths, shares, firsts = top.value
        trie = Trie(rows, depths)
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=np.uint8).reshape(-1, LEVELS)
            word, n = batch.column("word"), batch.column("n")
            for q, leaf in trie.search(keys):
                own = (np.where(np.arange(LEVELS) < depths[leaf, None], keys[q], 0) == rows[leaf]).all(axis=1)
                stored = np.flatnonzero(own)
                places = np.array([zlib.crc32(word[int(k)].as_py().encode()) for k in q[stored]], dtype=np.int64) if (shares[leaf[stored]] > 1).any() else np.zeros(len(stored), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(firsts[leaf[stored]] + places % shares[leaf[stored]], pa.int64()), pa.array(np.zeros(len(stored), bool)), word.take(q[stored]), n.take(q[stored])], names=names)
                k = shares[leaf]
                upto = np.append(0, np.cumsum(k))
                block = np.repeat(firsts[leaf] - upto[:-1], k) + np.arange(upto[-1])
                asks = np.repeat(q, k)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.ones(len(asks), bool)), word.take(asks), n.take(asks)], names=names)

    arrow_rows(spark, 10_000)
    routed = keyed.mapInArrow(dealt, "block long, asks boolean, word string, n long")
    # In a partition a block's stored words come first, then those that ask.
    placed = routed.repartition("block").sortWithinPartitions("block", "asks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts, block = None, [], [], None
        for batch in batches:
            ids, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((ids[1:] != ids[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip(np.append(0, edges).tolist(), np.append(edges, len(ids)).tolist()):
                if hi == lo:
                    continue
                words, n = [w.encode("latin-1") for w in batch.column("word")[lo:hi].to_pylist()], batch.column("n")[lo:hi].to_numpy()
                if ids[lo] != now:
                    now, held, counts, block = ids[lo], [], [], None
                if not asks[lo]:
                    held += words
                    counts.append(n)
                    continue
                if not held:
                    continue
                if block is None:
                    block = Block(held)
                    place = {w: k for k, w in enumerate(block.words)}
                    numbers = np.empty(len(held), dtype=np.int64)
                    numbers[[place[w] for w in held]] = np.concatenate(counts)
                    code_order = np.argsort(np.argsort(np.array(block.words, dtype=object), kind="stable"), kind="stable")
                yield from _best(words, block, numbers, code_order)

    found = placed.mapInArrow(searched, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def _best(words: list[bytes], block: Block, numbers: np.ndarray, code_order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each word that has near words in a block."""
    for a, b in block.near(words):
        if not len(a):
            continue
        order = np.lexsort((code_order[b], -numbers[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[k].decode("latin-1") for k in a[first]], pa.string()), pa.array(np.diff(np.append(first, len(a))), pa.int64()),
                pa.array(numbers[b[first]], pa.int64()), pa.array([block.words[k].decode("latin-1") for k in b[first]], pa.string()),
            ],
            names=["word", "n_near", "near_n", "near"],
        )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of the chain of forms, for every word that has a form.

    Chains are halved in every round by looking up a form's form.  They don't run in circles where a form is always the more
    frequent word.
    """
    now = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("__at"), F.col("root").alias("__root"))
        found = cut_lineage(now.join(further, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        now = found.select("word", "root")


def variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = DELETED_EVERY, times: int = TIMES, **sizes: int) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: the corpus' words, how many are one letter away, and the word each is a variant of.

    A word's form is its near word of largest n (ties: smallest by code points) if that is ``times`` its own n at least.
    Empty tables and texts without words give no rows; see :func:`word_counts` for nulls and repeated rows.
    """
    words = cut_lineage(word_counts(docs, text, id_col, least_letters, least_count, every))
    near = near_words(words, **sizes).withColumnRenamed("word", "__word")
    is_form = F.col("near_n") >= F.lit(times) * F.col("n")
    found = words.join(near, F.col("word") == F.col("__word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    found = cut_lineage(found)
    ends = roots(found).select(F.col("word").alias("__word"), "root")
    return found.join(ends, F.col("word") == F.col("__word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
