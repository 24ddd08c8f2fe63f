"""Token ids in files: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

A folder holds one file per range of documents, in ascending order of ids.  A file is a sequence of records, each ended by
a line feed (the writer's row separator), so that Spark's text writer, with its commit protocol, can write it on any file
system.  All numbers are little-endian but the code bits, which are packed from the highest bit of 32-bit words on:

* one code record: ``HFC1``, u32 length of the rest, u32 longest code, u32 number of kinds, the u32 ids that have a code in
  ascending order, a u8 code length for each.  Lengths are all a canonical code needs.
* block records: ``HFB1``, u32 length of the rest, u32 documents, u32 ids, u32 code words, u32 checkpoints; for each document its
  i64 id, u32 number of ids in this block and u8 flags (1: the id is null, 2: begun in an earlier block); the u32 bit offset of
  every :data:`CHECK`-th id; the code words.  A block can be decoded without any other, and from any checkpoint on.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbook.llm.text import CHUNK_BYTES, IS_SPACE, LOWER, Chunk, arrow_rows, chunks
from tarnbook.session import cut_lineage, scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
LONGEST_CODE = 16  # bits, or as many as the number of kinds needs
CHECK = 256  # ids between checkpoints
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22  # ids in a file, about
REMEMBERED = 1_200_000  # pieces whose ids a worker keeps; only the speed depends on it
ENCODE_BATCH = 1 << 14

_MARKS = ".,;:!?"
_IS_MARK, _IS_LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_IS_MARK[[ord(m) for m in _MARKS]] = True
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SMALL = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+").fullmatch
_BETWEEN = "\x01"
_CODE, _BLOCK = b"HFC1", b"HFB1"
_DOC = np.dtype([("id", "<i8"), ("n", "<u4"), ("flags", "u1")])
_NULL, _GOES_ON = 1, 2


def public_path(name: str) -> str:
    """The place of a public vocabulary on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- tokens -----------------------------------------------------------------------------------------------------------


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


class Tokens:
    """Ids of whole texts by a tokenizer that splits at white space and drops it.

    Each different piece between white space is encoded once by the tokenizer and remembered; the ids of a text are those
    of its pieces in a row.  A mark that ends a word is a piece of its own, as the tokenizer parts it from letters anyhow.  Pieces are
    lower-cased (A-Z) before the look-up where the tokenizer lower-cases; pieces with a bar may hold a special
    token, which is told by its case, and stay as they are.  Pieces of small letters go straight to the tokenizer's model,
    others to the tokenizer many at a time.  All of this is tried out on a few texts when a tokenizer is loaded.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        one, two, both = (self._ids(t) for t in ("Some", "text.", " Some\t\ntext. "))
        if one + two != both:
            raise ValueError("the tokenizer must split at white space and drop it")
        self.most = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.folds = self._ids("sOmE") == one
        self.marks = all(self._ids(f"it's{m}") == self._ids("it's") + self._ids(m) for m in _MARKS)
        letters = _byte_letters()
        self.as_bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}
        self.direct = all(self._straight(w) == self._ids(w) for w in ("some", "letter", "straße", "français", "øùúûüýþÿ", "öõôóòñðïîíìëêéèçæåäãâáàß"))
        found = self._ids(_BETWEEN)
        self.between = found[0] if len(found) == 1 else None
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _straight(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.as_bytes))]

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece."""
        out: list[list[int] | None] = [None] * len(pieces)
        joined = []
        for k, piece in enumerate(pieces):
            if self.direct and _SMALL(piece):
                out[k] = self._straight(piece)
            elif self.between is None or _BETWEEN in piece:
                out[k] = self._ids(piece)
            else:
                joined.append(k)
        groups = [joined[at : at + 64] for at in range(0, len(joined), 64)]
        texts = [f" {_BETWEEN} ".join(pieces[k] for k in group) for group in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = found.ids
            at = 0
            for k in group[:-1]:
                to = ids.index(self.between, at)
                out[k], at = ids[at:to], to + 1
            out[group[-1]] = ids[at:]
        return out

    def learn(self, pieces: list[bytes]) -> None:
        new = [p for p in pieces if p not in self.slot]
        if not new:
            return
        found, sizes = [self.pool], []
        for at in range(0, len(new), ENCODE_BATCH):
            ids = self._encoded([p.decode("utf-8", "replace") for p in new[at : at + ENCODE_BATCH]])
            sizes.extend(map(len, ids))
            found.append(np.fromiter((i for e in ids for i in e), dtype=np.uint32))
        self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.pool = np.concatenate(found)

    def of(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts in a row, and where those of each text begin (and end)."""
        starts, ends, before = chunk.words
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(before), dtype=np.int64)
        inside = ~IS_SPACE[chunk.data]
        data = chunk.data
        bars = np.unique(np.searchsorted(starts, np.flatnonzero(data == 0x7C), "right") - 1)
        if self.marks:
            marked = (ends - starts > 1) & _IS_MARK[data[ends - 1]] & _IS_LETTER[data[ends - 2]]
            marked[bars] = False
            parts = ends[marked] - 1
            whole = starts[bars], ends[bars]
            starts, ends = np.sort(np.append(starts, parts)), np.sort(np.append(ends, parts))
            before = np.searchsorted(starts, chunk.bounds)
        else:
            whole = starts[bars], ends[bars]
        if self.folds:
            data = LOWER[data]
            for a, b in zip(*(w.tolist() for w in whole)):
                data[a:b] = chunk.data[a:b]
        offsets = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
        kinds = words.dictionary_encode()
        pieces = kinds.dictionary.to_pylist()
        if len(self.slot) > REMEMBERED:
            self.clear()
        self.learn(pieces)
        slots = np.fromiter(map(self.slot.__getitem__, pieces), dtype=np.int64, count=len(pieces))[kinds.indices.to_numpy()]
        sizes = (self.starts[1:] - self.starts[:-1])[slots]
        upto = np.append(0, np.cumsum(sizes))
        return self.pool[np.repeat(self.starts[slots] - upto[:-1], sizes) + np.arange(upto[-1])], upto[before]


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int | None = END_ID, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id long, thash long, uid long, n long, ids binary`` of every text, ``end_id`` after its last id.

    Ids are unsigned little-endian numbers of two bytes where all ids of the vocabulary fit, else of four.  A null text is an
    empty one.  Texts of any length are encoded whole.  The vocabulary is looked up by name on the executors.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("thash"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text")
    )
    tail = [] if end_id is None else [end_id]

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for every core already
        tokens = _tokens(public_path(vocabulary))
        kind = "<u2" if max([tokens.most, *tail]) < 1 << 16 else "<u4"
        for batch in batches:
            for chunk in chunks(batch.column("text"), 4 * CHUNK_BYTES):
                ids, bounds = tokens.of(chunk)
                bodies = [np.append(ids[a:b], tail).astype(kind).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                part = batch.slice(chunk.rows[0], chunk.rows[1] - chunk.rows[0])
                n = pa.array(bounds[1:] - bounds[:-1] + len(tail), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(k) for k in ("doc_id", "thash", "uid")] + [n, pa.array(bodies, pa.binary())], names=["doc_id", "thash", "uid", "n", "ids"])

    return rows.mapInArrow(ids_of, "doc_id long, thash long, uid long, n long, ids binary")


def _ids_of(body: pa.BinaryScalar, n: int) -> np.ndarray:
    raw = body.as_buffer()
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs.  A task sums up its rows first; the result is bounded by the vocabulary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for body, n in zip(batch.column("ids"), batch.column("n").to_pylist()):
                found = np.bincount(_ids_of(body, n))
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), dtype=np.int64))
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return tokens.select("n", "ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- the code ---------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``longest`` bits, by package-merge.

    Every round pairs up the cheapest things so far, the symbols anew among them; a symbol's length is the number of rounds
    in which it is among the cheapest 2(n - 1) of the last round, taken apart round by round.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.uint8)
    if 1 << longest < n:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    single = counts[order].astype(np.int64)
    pairs, symbols_upto = np.zeros(0, dtype=np.int64), []
    for _ in range(longest):
        things = np.concatenate([single, pairs])
        cheap = np.argsort(things, kind="stable")
        symbols_upto.append(np.cumsum(cheap < n))
        things = things[cheap]
        pairs = things[: len(things) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * (n - 1)
    for upto in reversed(symbols_upto):
        if not take:
            break
        symbols = int(upto[take - 1])
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out = np.empty(n, dtype=np.uint8)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter codes first, ids of one length in ascending order, codes counting up."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, longest: int):
        self.ids, self.lengths, self.longest = np.asarray(ids, dtype=np.int64), np.asarray(lengths, dtype=np.int64), longest
        order = np.lexsort((self.ids, self.lengths))
        self.sorted_ids, self.sorted_lengths = self.ids[order], self.lengths[order]
        # Seen as the upper bits of a number of ``longest`` bits, a code begins where the one before it ends.
        room = np.left_shift(np.int64(1), longest - self.sorted_lengths)
        begin = np.cumsum(room) - room
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        self.code[self.sorted_ids] = np.right_shift(begin, longest - self.sorted_lengths).astype(np.uint64)
        self.length[self.sorted_ids] = self.sorted_lengths
        self.room = room

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray, longest: int = LONGEST_CODE) -> Code:
        longest = max(longest, int(max(1, len(ids)) - 1).bit_length())
        order = np.argsort(ids)
        return cls(np.asarray(ids)[order], code_lengths(np.asarray(counts)[order], longest), longest)

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length by the next ``longest`` bits."""
        ids, lengths = np.zeros(1 << self.longest, dtype=np.uint32), np.ones(1 << self.longest, dtype=np.int64)
        used = int(self.room.sum())
        ids[:used], lengths[:used] = np.repeat(self.sorted_ids, self.room), np.repeat(self.sorted_lengths, self.room)
        return ids, lengths

    def record(self) -> bytes:
        return _record(_CODE, struct.pack("<II", self.longest, len(self.ids)) + self.ids.astype("<u4").tobytes() + self.lengths.astype("u1").tobytes())

    @classmethod
    def read(cls, body: memoryview) -> Code:
        longest, n = struct.unpack_from("<II", body)
        return cls(np.frombuffer(body, "<u4", n, 8), np.frombuffer(body, "u1", n, 8 + 4 * n), longest)

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit code words of some ids, and the bit offset of every :data:`CHECK`-th id."""
        length = self.length[ids]
        upto = np.cumsum(length)
        at = upto - length
        word = at >> 5
        bits = self.code[ids] << (64 - (at & 31) - length).astype(np.uint64)
        n = int(upto[-1] + 31) >> 5 if len(ids) else 0
        # No two codes share a bit, so that sums below 2^32 are exact as doubles.
        words = np.bincount(word, (bits >> np.uint64(32)).astype(np.float64), n + 1) + np.bincount(word + 1, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[: n + 1]
        return words[:n].astype("<u4"), at[::CHECK].astype("<u4")

    def unpack(self, words: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids from each of some bit offsets on, ``sizes`` of them, in a row.  All offsets are followed at the same time."""
        by_bits, lengths = self.table
        padded = np.append(words, np.zeros(2, dtype=np.uint32)).astype(np.uint64)
        pairs = (padded[:-1] << np.uint64(32)) | padded[1:]
        at, most, last = offsets.astype(np.int64), int(sizes.max(initial=0)), len(pairs) - 1
        out, mask = np.empty((most, len(at)), dtype=np.uint32), np.uint64((1 << self.longest) - 1)
        for k in range(most):
            bits = (pairs[np.minimum(at >> 5, last)] >> (64 - self.longest - (at & 31)).astype(np.uint64)) & mask
            out[k] = by_bits[bits]
            at += lengths[bits]
        return out.T[np.arange(most) < sizes[:, None]]


def _record(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body


def block_record(code: Code, docs: np.ndarray, ids: np.ndarray) -> bytes:
    words, checks = code.pack(ids)
    return _record(_BLOCK, struct.pack("<IIII", len(docs), len(ids), len(words), len(checks)) + docs.tobytes() + checks.tobytes() + words.tobytes())


def records(content: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """Kind and body of each record of a file."""
    at = 0
    while at < len(content):
        kind, (size,) = bytes(content[at : at + 4]), struct.unpack_from("<I", content, at + 4)
        body = content[at + 8 : at + 8 + size]
        if kind not in (_CODE, _BLOCK) or len(body) < size:
            raise ValueError(f"no record at byte {at}")
        yield kind, body
        at += 9 + size


def read_block(code: Code, body: memoryview, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a block and its ids from ``first`` to ``last``, decoded from the checkpoint before ``first`` on."""
    n_docs, n, n_words, n_checks = struct.unpack_from("<IIII", body)
    docs = np.frombuffer(body, _DOC, n_docs, 16)
    checks = np.frombuffer(body, "<u4", n_checks, 16 + docs.nbytes)
    words = np.frombuffer(body, "<u4", n_words, 16 + docs.nbytes + checks.nbytes)
    last = n if last is None else min(last, n)
    lanes = np.arange(first // CHECK, -(-last // CHECK))
    ids = code.unpack(words, checks[lanes], np.minimum(CHECK, last - lanes * CHECK)) if len(lanes) else np.zeros(0, dtype=np.uint32)
    return docs, ids[first - first // CHECK * CHECK :]


# --- files ------------------------------------------------------------------------------------------------------------


def write_ids(tokens: DataFrame, path: str, longest: int = LONGEST_CODE, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> str:
    """Write ``tokens`` (a stored table as of :func:`encoded`) to files below ``path`` in ascending order of ids.

    A null id comes first; rows that share an id are ordered by a hash of their text.  The driver sees the id counts, which the
    vocabulary bounds.  A document goes to one file, in as many blocks as it needs; an empty table gives files without blocks.
    """
    found = id_counts(tokens).toArrow()
    ids, counts = (found.column(k).to_numpy() for k in ("id", "n"))
    code = Code.of(ids, counts, longest)
    parts = max(1, -(-int(counts.sum()) // file_ids))
    ordered = tokens.repartitionByRange(parts, "doc_id", "thash", "uid").sortWithinPartitions("doc_id", "thash", "uid")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, docs, bodies, held = code.record(), [], [], 0

        def record() -> pa.RecordBatch:
            nonlocal head, held
            out = head + (b"\n" if head else b"") + block_record(code, np.array(docs, dtype=_DOC), np.concatenate(bodies).astype(np.int64))
            head, held = b"", 0
            docs.clear()
            bodies.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["value"])

        for batch in batches:
            for doc, n, body in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                rest, flags = _ids_of(body, n), _NULL if doc is None else 0
                while True:
                    now, rest = rest[: block_ids - held], rest[block_ids - held :]
                    docs.append((doc or 0, len(now), flags))
                    bodies.append(now)
                    held += len(now)
                    flags |= _GOES_ON
                    if held == block_ids:
                        yield record()
                    if not len(rest):
                        break
        if docs:
            yield record()

    records_ = ordered.select("doc_id", "n", "ids").mapInArrow(blocks, "value binary")
    records_.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``file, content``: the files in the order of their ranges."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``file, place, doc_id, start, n_tokens, ids_crc32`` of every document in the files below ``path``; ``ids`` if asked for.

    ``start`` counts the ids of all documents before it.  A file is decoded block by block in one task; what lies before a
    file comes from one row of sums per file.
    """
    schema = "file long, place long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def documents(file: int, content: memoryview) -> Iterator[tuple]:
        code, now, at = None, None, 0
        for kind, body in records(content):
            if kind == _CODE:
                code = Code.read(body)
                continue
            docs, ids = read_block(code, body)
            raw, to = memoryview(ids.astype("<u4").tobytes()), 0
            for doc, n, flags in docs.tolist():
                mine, to = raw[4 * to : 4 * (to + n)], to + n
                if flags & _GOES_ON:
                    now[3], now[4] = now[3] + n, zlib.crc32(mine, now[4])
                else:
                    if now:
                        yield now
                    now = [0 if now is None else now[0] + 1, None if flags & _NULL else doc, at, n, zlib.crc32(mine), []]
                at += n
                if with_ids:
                    now[5].append(np.frombuffer(mine, "<u4").astype(np.int64))
        if now:
            yield now

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + ([pa.list_(pa.int64())] if with_ids else [])
        names = ["file", "place", "doc_id", "at", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows: list[tuple] = []
                for row in documents(file, memoryview(content.as_buffer())):
                    rows.append((file, *row[:5]) + ((np.concatenate(row[5]),) if with_ids else ()))
                    if len(rows) == (1000 if with_ids else 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    found = cut_lineage(_files(spark, path).mapInArrow(decoded, schema))
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sums = sums.select("file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    rest = ["ids"] if with_ids else []
    return found.join(sums, "file").select("file", "place", "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *rest)


def stored_ids(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int | None = END_ID, text: str = "text", id_col: str = "doc_id", path: str | None = None, **sizes: int) -> str:
    """Encode all texts and write their ids to files; gives the folder."""
    tokens = encoded(docs, vocabulary, end_id, text, id_col)
    place = scratch_path(docs.sparkSession, "tokens")
    tokens.write.option("compression", "zstd").parquet(place)
    return write_ids(docs.sparkSession.read.schema(tokens.schema).parquet(place), path or scratch_path(docs.sparkSession, "ids"), **sizes)
