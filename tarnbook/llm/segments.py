"""Exact search for repeated windows (of bytes or words) by segments.

A window of ``width`` units is represented by the smallest hash of its grams of ``gram`` units.  Windows with the same
content have the same smallest hash, wherever they stand, so equal windows always meet under one key.  Consecutive
windows of a text with one smallest hash are a segment: a row of fixed size for about ``(width - gram) / 2`` windows,
so that what is shuffled is a small part of the text.

1. Segments whose key stands once in all texts are dropped first.  Those left with the same content are one class, told by its
   number of members and its first member.
2. Only where a key has classes with different content are windows compared one by one, on one member of each
   class (:func:`_by_keys`).  Keys are dealt over tasks; the windows of a key with more than ``HOT_WINDOWS`` are dealt by their whole
   content instead (:func:`_by_blocks`), packed by blocks of classes, so that no task holds a hot key.
3. Members get the windows found (:func:`ranges`), texts are joined with them once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.llm.text import Chunk, _byte_values, arrow_rows, chunks, prefix_hashes, range_hashes, window_hashes
from tarnbook.session import cut_lineage

HOT_WINDOWS = 1 << 15
FIRST_SEED, SECOND_SEED = 11, 12

SEGMENT = "doc_id long, thash long, key long, h1 long, h2 long, n int, start int, again boolean"
CLASS = ["key", "h1", "h2", "n"]


def units(chunk: Chunk, unit: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the chunk's bytes or words, and where each text begins among them."""
    if unit == "bytes":
        return chunk.byte_values(seed), chunk.bounds
    return chunk.word_hashes(seed), chunk.words[2]


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values: of a block's rest and the next block's beginning."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    padded = np.full(-(-len(a) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, width)
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    begin = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(rest[:n], begin[width - 1 : width - 1 + n])


def _segments_of(chunk: Chunk, unit: str, width: int, gram: int):
    values, bounds = units(chunk, unit, FIRST_SEED)
    if len(values) < width:
        return None
    sums = prefix_hashes(values)
    grams = window_hashes(sums, gram)
    least = _sliding_min(grams, width - gram + 1)
    n = len(least)
    text = np.searchsorted(bounds, np.arange(n), "right") - 1
    valid = np.arange(n) + width <= bounds[text + 1]
    cut = np.ones(n + 1, dtype=bool)
    cut[1:n] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    good = valid[starts]
    starts, ends = starts[good], ends[good]
    to = ends - 1 + width
    if len(grams) < 1 << 24:
        # The leftmost smallest gram moves on within a segment if one of its windows occurs in it twice.
        leftmost = _sliding_min((grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        again = leftmost[starts] != leftmost[ends - 1]
    else:
        again = np.ones(len(starts), dtype=bool)
    other = prefix_hashes(units(chunk, unit, SECOND_SEED)[0])
    text = text[starts]
    return text, least[starts], range_hashes(sums, starts, to), range_hashes(other, starts, to), ends - starts, starts - bounds[text], again


def segments(docs: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """All segments of all texts (columns ``doc_id, thash, text``); see the module."""
    arrow_rows(docs.sparkSession)
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for chunk in chunks(batch.column(2)):
                found = _segments_of(chunk, unit, width, gram)
                if found is None:
                    continue
                row = pa.array(found[0] + chunk.rows[0])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hashes.take(row), *[pa.array(x.view(np.int64)) for x in found[1:4]], *[pa.array(x.astype(np.int32)) for x in found[4:6]], pa.array(found[6])],
                    names=names,
                )

    return docs.select("doc_id", "thash", "text").mapInArrow(run, SEGMENT)


BODY = "key long, h1 long, h2 long, n int, doc_id long, thash long, start int, body binary"


def _bodies(docs: DataFrame, wanted: DataFrame, unit: str, width: int) -> DataFrame:
    """The content of the wanted segments: their bytes, or 8 bytes of hash for each word."""
    lists = wanted.groupBy("doc_id", "thash").agg(F.collect_list(F.struct(*CLASS, "start")).alias("want"))
    joined = docs.select("doc_id", "thash", "text")
    joined = joined.join(lists, joined["doc_id"].eqNullSafe(lists["doc_id"]) & (joined["thash"] == lists["thash"]), "inner").select(
        joined["doc_id"], joined["thash"], "text", "want"
    )

    def run(batches):
        for batch in batches:
            want = batch.column(3)
            offsets = want.offsets.to_numpy()
            flat = want.flatten()
            fields = {c: flat.field(c).to_numpy() for c in [*CLASS, "start"]}
            offsets = offsets - offsets[0]
            for chunk in chunks(batch.column(2)):
                a, b = chunk.rows
                values, bounds = (chunk.data, chunk.bounds) if unit == "bytes" else units(chunk, unit, FIRST_SEED)
                at = np.arange(offsets[a], offsets[b])
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                size = values.itemsize
                raw = values.tobytes()
                start = (bounds[row - a] + fields["start"][at]).tolist()
                length = (fields["n"][at] + (width - 1)).tolist()
                body = [raw[s * size : (s + n) * size] for s, n in zip(start, length)]
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(fields[c][at]) for c in CLASS], batch.column(0).take(row), batch.column(1).take(row), pa.array(fields["start"][at]), pa.array(body, pa.binary())],
                    names=["key", "h1", "h2", "n", "doc_id", "thash", "start", "body"],
                )

    return joined.mapInArrow(run, BODY)


FOUND = "key long, h1 long, h2 long, n int, low array<int>, high array<int>"
_FOUND = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])


def _runs(flags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true flags that don't cross a segment's start: segment, first and last offset in it."""
    where = np.flatnonzero(flags)
    if not len(where):
        return where, where, where
    seg = np.searchsorted(starts, where, "right") - 1
    new = np.ones(len(where), dtype=bool)
    new[1:] = (np.diff(where) > 1) | (np.diff(seg) > 0)
    low = where[new]
    high = where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)]
    seg = seg[new]
    return seg, low - starts[seg], high - starts[seg]


def _found(classes: pa.Table, flags: np.ndarray) -> list[pa.RecordBatch]:
    """The classes with true flags, of which there is one for each window: the ranges of their windows."""
    n = classes.column("n").to_numpy()
    seg, low, high = _runs(flags, np.cumsum(n, dtype=np.int64) - n)
    if not len(seg):
        return []
    first = np.flatnonzero(np.append(True, np.diff(seg) > 0))
    offsets = np.append(first, len(seg)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (low, high)]
    head = classes.take(pa.array(seg[first]))
    return [pa.RecordBatch.from_arrays([*[head.column(c).combine_chunks() for c in CLASS], *lists], names=[*CLASS, "low", "high"])]


def _by_keys(bodies: DataFrame, judge: Callable, most: int) -> DataFrame:
    """``judge(bodies, lengths, docs)`` over whole keys, many small keys at a time; gives a flag for each window."""
    dealt = bodies.repartition("key").sortWithinPartitions("key", "doc_id", "thash", "start", "h1", "h2")

    def result(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        # A class has one member here; rows of the table that repeat give it more than once.
        heads = np.stack([table.column(c).to_numpy() for c in CLASS])
        new = np.append(True, (heads[:, 1:] != heads[:, :-1]).any(axis=0))
        table = table.filter(pa.array(new[: table.num_rows]))
        n = table.column("n").to_numpy()
        flags = judge(table.column("body").to_pylist(), n, table.column("doc_id").to_numpy(zero_copy_only=False))
        yield from _found(table, flags)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(7).nbytes
            if size < most:
                continue
            last = batch.column(0)[-1].as_py()
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, last, "left"))
            if cut == 0 and len({b.column(0)[0].as_py() for b in held}) == 1:
                continue  # one key only so far
            if cut == 0:
                whole = pa.Table.from_batches(held).combine_chunks()
                keys = whole.column(0).to_numpy()
                cut = int(np.searchsorted(keys, last, "left"))
                yield from result(whole.slice(0, cut).to_batches())
                held = whole.slice(cut).to_batches()
            else:
                yield from result([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
            size = sum(b.column(7).nbytes for b in held)
        if held:
            yield from result(held)

    return dealt.mapInArrow(run, FOUND)


BLOCK_WINDOWS = 1 << 18
ENTRY = np.dtype([("w1", "i8"), ("w2", "i8"), ("doc_id", "i8"), ("thash", "i8"), ("pos", "i4"), ("known", "i1"), ("many", "i1")])
PARTS = pa.list_(pa.struct([("owner", pa.int32()), ("entries", pa.binary())]))
BLOCK = "key array<long>, h1 array<long>, h2 array<long>, n array<int>, entry binary, later binary, parts array<struct<owner: int, entries: binary>>, block long"
ANSWER = "block long, owner int, codes binary"
ALONE, ELSEWHERE, HERE = 0, 1, 2


def _block(table: pa.Table, unit: str, width: int, keep: str, owners: int) -> pa.RecordBatch:
    """Some classes of hot keys: the different windows they have, by owner, and which of them each window is."""
    known = ~table.column("doc_id").is_null().to_numpy()
    doc = table.column("doc_id").fill_null(0).to_numpy()
    thash, start = (table.column(c).to_numpy() for c in ("thash", "start"))
    order = np.lexsort((start, thash, doc, known))
    table, known, doc, thash, start = table.take(pa.array(order)), known[order], doc[order], thash[order], start[order]
    n = table.column("n").to_numpy()
    raw = b"".join(table.column("body").to_pylist())
    if unit == "bytes":
        data = np.frombuffer(raw, dtype=np.uint8)
        both = [_byte_values(seed)[data] for seed in (FIRST_SEED, SECOND_SEED)]
    else:
        words = np.frombuffer(raw, dtype=np.uint64)
        both = [words, (words ^ (words >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)]
    member = np.repeat(np.arange(len(n)), n)
    low = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where = np.arange(n.sum()) + member * (width - 1)
    w1, w2 = (window_hashes(prefix_hashes(x), width)[where] for x in both)
    pos = start[member] + low
    # Windows stand in the order of their places, so the first of an entry has its smallest place.
    owner = (w1 % np.uint64(owners)).astype(np.int32)
    order = np.lexsort((w2, w1, owner))
    new = np.append(True, (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1]))
    at = np.cumsum(new) - 1
    head = order[new]
    entry = np.empty(len(order), dtype=np.int32)
    entry[order] = at
    entries = np.empty(len(head), dtype=ENTRY)
    for name, x in (("w1", w1.view(np.int64)), ("w2", w2.view(np.int64)), ("doc_id", doc[member]), ("thash", thash[member]), ("pos", pos), ("known", known[member])):
        entries[name] = x[head]
    entries["many"] = np.bincount(at, minlength=len(head)) > 1
    first = head[entry]
    if keep == "smaller":
        later = doc[member] > doc[member][first]
    else:
        later = (doc[member] != doc[member][first]) | (known[member] != known[member][first]) | (thash[member] != thash[member][first]) | (pos != pos[first])
    owner = owner[head]
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
    parts = [{"owner": int(owner[i]), "entries": entries[i:j].tobytes()} for i, j in zip(cuts, cuts[1:]) if j > i]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), table.column(c).combine_chunks()) for c in CLASS]
    return pa.RecordBatch.from_arrays(
        [*lists, pa.array([entry.tobytes()], pa.binary()), pa.array([later.tobytes()], pa.binary()), pa.array([parts], PARTS)],
        names=[*CLASS, "entry", "later", "parts"],
    )


def _answers(keep: str):
    """For one owner: of every entry of every block, whether its window is also elsewhere, and whether the first one is the entry's."""

    def run(table: pa.Table) -> pa.Table:
        sent = table.column("entries").to_pylist()
        e = np.frombuffer(b"".join(sent), dtype=ENTRY)
        order = np.lexsort((e["pos"], e["thash"], e["doc_id"], e["known"], e["w2"], e["w1"]))
        e = e[order]
        new = np.append(True, (e["w1"][1:] != e["w1"][:-1]) | (e["w2"][1:] != e["w2"][:-1]))
        group = np.cumsum(new) - 1
        first = e[new][group]
        if keep == "none":
            repeated = (np.bincount(group)[group] > 1) | (e["many"] > 0)
            found = np.where(repeated, ELSEWHERE, ALONE)
        else:
            place = ["doc_id"] if keep == "smaller" else ["doc_id", "known", "thash", "pos"]
            found = np.where(np.logical_and.reduce([e[c] == first[c] for c in place]), HERE, ELSEWHERE)
        codes = np.empty(len(e), dtype=np.uint8)
        codes[order] = found
        cuts = np.cumsum([0, *(len(x) // ENTRY.itemsize for x in sent)])
        answer = pa.array([codes[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
        return pa.table([table.column("block"), table.column("owner"), answer], names=["block", "owner", "codes"])

    return run


def _block_ranges(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The ranges of a block's classes, from its windows and the owners' answers."""
    answers = answers.sort_by("owner")
    codes = np.frombuffer(b"".join(answers.column("codes").to_pylist()), dtype=np.uint8)
    classes = pa.table([block.column(c).combine_chunks().flatten() for c in CLASS], names=CLASS)
    code = codes[np.frombuffer(block.column("entry")[0].as_py(), dtype=np.int32)]
    later = np.frombuffer(block.column("later")[0].as_py(), dtype=bool)
    found = _found(classes, (code == ELSEWHERE) | (code == HERE) & later)
    return pa.Table.from_batches(found, schema=_FOUND)


def _by_blocks(bodies: DataFrame, unit: str, width: int, keep: str, windows: int) -> DataFrame:
    """The same for hot keys, whose windows are dealt by their whole content: by blocks of classes, not one by one.

    A block sends every owner the different windows it has of it, as one packed row, each with the first place it has in the block.
    The owner says which of them are elsewhere too.  However common a window is, its owner gets it once from a block.  There are as many packed
    rows as blocks times owners, as a shuffle has pieces.

    Blocks are made twice, for the questions and for the answers, and are the same both times: of a fixed number of tasks, by content and place.
    """
    owners = max(8, -(-windows // BLOCK_WINDOWS))
    dealt = bodies.repartition(owners, *CLASS).sortWithinPartitions(*CLASS, "doc_id", "thash", "start")

    def packed(batches):
        held, size = [], 0
        for batch in batches:
            at, upto = 0, np.cumsum(batch.column(3).to_numpy())
            while at < batch.num_rows:
                before = int(upto[at - 1]) if at else 0
                to = min(int(np.searchsorted(upto, before + BLOCK_WINDOWS - size, "left")) + 1, batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(upto[to - 1]) - before
                at = to
                if size >= BLOCK_WINDOWS:
                    yield _block(pa.Table.from_batches(held), unit, width, keep, owners)
                    held, size = [], 0
        if held:
            yield _block(pa.Table.from_batches(held), unit, width, keep, owners)

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for i, block in enumerate(packed(batches)):
            yield block.append_column("block", pa.array([task + i], pa.int64()))

    blocks = dealt.mapInArrow(run, BLOCK)
    asked = blocks.select("block", F.inline("parts"))
    answers = asked.groupBy("owner").applyInArrow(_answers(keep), ANSWER)
    found = blocks.drop("parts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_block_ranges, FOUND)
    return found.dropDuplicates(CLASS)  # rows of the table that repeat give a class more than once


def ranges(docs: DataFrame, unit: str, width: int, gram: int, keep: str, judge: Callable, most: int = 1 << 20) -> DataFrame:
    """``doc_id, thash, low, high``: for every text with such, the ranges of starts of windows to remove.

    ``docs`` has ``doc_id, thash`` (a hash of the text) and ``text``.  ``keep`` says which windows go: ``none``, all
    whose content occurs twice or more; ``first``, all but the first by id and place; ``smaller``, those that occur in
    a document with a smaller id (a null id neither loses words nor counts as smaller).
    """
    found = cut_lineage(segments(docs, unit, width, gram))
    place = F.struct("doc_id", "thash", "start")
    if keep == "smaller":
        found = found.where("doc_id is not null")
    # Most keys stand once; their segments are moved no further.  Within one document a phrase is no earlier document's.
    counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("again").alias("again"))
    met = counted.where((F.col("rows") > 1) | F.col("again")) if keep != "smaller" else counted.where("rows > 1")
    found = cut_lineage(found.join(cut_lineage(met.select("key")), "key").select(*found.columns))
    classes = cut_lineage(
        found.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("members"), F.min(place).alias("first"), F.bool_or("again").alias("again"))
    )
    keys = classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("windows"), F.bool_or("again").alias("again"))
    mixed = keys.where((F.col("kinds") > 1) | F.col("again")) if keep != "smaller" else keys.where("kinds > 1")
    wanted = classes.join(mixed.select("key", "windows"), "key").select(*CLASS, "first.*", "windows")
    hot = F.col("windows") > HOT_WINDOWS
    wanted = cut_lineage(wanted.withColumn("hot", hot))
    cold = _by_keys(_bodies(docs, wanted.where("not hot"), unit, width), judge, most)
    compared = cold
    windows = wanted.where("hot").agg(F.sum("n")).first()[0]
    if windows:
        compared = cold.unionByName(_by_blocks(_bodies(docs, wanted.where("hot"), unit, width), unit, width, keep, windows))
    # What was compared is not stored: in one plan with the texts' last join, the texts are shuffled once for both.
    marked = classes.join(compared, CLASS, "left").where("members > 1 or low is not null")
    joined = found.join(marked, CLASS)
    if keep == "none":
        whole = F.col("members") > 1
    elif keep == "first":
        whole = place != F.col("first")
    else:
        whole = F.col("doc_id") > F.col("first.doc_id")
    all_of = F.array(F.struct(F.lit(0).alias("low"), (F.col("n") - 1).alias("high")))
    part = F.arrays_zip("low", "high")
    spans = joined.select("doc_id", "thash", "start", F.explode(F.when(whole, all_of).otherwise(part)).alias("r"))
    return spans.groupBy("doc_id", "thash").agg(
        F.collect_list(F.struct((F.col("start") + F.col("r.low")).alias("low"), (F.col("start") + F.col("r.high")).alias("high"))).alias("spans")
    )


def with_ranges(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its spans, if any."""
    return docs.join(spans, docs["doc_id"].eqNullSafe(spans["doc_id"]) & (docs["thash"] == spans["thash"]), "left").select(
        *[docs[c] for c in docs.columns], "spans"
    )


def covered(n: int, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` units a window starting in one of the ranges covers."""
    if not len(low):
        return np.zeros(n, dtype=bool)
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, low, 1)
    np.add.at(delta, high + width, -1)
    return np.cumsum(delta[:-1]) > 0
