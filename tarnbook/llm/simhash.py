"""SimHash near-duplicates by a self-join of the binary trie of fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbook.llm.graph import components
from tarnbook.llm.text import arrow_rows, chunks
from tarnbook.session import cut_lineage

BITS = 64
STEP = 8
SHINGLE_SEED = 42


def _majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes."""
    if not hashes:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    h = np.array(hashes, dtype="<u8")
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprint(words: list[bytes], width: int) -> int:
    """A text's fingerprint; fewer words than a shingle has are one shingle, no words give zero."""
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return _majority([digest(line, SHINGLE_SEED)])
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)][width - 1 :]
    return _majority([digest(line[s:e], SHINGLE_SEED) for s, e in zip(starts, ends)])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """``id_col, bits``: the 64-bit SimHash of every whole text, as a long.

    A-Z are lower-cased; words are runs of anything but space and the characters 9 to 13; shingles are ``width``
    words joined by one space, repeats counted.  Null and empty texts have fingerprint zero; ids may be null or
    repeat, one row comes out for each row.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("bits", T.LongType())])

    def run(batches):
        for batch in batches:
            out = []
            for chunk in chunks(batch.column(1)):
                data = chunk.lower().data.tobytes()
                bounds = chunk.bounds.tolist()
                out += [_fingerprint(data[s:e].split(), width) for s, e in zip(bounds, bounds[1:])]
            bits = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=[id_col, "bits"])

    return docs.select(id_col, text).mapInArrow(run, schema)


def _prefix(bits: str, depth: int) -> Column:
    """The node of a fingerprint at a depth: its first bits."""
    return F.shiftrightunsigned(F.col(bits), BITS - depth) if depth else F.lit(0).cast("long")


def _turned(turn: int, blocks: int) -> Column:
    """The fingerprint with block ``turn`` of ``blocks`` in front."""
    by = turn * (BITS // blocks)
    if not by:
        return F.col("bits")
    return F.shiftleft("bits", by).bitwiseOR(F.shiftrightunsigned("bits", BITS - by))


def trie_links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """``a, b`` (a < b): all pairs of distinct fingerprints (column ``bits``) that differ in ``budget`` bits or fewer.

    The trie of all fingerprints is traversed in node pairs from the root, a byte of depth at a time; a pair carries
    the differing bits of its two prefixes and goes when they exceed the budget.  The budget is tightened by the
    pigeonhole principle: of ``m = (budget + 1) / 2`` (rounded up to a power of two) blocks of bits one has at most
    one difference, so the fingerprints are entered m times, turned to have each block in front, and the traversal
    allows one difference within the front block.  More than that, of the m turns there is one in which the first k
    blocks have at most k / m of all differences, for every k (begin behind the blocks that have most more than their
    share); so the budget grows block by block, up to all of it at the end.  Within the front block partner nodes are
    found by an equi-join on the prefix with at most one bit changed, below it by joining the children of a pair.
    A pair found in several turns comes out once.  No node is a hot key: a node has at most as many partners as
    prefixes within the budget.
    """
    blocks = 1
    while 2 * blocks < budget + 1:
        blocks *= 2
    front = BITS // blocks
    turned = prints.select("bits").distinct().select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), _turned(t, blocks).alias("fp")) for t in range(blocks)])).alias("x")
    ).select("x.*")
    turned = cut_lineage(turned)

    def nodes(depth: int, parent: int) -> DataFrame:
        return turned.select("turn", _prefix("fp", parent).alias("up"), _prefix("fp", depth).alias("node")).distinct()

    step = min(16, front)
    allowed = min(1, budget)
    masks = [0, *[1 << i for i in range(step)]] if allowed else [0]
    pairs, depth = None, 0
    while depth < front:
        down = nodes(depth + step, depth)
        if pairs is None:
            ours = down.select("turn", F.col("node").alias("p"), F.lit(0).cast("long").alias("q_up"), F.lit(0).alias("diff"))
        else:
            ours = pairs.join(down.select("turn", F.col("up").alias("p"), F.col("node").alias("p2")), ["turn", "p"]).select(
                "turn", F.col("p2").alias("p"), F.col("q").alias("q_up"), "diff"
            )
        change = F.explode(F.when(F.col("diff") < allowed, F.array(*[F.lit(m).cast("long") for m in masks])).otherwise(F.array(F.lit(0).cast("long"))))
        low = F.col("p").bitwiseAND(F.lit((1 << step) - 1))
        guess = ours.withColumn("mask", change).select(
            "turn", "p", F.shiftleft("q_up", step).bitwiseOR(low.bitwiseXOR(F.col("mask"))).alias("q"),
            (F.col("diff") + (F.col("mask") != 0).cast("int")).alias("diff"),
        )
        found = guess.where("p <= q").join(down.select("turn", F.col("node").alias("q")), ["turn", "q"])
        pairs = cut_lineage(found.select("turn", "p", "q", "diff"))
        depth += step
    while depth < BITS:
        down = nodes(depth + STEP, depth)
        left = down.select("turn", F.col("up").alias("p"), F.col("node").alias("p2"))
        right = down.select("turn", F.col("up").alias("q"), F.col("node").alias("q2"))
        low = F.lit((1 << STEP) - 1)
        more = F.bit_count(F.col("p2").bitwiseXOR(F.col("q2")).bitwiseAND(low))
        pairs = (
            pairs.join(left, ["turn", "p"]).join(right, ["turn", "q"])
            .select("turn", F.col("p2").alias("p"), F.col("q2").alias("q"), (F.col("diff") + more).alias("diff"))
            .where((F.col("diff") <= budget * (-(-(depth + STEP) // front)) // blocks) & ((F.col("p") <= F.col("q")) | (F.shiftrightunsigned("p", STEP) != F.shiftrightunsigned("q", STEP))))
        )
        depth += STEP
        if depth % 16 == 0 or depth == BITS:
            pairs = cut_lineage(pairs)
    # Turned back, the order of the two may change.
    back = [F.when(F.col("turn") == t, _turned_back(c, t, blocks)) for c in ("p", "q") for t in range(blocks)]
    p, q = F.coalesce(*back[:blocks]), F.coalesce(*back[blocks:])
    return pairs.where("p != q").select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()


def _turned_back(name: str, turn: int, blocks: int) -> Column:
    by = turn * (BITS // blocks)
    if not by:
        return F.col(name)
    return F.shiftrightunsigned(name, by).bitwiseOR(F.shiftleft(name, BITS - by))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, budget: int = 3) -> DataFrame:
    """``id_col, bits, component_id``: every document with the smallest id it is linked with, directly or not.

    Documents with equal fingerprints are one class, represented by its smallest id; classes link when their
    fingerprints differ in ``budget`` bits or fewer.  Null ids are carried through with the component of their
    fingerprint.  An empty table gives an empty table.
    """
    prints = cut_lineage(fingerprints(docs, text, id_col, width))
    classes = cut_lineage(prints.groupBy("bits").agg(F.min(id_col).alias("class_id")))
    links = trie_links(classes, budget)
    ends = links.join(classes.select(F.col("bits").alias("a"), F.col("class_id").alias("x")), "a").join(
        classes.select(F.col("bits").alias("b"), F.col("class_id").alias("y")), "b"
    )
    known = ends.where("x is not null and y is not null")
    grouped = components(known.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    named = classes.join(grouped, classes["class_id"] == grouped["node"], "left").select(
        "bits", F.coalesce("component", "class_id").alias("component_id")
    )
    return prints.join(named, "bits").select(id_col, "bits", "component_id")
