"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.llm.segments import covered, ranges, with_ranges
from tarnbook.llm.suffix import _spans_of
from tarnbook.llm.text import prefix_hashes, window_hashes

WIDTH = 50
GRAM = 16


def reference_index(words: np.ndarray, starts: np.ndarray, n: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's phrases of ``width`` words: the hash at every window of every segment, and the first document with it."""
    places = np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    phrase = window_hashes(prefix_hashes(words), width)[places]
    owner = np.repeat(docs, n)
    order = np.lexsort((owner, phrase))
    sorted_phrase = phrase[order]
    head = np.append(True, sorted_phrase[1:] != sorted_phrase[:-1])
    first = np.empty(len(phrase), dtype=docs.dtype)
    first[order] = owner[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    return owner, first


def _judge(width: int):
    """Parse the segments of a block against the block's earlier documents.

    A factor goes on as long as each next phrase of ``width`` words is known from an earlier document; where it ends, the
    phrases across its boundary are looked up one by one, so that a phrase known from another reference is not missed.
    """

    def judge(bodies: list[bytes], n: np.ndarray, docs: np.ndarray) -> np.ndarray:
        words = np.frombuffer(b"".join(bodies), dtype=np.uint64)
        starts = np.zeros(len(n), dtype=np.int64)
        np.cumsum((n + width - 1)[:-1], out=starts[1:])
        owner, first = reference_index(words, starts, n, docs, width)
        return first < owner

    return judge


def duplicate_factors(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, gram: int | None = None) -> DataFrame:
    """``doc_id, thash, text, spans``: every row with the starts of phrases known from a document with a smaller id.

    The corpus is its own reference.  It is cut into blocks by content: all phrases of ``width`` words with the same
    smallest hash of ``gram`` words are one block, so a phrase needs to be looked up in one block only, which holds
    every occurrence.  Each document is factored greedily against the blocks it touches; maximal runs of known phrases
    are the factors of ``width`` words or more.  Null texts have no words; a null id is nobody's earlier document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("thash"), F.col(text).alias("text"))
    return with_ranges(rows, ranges(rows, "words", width, gram or max(1, width // 3), "smaller", _judge(width)))


def removal_report(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of :func:`duplicate_factors`; words kept are joined by one space."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i]
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                gone = covered(len(words), *_spans_of(batch.column(2), i), width)
                removed = int(gone.sum())
                if removed:
                    words = [words[j] for j in np.flatnonzero(~gone).tolist()]
                out.append((len(words) + removed, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return spans.select("doc_id", "text", "spans").mapInArrow(run, schema)
