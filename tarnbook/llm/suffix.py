"""Substring dedup by suffix order and longest previous factors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbook.llm.segments import covered, ranges, with_ranges

WIDTH = 400
GRAM = 100


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes (prefix doubling from eight bytes on).

    Suffixes that agree to that depth share a rank.  Past the end of the data comes nothing, which sorts first.
    """
    n = len(data)
    got = min(8, depth)
    padded = np.zeros(n + got, dtype=np.uint64)
    padded[:n] = data
    value = np.zeros(n, dtype=np.uint64)
    for j in range(got):
        value = (value << np.uint64(8)) | padded[j : j + n]
    rank = np.unique(value, return_inverse=True)[1]
    while got < depth:
        shift = min(got, depth - got)
        later = np.zeros(n, dtype=np.int64)
        later[: n - shift] = rank[shift:] + 1
        rank = np.unique(rank * np.int64(n + 1) + later, return_inverse=True)[1]
        got += shift
    return rank


def factor_flags(rank: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the factor at each place (ascending) has a previous, and a next, occurrence to the depth of the ranks.

    In suffix order, suffixes of one rank stand together by place.  The previous smaller place in that order with a
    common prefix of the full depth is then the neighbour before, if it has the same rank (the longest previous
    factor reaches the depth); likewise the next occurrence is the neighbour after.
    """
    r = rank[places]
    order = np.argsort(r, kind="stable")
    same = r[order][1:] == r[order][:-1]
    previous = np.zeros(len(r), dtype=bool)
    following = np.zeros(len(r), dtype=bool)
    previous[order[1:]] = same
    following[order[:-1]] = same
    return previous, following


def _judge(width: int, keep: str):
    def judge(bodies: list[bytes], n: np.ndarray, docs: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        starts = np.zeros(len(n), dtype=np.int64)
        np.cumsum((n + width - 1)[:-1], out=starts[1:])
        places = np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        previous, following = factor_flags(suffix_ranks(data, width), places)
        return previous if keep == "first" else previous | following

    return judge


def duplicate_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, keep: str = "first", gram: int | None = None) -> DataFrame:
    """``doc_id, thash, text, spans`` (and ``row``): every row with the starts of its ``width``-byte strings that are repeated.

    ``keep`` is ``first`` (later copies go, by id and place) or ``none`` (all copies go).  A null text is empty; matches never
    cross texts.  Ids may be null or repeat: rows with one id and one text have the same spans, those that repeat a
    text count as copies of each other only with ``none``.  All other columns come back in the struct ``row``.
    """
    rest = [F.col(c) for c in docs.columns if c != text]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("thash"), F.col(text).alias("text"), F.struct(*rest).alias("row")
    )
    return with_ranges(rows, ranges(rows, "bytes", width, gram or max(1, width // 4), keep, _judge(width, keep)))


def _spans_of(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    value = column[i]
    if not value.is_valid:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    flat = value.values
    return flat.field("low").to_numpy().astype(np.int64), flat.field("high").to_numpy().astype(np.int64)


def removal_report(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of :func:`duplicate_spans`."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ])

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i]
                raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                gone = covered(len(raw), *_spans_of(batch.column(2), i), width)
                removed = int(gone.sum())
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() if removed else raw
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if removed else 0
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                names=[f.name for f in schema],
            )

    return spans.select("doc_id", "text", "spans").mapInArrow(run, schema)


def kept_texts(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row, text`` of every row of :func:`duplicate_spans`, without the bytes its spans cover.

    A character of several bytes that is cut at a span's edge goes with the span.
    """
    schema = spans.select("row", "text").schema

    def run(batches):
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i]
                low, high = _spans_of(batch.column(2), i)
                if not raw.is_valid or not len(low):
                    texts.append(raw.as_py())
                    continue
                data = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                texts.append(data[~covered(len(data), low, high, width)].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return spans.select("row", "text", "spans").mapInArrow(run, schema)
