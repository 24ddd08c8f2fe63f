"""Text quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.llm.text import Chunk, arrow_rows, chunks, fold_of

WORD_BITS = 14
SHAPES = 256
STATS = 12
STAT_BINS = 17
FEATURES = (1 << WORD_BITS) + SHAPES + STATS * STAT_BINS
FACTORS = 8
SAMPLE = 8000
EPOCHS = 12
THRESHOLD = 0.7

#: Classes of bytes: lower-case, upper-case, digit, part of a longer character, space, line end, other sign.
CLASS = np.full(256, 6, dtype=np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 3
CLASS[[32, 9, 11, 12]], CLASS[[10, 13]] = 4, 5


def _ratio_bin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor((STAT_BINS - 1) * a / np.maximum(b, 1)), STAT_BINS - 1).astype(np.int64)


def _log_bin(a: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(a + 1.0)), STAT_BINS - 1).astype(np.int64)


def _block(row: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and value of the distinct ids of every row, counts scaled to length one."""
    key, count = np.unique(row * width + ids, return_counts=True)
    row, ids, value = key // width, key % width, count.astype(np.float64)
    norm = np.sqrt(np.bincount(row, weights=value * value)) if len(row) else np.zeros(0)
    return row, ids, value / norm[row]


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of every text's features, their ids and values.

    Three blocks: hashed lower-cased words; shapes of words (which classes of signs they begin with, end with and
    hold); and statistics of the whole text in bins (length, words, word length, distinct words, shares of the classes of signs,
    words per line).  An empty text has its statistics only.
    """
    n = len(chunk.bounds) - 1
    starts, ends, first = chunk.words
    row = np.repeat(np.arange(n), np.diff(first))
    hashes = chunk.lower().word_hashes()
    words = _block(row, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), 1 << WORD_BITS)
    kind = CLASS[chunk.data]
    counts = np.zeros((8, n))
    for c in range(7):
        upto = np.append(0, np.cumsum(kind == c))
        counts[c] = upto[chunk.bounds[1:]] - upto[chunk.bounds[:-1]]
    if len(starts):
        holds = np.zeros(len(starts), dtype=np.int64)
        for bit, c in enumerate((1, 2, 6)):
            upto = np.append(0, np.cumsum(kind == c))
            holds |= ((upto[ends] - upto[starts]) > (c == 6)).astype(np.int64) << bit
        simple = np.array([0, 1, 2, 0, 3, 3, 3])
        shape = (holds * 4 + simple[kind[starts]]) * 8 + np.minimum(ends - starts, 31) // 4
        shapes = _block(row, shape, SHAPES)
    else:
        shapes = words
    n_words, n_bytes = np.diff(first).astype(float), np.diff(chunk.bounds).astype(float)
    distinct = np.bincount(words[0], minlength=n)
    stats = [
        _log_bin(n_bytes), _log_bin(n_words), np.minimum(n_bytes // np.maximum(n_words, 1), STAT_BINS - 1).astype(np.int64),
        _ratio_bin(distinct, n_words), *[_ratio_bin(counts[c], n_bytes) for c in (0, 1, 2, 3, 4, 6)],
        _log_bin(counts[5]), _log_bin(n_words / (counts[5] + 1)),
    ]
    base = (1 << WORD_BITS) + SHAPES
    all_rows = np.concatenate([words[0], shapes[0], np.tile(np.arange(n), STATS)])
    ids = np.concatenate([words[1], shapes[1] + (1 << WORD_BITS), *[base + i * STAT_BINS + s for i, s in enumerate(stats)]])
    values = np.concatenate([words[2], shapes[2], np.full(n * STATS, STATS**-0.5)])
    order = np.argsort(all_rows, kind="stable")
    return np.searchsorted(all_rows[order], np.arange(n + 1)), ids[order], values[order]


@dataclass
class Machine:
    """Bias, weights and factors of a factorisation machine."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray):
        """In linear time: half the difference of the squared sums and the sums of squares of each factor."""
        linear = np.add.reduceat(self.weights[ids] * values, bounds[:-1])
        part = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(part, bounds[:-1], axis=0)
        squares = np.add.reduceat(part * part, bounds[:-1], axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def scores(self, chunk: Chunk) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(*features(chunk))[0], -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5, batch: int = 128) -> Machine:
    """Logistic loss, minimised by Adam over shuffled batches; the order and the start are fixed."""
    draw = np.random.default_rng(5)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES), draw.normal(0, 0.01, (FEATURES, FACTORS)))
    state = np.zeros((2, FEATURES, FACTORS + 1))
    step = 0
    for _ in range(epochs if len(labels) else 0):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids = np.concatenate([rows[i][0] for i in pick])
            values = np.concatenate([rows[i][1] for i in pick])
            size = np.array([len(rows[i][0]) for i in pick])
            bounds = np.append(0, np.cumsum(size))
            logit, sums = machine.logits(bounds, ids, values)
            error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - labels[pick]) / len(pick)
            of = np.repeat(np.arange(len(pick)), size)
            scaled = error[of] * values
            used, back = np.unique(ids, return_inverse=True)
            slope = np.empty((len(used), FACTORS + 1))
            slope[:, 0] = np.bincount(back, weights=scaled)
            pair = scaled[:, None] * (sums[of] - machine.factors[ids] * values[:, None])
            for f in range(FACTORS):
                slope[:, f + 1] = np.bincount(back, weights=pair[:, f])
            slope[:, 0] += decay * machine.weights[used]
            slope[:, 1:] += decay * machine.factors[used]
            step += 1
            state[0, used] = 0.9 * state[0, used] + 0.1 * slope
            state[1, used] = 0.99 * state[1, used] + 0.01 * slope**2
            move = rate * (state[0, used] / (1 - 0.9**step)) / (np.sqrt(state[1, used] / (1 - 0.99**step)) + 1e-8)
            machine.weights[used] -= move[:, 0]
            machine.factors[used] -= move[:, 1:]
            machine.bias -= rate * error.sum()
    return machine


def train(labelled: DataFrame, text: str = "text", label: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE) -> Machine:
    """Fit on about ``sample`` rows that have a label, chosen by a hash of the id; all of them if there are fewer.

    Features are made where the texts are; one task, which sees no more than the sample, fits the machine.
    """
    arrow_rows(labelled.sparkSession)
    known = labelled.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"), F.col(text).alias("text"))
    n = known.count()
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11) * F.lit(2.0**-53) < F.lit(float(sample) / max(n, 1)))

    def featured(batches):
        for b in batches:
            out_ids, out_values = [], []
            for chunk in chunks(b.column(2)):
                bounds, ids, values = features(chunk)
                ids, values = ids.astype(np.int32), values.astype(np.float32)
                out_ids += [ids[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]
                out_values += [values[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out_ids, pa.binary()), pa.array(out_values, pa.binary())], names=["id", "label", "ids", "values"])

    rows = chosen.mapInArrow(featured, "id long, label double, ids binary, values binary")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "ids"]).reset_index(drop=True)
        data = [(np.frombuffer(i, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for i, v in zip(frame["ids"], frame["values"])]
        m = fit(data, frame["label"].to_numpy())
        return pd.DataFrame({"bias": [m.bias], "weights": [m.weights.tobytes()], "factors": [m.factors.tobytes()]})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "bias double, weights binary, factors binary").first()
    if found is None:
        return fit([], np.zeros(0))
    return Machine(found["bias"], np.frombuffer(found["weights"]), np.frombuffer(found["factors"]).reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for every whole text; a null text is empty.  A column ``name`` is replaced."""
    arrow_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, "double")
    where = kept.index(text)
    bias, weights, factors = machine.bias, machine.weights, machine.factors

    def run(batches):
        model = Machine(bias, weights, factors)
        for b in batches:
            values = [model.scores(chunk) for chunk in chunks(b.column(where))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(values) if values else np.zeros(0))], names=[*kept, name])

    return docs.select(*kept).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted``: labels learned from all folds but one (by crc32 of the id), every row scored."""
    fold = fold_of("doc_id", folds)
    known = labels.select("doc_id", "quality").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    machine = train(docs.where(fold != held_out).select("doc_id", "text").join(known, "doc_id"))
    rows = docs.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    return score(rows, machine).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
