"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.llm.text import arrow_rows, chunks, prefix_hashes, window_hashes

BITS = 16
SIZES = (3, 4, 5)
ROUNDS = 300
RATE = 2.0
DECAY = 2e-3

#: The labelled URL table, as words of hosts.  Every word is written with several subdomains and paths.
BLOCKED_WORDS = (
    "pills pillshop cheapmeds online-pharmacy viagra-store diet-pills betting sportsbets bets24 casino casinos royal-casino "
    "poker-room slots-jackpot lottery-prize winbig bigwin adult adults-only adult-videos xxx-cams porn-tube sex-chat hot-singles "
    "escort-girls spam spammer farmlinks link-farm contentfarm seo-links mass-mailer ads adserver ad-server click-track tracker "
    "trackers banner-ads popup-ads tracking-pixel freebies free-money free-gifts cheap-watches cheaptickets malware-drop "
    "virus-download warez-crack keygen-serial phishing-login fake-bank crypto-double get-rich payday-loans replica-watches"
).split()
ALLOWED_WORDS = (
    "library museum university school history science weather recipes gardening travel-notes city-news local-news sports-club "
    "music-review book-review open-data documentation developer-guide health-service parliament court-records archive "
    "encyclopedia dictionary maps astronomy biology chemistry physics mathematics engineering railway harbour theatre cinema "
    "painting photography cooking farming forestry fishing philosophy theory heritage council station province handbook "
    "north-south weather-report statistics education administration information association foundation institute "
    "community-centre city-hall fire-brigade observatory laboratory geography literature language translation orchestra choir "
    "stadium cycling hiking sailing chess puzzle knitting pottery carpentry architecture economics accounting insurance"
).split()
SUBDOMAINS = ("", "www.", "blog.", "m.")
ENDINGS = ("com", "org", "net")
PATHS = ("/en/12", "/de/345.html", "/fr/67/", "/es/8", "/")
#: Block or allow, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def labelled_urls() -> list[tuple[str, str, int]]:
    """Host, path and label (1: block) of the small training table."""
    rows = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, word in enumerate(words):
            for j, sub in enumerate(SUBDOMAINS):
                rows.append((f"{sub}{word}.example.{ENDINGS[(i + j) % 3]}", PATHS[(i + j) % len(PATHS)], label))
    return rows


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.lit(""))


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path in one text) and its verdict; nulls if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.  Of two rules of one length the first counts.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def features(hosts: list[str] | pa.Array, paths: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct character n-gram of host and path, each with its ends marked."""
    rows, ids = [], []
    for kind, values in enumerate((hosts, paths)):
        marked = pa.array([f"\x02{v or ''}\x03" for v in (values.to_pylist() if isinstance(values, pa.Array) else values)], pa.string())
        for chunk in chunks(marked):
            n = len(chunk.bounds) - 1
            sums = prefix_hashes(chunk.byte_values(20 + kind))
            text = np.repeat(np.arange(n), np.diff(chunk.bounds))
            for size in SIZES:
                if len(chunk.data) < size:
                    continue
                h = window_hashes(sums, size)
                start = np.arange(len(h))
                inside = start + size <= chunk.bounds[text[: len(h)] + 1]
                rows.append(text[: len(h)][inside] + chunk.rows[0])
                ids.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key = np.unique((np.concatenate(rows) << BITS) | np.concatenate(ids))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def probability(self, hosts, paths, n: int) -> np.ndarray:
        row, ids = features(hosts, paths)
        size = np.maximum(np.bincount(row, minlength=n), 1)
        logit = self.bias + np.bincount(row, weights=self.weights[ids], minlength=n) / np.sqrt(size)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(table: Sequence[tuple[str, str, int]] | None = None, rounds: int = ROUNDS) -> Model:
    """Logistic regression by full-batch gradient descent on a small labelled table of (host, path, label)."""
    table = labelled_urls() if table is None else table
    labels = np.array([t[2] for t in table], dtype=float)
    n = len(labels)
    row, ids = features([t[0] for t in table], [t[1] for t in table])
    used, back = np.unique(ids, return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    weights, bias = np.zeros(len(used)), 0.0
    for _ in range(rounds if n else 0):
        logit = bias + np.bincount(row, weights=weights[back], minlength=n) * scale
        error = (1 / (1 + np.exp(-logit)) - labels) / n
        weights -= RATE * 20 * (np.bincount(back, weights=(error * scale)[row], minlength=len(used)) + DECAY * weights / n)
        bias -= RATE * error.sum()
    full = np.zeros(1 << BITS)
    full[used] = weights
    return Model(bias, full)


def judged(pages: DataFrame, model: Model | None = None, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row: the rule's verdict, else the model's (block from 0.5).

    A null url and one without ``://`` have an empty host and path, which fit no rule.  The model is small and of fixed
    size; rows are scored where they are.
    """
    arrow_rows(pages.sparkSession, 10_000)
    model = train() if model is None else model
    bias, weights = model.bias, model.weights
    parsed = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    name, verdict = rule_of("host", "path", rules)
    ruled = parsed.select("*", name.alias("rule"), verdict.alias("ruled"))
    schema = ruled.select("*").schema.add("score", "double")

    def run(batches):
        own = Model(bias, weights)
        for b in batches:
            score = own.probability(b.column(1), b.column(2), b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    scored = ruled.mapInArrow(run, schema)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
