"""The corpus pipeline: from raw documents to a weighted mix, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbook.llm import decontaminate, langid, mixing, simhash, suffix
from tarnbook.session import cut_lineage, tune

LEAST_SCORE = 0.5
SHINGLE_WORDS = 3
NEAR_BITS = 3
PASSAGE_BYTES = 240  # under 50 words of prose


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or a text, and those whose likeliest language has a posterior under one half."""
    names = ("__lang", "__score")
    found = langid.identify(docs, langid.train(docs), names=names)
    return found.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).drop(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id; all rows without an id.

    Rows that share an id are told apart by their texts: those with other texts are documents of their own, of equal ones one
    row stays.
    """
    keyed = docs.where("doc_id is not null").select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("thash")).alias("__key"), "text")
    found = simhash.near_duplicates(keyed, id_col="__key", width=SHINGLE_WORDS, budget=NEAR_BITS)
    keep = cut_lineage(found.groupBy("__key").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("rows")).where(F.col("__key") == F.col("first")))
    keep = keep.select(F.col("__key.doc_id").alias("__id"), F.col("__key.thash").alias("__thash"), F.col("rows").alias("__rows"))
    kept = docs.join(keep, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__thash")))
    if not keep.where("__rows > 1").isEmpty():
        again = kept.where("__rows > 1").groupBy("__id", "__thash").agg(F.min_by(F.struct(*docs.columns), F.struct("text", "lang", "source")).alias("row")).select("row.*")
        kept = kept.where("__rows = 1").select(*docs.columns).unionByName(again)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of passages of ``PASSAGE_BYTES`` or more; documents of which no word is left go.  An empty table stays empty."""
    kept = suffix.kept_texts(suffix.duplicate_spans(docs, width=PASSAGE_BYTES, keep="first"), PASSAGE_BYTES)
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns]
    return kept.where(mixing.word_count("text") > 0).select(*columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a near copy of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the number of words it takes of each (a document may be taken up to twice)."""
    names = ["doc_id", "thash", "size", "source", "source_size", "target", "taken"]
    mixed = mixing.mixed(docs).where("taken > 0").groupBy(*names[:-1]).agg(F.max("taken").alias("taken"))
    mixed = mixed.select(*[F.col(c).alias(f"__{c}") for c in names])
    same = docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__thash")) & docs["source"].eqNullSafe(F.col("__source"))
    kept = [docs[c] for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return docs.join(mixed, same).select(*kept, *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("mix", mix),
]

#: Models, fingerprints and suffix order can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
