"""Document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbook.session import cut_lineage

BINS = 128
SAMPLES = 1
EMPTY = "0000"


def _uniform(term: str, salt: int) -> Column:
    """A number in (0, 1) that depends on the term and the salt alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(term), F.lit(salt)), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def sample_value(term: str, weight: Column, salt: int) -> Column:
    """Logarithm of the consistent weighted sampling variable of a weighted term; the smallest is the sample.

    With gamma(2, 1) variables r and c and a uniform b of the term: t = floor(ln(weight) / r + b), and the value is
    ln(c) - r * (t - b) - r.  Terms whose weights fall in the same step t have the very same value, so two documents
    have the same smallest value with the probability of their generalised Jaccard similarity.
    """
    r = -F.log(_uniform(term, salt) * _uniform(term, salt + 1))
    c = -F.log(_uniform(term, salt + 2) * _uniform(term, salt + 3))
    b = _uniform(term, salt + 4)
    t = F.floor(F.log(weight) / r + b).cast("double")
    return F.log(c) - r * (t - b) - r


def sampled_cells(terms: DataFrame, keys: list[str], bins: int, samples: int) -> DataFrame:
    """``keys, bin, cell``: for each bin with terms, the hash of its samples, four hex digits each (never ``0000``).

    A term's occurrences are dealt to the bins in turn, from a bin that depends on the term on.  So a heavy term has a part of its
    weight in every bin, the k-th occurrence is in the same bin in all texts, and the parts that two texts have in common add up to
    the weight they have in common.
    """
    counted = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    turns = F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(bins).cast("long")) - 1)
    dealt = counted.select(*keys, "term", "n", F.explode(turns).alias("turn"))
    parts = dealt.select(
        *keys, "term", F.pmod(F.xxhash64("term", F.lit(7)) % bins + F.col("turn"), F.lit(bins)).cast("int").alias("bin"),
        (F.floor(F.col("n") / bins) + F.when(F.col("turn") < F.col("n") % bins, 1).otherwise(0)).cast("double").alias("weight"),
    )
    # A term is sampled anew in every bin.
    parts = parts.select(*keys, "bin", F.xxhash64("term", "bin").alias("part"), "weight")
    values = [sample_value("part", F.col("weight"), 100 * (s + 1)).alias(f"v{s}") for s in range(samples)]
    least = parts.select(*keys, "bin", *values).groupBy(*keys, "bin").agg(*[F.min(f"v{s}").alias(f"v{s}") for s in range(samples)])
    digits = [F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(f"v{s}", "bin"), F.lit(65535)) + 1)), 4, "0") for s in range(samples)]
    return least.select(*keys, "bin", F.concat(*digits).alias("cell"))


def _joined(first: int, bins: int, samples: int) -> Column:
    empty = F.lit(EMPTY * samples)
    return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first + bins - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), empty)), "")


def signatures(terms: DataFrame, keys: list[str], bins: int = BINS, samples: int = SAMPLES) -> DataFrame:
    """``keys, signature``: one text per key, four hex digits for each of ``bins * samples`` samples.

    ``terms`` has a row for every occurrence of a term (``term``, a long) under its keys; the weight of a term is its number
    of occurrences.  Every occurrence belongs to one of ``bins`` bins, and each bin holds ``samples`` independent samples of
    its own terms, weighted by their occurrences in it (bin-wise consistent weighted sampling).  As occurrences are dealt evenly,
    each bin's similarity has the generalised Jaccard similarity of the whole texts as its mean, however the weights
    are spread.  A bin without terms is written ``0000``.
    """
    packed = sampled_cells(terms, keys, bins, samples).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "cell"))).alias("cells"))
    return packed.select(*keys, _joined(0, bins, samples).alias("signature"))


def likeness(a: str, b: str, bins: int = BINS, samples: int = SAMPLES) -> Column:
    """Share of equal samples among those of bins that are not empty in both; 1 if both texts have no terms."""
    n = bins * samples
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        # A piece of bytes is found by its place, one of a text by walking through all characters before it.
        lambda i: F.struct(F.substring(F.col(a).cast("binary"), i * 4 + 1, 4).alias("x"), F.substring(F.col(b).cast("binary"), i * 4 + 1, 4).alias("y")),
    )
    empty = F.lit(EMPTY.encode())
    used = F.filter(cells, lambda c: (c["x"] != empty) | (c["y"] != empty))
    equal = F.size(F.filter(used, lambda c: c["x"] == c["y"])).cast("double")
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(F.size(used) == 0, F.lit(1.0)).otherwise(equal / F.size(used))


def _words(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """A row for every word: runs of anything but space and the characters 9 to 13, lower-cased, repeats kept."""
    pieces = df.select(*keys, F.explode(F.split(F.lower(F.col(body)), r"[\x20\x09-\x0D]+")).alias("word"))
    return pieces.where("word != ''").select(*keys, F.xxhash64("word").alias("term"))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bins: int = BINS, samples: int = SAMPLES) -> DataFrame:
    """``id_col, fingerprint``: a fingerprint for every id that is not null.

    Rows that share an id are one document with the words of all; a null or blank text has the fingerprint of empty bins.
    """
    whole = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("body")).where(F.col(id_col).isNotNull())
    found = signatures(_words(whole, [id_col], "body"), [id_col], bins, samples)
    blank = F.lit(EMPTY * bins * samples)
    return whole.select(id_col).distinct().join(found, id_col, "left").select(id_col, F.coalesce("signature", blank).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, next_id``: every document with the next larger id, the last with the first.

    Only ids and lengths are sorted: they are range-partitioned and stored, so that the window runs within a
    partition; across partitions one row each is passed on.
    """
    slim = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    ranged = cut_lineage(slim.repartitionByRange(F.col("doc_id")).withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    heads = ranged.groupBy("part").agg(F.min("doc_id").alias("head"))
    # One row for each partition of ids: the following windows and the broadcast are as small as their number.
    after, all_of = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.lead("head").over(after).alias("next_head"), F.first("head").over(all_of).alias("first_head"))
    return inside.join(F.broadcast(heads), "part").select("doc_id", "n_chars", F.coalesce("next_id", "next_head", "first_head").alias("next_id"))


def edited_fingerprints(docs: DataFrame, bins: int = BINS, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every text.

    The edited text has the last half of its code points (rounded down) replaced by as many first ones of the next document's
    text, by ascending id, or all of it; after the last document comes the first.  ``near_edited`` and ``near_next`` are the
    likeness of a fingerprint to that of the edited text and of the next document.  A null text is empty.  Of rows that share
    an id the smallest text counts; rows without an id have no place in the order and are left out.

    Of the next text no more is shuffled than the half that is needed.  Words are counted and sampled in the partition
    the text is in, so only texts and fingerprints travel.
    """
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")
    order = cut_lineage(with_next(whole))
    ids = order.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] != ids["d"]:
        whole = whole.groupBy("doc_id").agg(F.min("text").alias("text"))
        order = cut_lineage(with_next(whole))
    need = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    given = whole.join(need, "doc_id").select(F.col("to_id").alias("doc_id"), "need", F.expr("left(text, need)").alias("head"))
    both = whole.join(given, "doc_id").select("doc_id", "text", F.concat(F.expr("left(text, char_length(text) - need)"), F.col("head")).alias("edited"))
    digest = both.select("doc_id", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    sides = both.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("body")) for i, c in enumerate(("text", "edited"))])))
    cells = sampled_cells(_words(sides, ["doc_id", "side"], "body"), ["doc_id", "side"], bins, samples)
    packed = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("side") * bins + F.col("bin")).alias("k"), "cell"))).alias("cells"))
    prints = packed.select("doc_id", _joined(0, bins, samples).alias("fingerprint"), _joined(bins, bins, samples).alias("edited_fingerprint"))
    blank = F.lit(EMPTY * bins * samples)
    rows = digest.join(prints, "doc_id", "left").select(
        "doc_id", "edited_sha256", F.coalesce("fingerprint", blank).alias("fingerprint"), F.coalesce("edited_fingerprint", blank).alias("edited_fingerprint")
    )
    rows = cut_lineage(rows)
    nexts = order.join(rows.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint")), "next_id")
    return rows.join(nexts, "doc_id").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", bins, samples).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", bins, samples).alias("near_next"),
    )
