"""Names that are nearly the same, found without comparing all pairs.

A name is told by the pairs of letters that follow each other in it, its ends marked, repeats numbered.  An edit changes at most
two of them.  So, with the pieces of every name put in one order, rare ones first, two names within ``k`` edits share one of their
first ``2 k + 1`` pieces: only names that meet there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.session import cut_lineage

PIECE = 2
LEAST_PER = PIECE + 1


def _numbered_pieces(name: Column) -> Column:
    """All pieces of two letters, each with how often it stood in the name so far."""
    marked = F.concat(F.lit("\x02"), name, F.lit("\x03"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substr(marked, i, F.lit(PIECE)))
    return F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda x: x == p)).alias("nth")))


def _spellings(df: DataFrame, column: str) -> DataFrame:
    named = df.select(F.col(column).alias("name")).where(F.trim(column) != "")
    return cut_lineage(named.distinct())


def _telling(tokens: DataFrame, commonness: DataFrame, per: int, name: str) -> DataFrame:
    """The rarest pieces of every name, as many as its own bound on the edits asks for."""
    rated = tokens.join(commonness, ["piece", "nth"]).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "nth"))).alias("pieces"))
    most = F.floor(F.length("name") / (per - 1)).cast("int") * PIECE + 1
    return rated.select(F.col("name").alias(name), F.explode(F.slice("pieces", F.lit(1), most)).alias("p")).select(name, "p.piece", "p.nth")


def similar_names(names: DataFrame, targets: DataFrame, name: str = "name", target: str = "name", per: int = 5) -> DataFrame:
    """Distinct (``name``, ``target``, ``edits``) of all spellings with at most one edit for every ``per`` characters of the longer one.

    An edit is an inserted, deleted or replaced character.  Names are compared as they are written; null and blank ones are like none.
    """
    if per < LEAST_PER:
        raise ValueError(f"per must be {LEAST_PER} or more: with less, names need not have a piece in common")
    sides = [_spellings(names, name), _spellings(targets, target)]
    tokens = [cut_lineage(s.select("name", F.explode(_numbered_pieces(F.col("name"))).alias("t")).select("name", "t.piece", "t.nth")) for s in sides]
    commonness = cut_lineage(tokens[0].unionByName(tokens[1]).groupBy("piece", "nth").agg(F.count(F.lit(1)).alias("n")))
    left, right = (_telling(t, commonness, per, c) for t, c in zip(tokens, ("name", "target")))
    most = F.floor(F.greatest(F.length("name"), F.length("target")) / per)
    met = left.join(right, ["piece", "nth"]).where(F.abs(F.length("name") - F.length("target")) <= most).select("name", "target").distinct()
    return met.withColumn("edits", F.levenshtein("name", "target")).where(F.col("edits") <= most)


def proposed_crosswalk(names: DataFrame, targets: DataFrame, name: str = "name", target: str = "name", per: int = 5) -> DataFrame:
    """For every spelling of ``names`` the closest of ``targets``: ``name, n_rows, proposal, edits, n_closest``.

    Of several at the same distance the first in code-point order is proposed, and ``n_closest`` tells how many there are, so that
    a person can decide.  Names without a target in reach have nulls and ``n_closest`` 0; null and blank names are left out.
    """
    pairs = similar_names(names, targets, name, target, per)
    level = pairs.groupBy("name", "edits").agg(F.count(F.lit(1)).alias("n_closest"), F.min("target").alias("proposal"))
    best = level.groupBy("name").agg(F.min(F.struct("edits", "proposal", "n_closest")).alias("best"))
    counted = names.select(F.col(name).alias("name")).where(F.trim(name) != "").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(best, "name", "left").select(
        "name", "n_rows", "best.proposal", "best.edits", F.coalesce("best.n_closest", F.lit(0)).alias("n_closest")
    )
