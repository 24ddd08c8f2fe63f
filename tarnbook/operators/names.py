"""Partial-name join inside a block (a county), without comparing all names of a block.

A name can only be part of another one if each of its short pieces is.  Every name is therefore looked up
by one piece of itself, the one fewest other names contain, and only names sharing that piece are compared.
Names are compared once per distinct spelling; rows come back in at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.text import name_as_pattern
from tarnbook.session import cut_lineage

PIECE_LENGTHS = (1, 2, 4, 8)
BROADCAST_PIECES = 100_000  # a side with provably no more pieces than this is sent to all tasks


def _pieces(text: Column, lengths: Column) -> Column:
    """All distinct pieces of the given lengths."""

    def of_length(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, k))

    fitting = F.filter(lengths, lambda k: k <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(fitting, of_length)))


def _piece_length(text: Column) -> Column:
    """The greatest length the text has pieces of."""
    return F.array_max(F.filter(F.array(*[F.lit(k) for k in PIECE_LENGTHS]), lambda k: k <= F.length(text)))


def _inside(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(block, part, whole) where a text of ``parts`` (block, part, piece_of) may lie in one of ``wholes``
    (block, whole, whole_text).

    ``piece_of`` is text that must occur in the whole literally.  Runs two small jobs that measure the texts.
    """
    length = _piece_length(F.col("piece_of"))
    used, part_rows = parts.agg(F.collect_set(length), F.sum(F.length("piece_of"))).first()
    if not used:
        return parts.select("block", "part", F.lit("").alias("whole")).limit(0)
    used = sorted(used)
    whole_rows = len(used) * (wholes.agg(F.sum(F.length("whole_text"))).first()[0] or 0)

    def sized(df: DataFrame, rows: int) -> DataFrame:
        # The number of pieces is known to be at most this; Spark's own estimate would not see them grow.
        return F.broadcast(df) if rows <= BROADCAST_PIECES else df.hint("merge")

    own = _pieces(F.col("piece_of"), F.array(length))
    # The outer form keeps Spark from computing the pieces a second time for an inferred filter.
    wanted = parts.select("block", "part", "piece_of", F.posexplode_outer(own).alias("at", "piece"))
    lists = wholes.select(
        "block", "whole", F.explode_outer(_pieces(F.col("whole_text"), F.array(*[F.lit(k) for k in used]))).alias("piece")
    )
    commonness = lists.groupBy("block", "piece").agg(F.count(F.lit(1)).alias("n_wholes"))
    if part_rows <= whole_rows:
        rated = sized(wanted, part_rows).join(commonness, ["block", "piece"])
    else:
        rated = wanted.join(sized(commonness, whole_rows), ["block", "piece"])
    # Only a part all of whose pieces occur can lie in a whole.  Rarity and position in one number keep the
    # aggregation in a hash table.
    chosen = (
        rated.groupBy("block", "part", "piece_of")
        .agg(F.count(F.lit(1)).alias("n_found"), F.min(F.col("n_wholes") * F.lit(1_000_000_000) + F.col("at")).alias("rarest"))
        .withColumn("own", own)
        .where(F.col("n_found") == F.size("own"))
        .select("block", "part", F.expr("own[CAST(rarest % 1000000000 AS INT)]").alias("piece"))
    )
    if part_rows <= whole_rows:
        return sized(chosen, part_rows).join(lists, ["block", "piece"]).select("block", "part", "whole")
    return chosen.join(sized(lists, whole_rows), ["block", "piece"]).select("block", "part", "whole")


def partial_names(records: DataFrame, sites: DataFrame, regex: bool = False) -> DataFrame:
    """Distinct (block, record_name, site_name) where one name is part of the other.

    Inputs have columns ``block`` and ``name``.  A site name may contain the record name in any case; a
    record name must contain the site name as it is written.  With ``regex`` the site name is read as a
    pattern (see :func:`~tarnbook.functions.text.name_as_pattern`).  Blank names, and patterns
    without any literal text, match nothing.  Stores the distinct names, which are read several times.
    """

    def spellings(df: DataFrame) -> DataFrame:
        named = df.select("block", "name").where(F.col("block").isNotNull() & (F.trim("name") != ""))
        # Names are short and their pieces many: keep them spread over as many tasks as a shuffle has.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cut_lineage(named.repartition(tasks, "block", "name").distinct())

    record_names, site_names = spellings(records), spellings(sites)
    upper = F.upper("name")
    in_site = _inside(
        record_names.select("block", F.col("name").alias("part"), upper.alias("piece_of")),
        site_names.select("block", F.col("name").alias("whole"), upper.alias("whole_text")),
    ).where(F.contains(F.upper("whole"), F.upper("part"))).select(
        "block", F.col("part").alias("record_name"), F.col("whole").alias("site_name")
    )

    if regex:
        # What the pattern demands literally: the longest stretch without a free character.
        stretches = F.split(F.regexp_replace("name", r"[()]", ""), r"\.")
        literal = F.array_max(F.transform(stretches, lambda s: F.struct(F.length(s).alias("n"), s.alias("text"))))["text"]
        fits = F.regexp_like(F.col("whole"), name_as_pattern(F.col("part")))
    else:
        literal = F.col("name")
        fits = F.contains(F.col("whole"), F.col("part"))
    in_record = _inside(
        site_names.select("block", F.col("name").alias("part"), literal.alias("piece_of")).where(F.length("piece_of") > 0),
        record_names.select("block", F.col("name").alias("whole"), F.col("name").alias("whole_text")),
    ).where(fits).select("block", F.col("whole").alias("record_name"), F.col("part").alias("site_name"))
    return in_site.unionByName(in_record).distinct()


def name_match(
    records: DataFrame,
    sites: DataFrame,
    record_id: str,
    site_id: str,
    block: tuple[str, str] = ("county", "site_county"),
    name: tuple[str, str] = ("name", "site_name"),
    policy: str = "all",
    regex: bool = False,
) -> DataFrame:
    """(record_id, site_id) by partial name inside a block; column pairs are (record's, site's).

    ``all`` keeps every site with a fitting name.  ``best`` keeps one: the site whose name is the same in any
    case if there is exactly one, else the one closest in length, the lowest ``site_id`` deciding.
    """
    r = records.select(F.col(record_id), F.col(block[0]).alias("block"), F.col(name[0]).alias("name"))
    s = sites.select(F.col(site_id), F.col(block[1]).alias("block"), F.col(name[1]).alias("name"))
    pairs = partial_names(r, s, regex)
    if policy == "all":
        targets = pairs.join(s.withColumnRenamed("name", "site_name"), ["block", "site_name"])
        targets = targets.select("block", F.col("record_name").alias("name"), site_id)
    elif policy == "best":
        spelled = s.groupBy("block", "name").agg(F.count(F.lit(1)).alias("n_sites"), F.min(site_id).alias(site_id))
        rated = pairs.join(spelled.withColumnRenamed("name", "site_name"), ["block", "site_name"])
        same = F.upper("site_name") == F.upper("record_name")
        choice = rated.groupBy("block", "record_name").agg(
            F.sum(F.when(same, F.col("n_sites")).otherwise(0)).alias("n_same"),
            F.min(F.when(same, F.col(site_id))).alias("same_site"),
            F.min(F.struct(F.abs(F.length("site_name") - F.length("record_name")).alias("gap"), F.col(site_id).alias("site"))).alias("close"),
        )
        targets = choice.select(
            "block", F.col("record_name").alias("name"),
            F.when(F.col("n_same") == 1, F.col("same_site")).otherwise(F.col("close.site")).alias(site_id),
        )
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return r.join(targets, ["block", "name"]).select(record_id, site_id)
