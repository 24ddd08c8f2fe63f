"""Master tables: one row per site, one per site, species and year, and the list of all catches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.dates import first_of_january
from tarnbook.operators.groups import first_non_null, top_row
from tarnbook.operators.joins import left_lookup
from tarnbook.operators.nearest import BROADCAST_ROWS
from tarnbook.operators.tidy import relocate
from tarnbook.plans.status import WATCHED, Focal, area_status, site_status
from tarnbook.session import cut_lineage
from tarnbook.sources.kml import export_nested_kml, nested_fragments
from tarnbook.sources.schemas import CATCH_NOTES

SITE = ("county", "name", "site_code", "primary_watershed")
STATUS = ("data_source", "last_sampled_year", "status_a", "status_b", "site_status", "ws_first_a", "ws_first_b", "ws_status")
MORPHOLOGY = ("volume_m3", "surface_area_ha", "max_depth_m", "mean_depth_m", "area_under_6m_ha", "shoreline_dev")


def site_coordinates(
    sites: DataFrame,
    catches: DataFrame,
    records: DataFrame | None = None,
    keys: Sequence[str] = SITE,
    xy: tuple[str, str] = ("lon", "lat"),
) -> DataFrame:
    """One coordinate per site: the mean of its places in the site table, else of those of its catches, else
    the place of its first record.

    The sources are reduced to distinct places and stacked, so one aggregation decides; nothing fans out.  Nearly every row of the site
    table is a place of its own: it is dealt evenly first, so that no task has as many places as a file has rows.
    """
    def places(df: DataFrame, rank: int) -> DataFrame:
        return df.select(*keys, *xy, F.lit(rank).alias("__rank"))

    stacked = places(sites, 0).hint("rebalance").unionByName(places(catches, 1)).distinct()
    if records is not None:
        first = top_row(records.select(*keys, *xy, "record_id"), keys, ["record_id"])
        stacked = stacked.unionByName(places(first, 2))

    def best(c: str) -> Column:
        return F.coalesce(*[F.avg(F.when(F.col("__rank") == rank, F.col(c))) for rank in (0, 1, 2)]).alias(c)

    return stacked.groupBy(*keys).agg(*[best(c) for c in xy])


def site_morphology(
    sites: DataFrame, cols: Sequence[str] = MORPHOLOGY, keys: Sequence[str] = SITE, order_by: Sequence[str] = ("site_id",)
) -> DataFrame:
    """One row per site: of every measure the first value there is."""
    return first_non_null(sites, keys, cols, order_by)


def site_master(
    detections: DataFrame,
    sites: DataFrame,
    catches: DataFrame,
    records: DataFrame | None = None,
    keys: Sequence[str] = SITE,
    xy: tuple[str, str] = ("lon", "lat"),
    morphology: Sequence[str] = MORPHOLOGY,
    focal: Focal = WATCHED,
    rules: str = "v3",
    databases: tuple[str, str] = ("main", "records"),
) -> DataFrame:
    """Status, source, coordinates, status of watershed and county, and morphology of every site.

    The site summary is small and stored; the statuses of the areas are made from it, and detections are read once.
    """
    status = cut_lineage(site_status(
        detections, keys, "primary_watershed", "species_name", "year", focal, rules, ("database", *databases)
    ))
    # Joins on the site come one after the other, so that one shuffle of the sites serves them all.
    located = left_lookup(status, site_coordinates(sites, catches, records, keys, xy), keys)
    located = left_lookup(located, site_morphology(sites, morphology, keys), keys)
    for key, name in (("primary_watershed", "ws_status"), ("county", "county_status")):
        located = left_lookup(located, area_status(status, key, rules, focal, name), key)
    return located


def community_list(
    catches: DataFrame,
    master: DataFrame,
    records: DataFrame,
    keys: Sequence[str] = SITE,
    status_cols: Sequence[str] | None = None,
    records_too: bool = False,
) -> DataFrame:
    """Every catch with its site's status and morphology, and the records dated 1 January of their year.

    ``catches`` are those enriched by visit (:func:`~tarnbook.plans.status.enrich_catches`): a catch on two visits is listed
    twice.  ``status_cols`` are the master's columns to put on a catch: if not given, the status and all measures it has.
    Records come without a status, unless ``records_too``.
    """
    if status_cols is None:
        status_cols = [*STATUS, *[c for c in MORPHOLOGY if c in master.columns]]
    lookup_table = master.select(*keys, *status_cols)
    main = left_lookup(catches, lookup_table, keys)
    second = records.withColumn("date", first_of_january(F.col("year")))
    if records_too:
        second = left_lookup(second, lookup_table, keys)
    return main.unionByName(second, allowMissingColumns=True)


def site_species_year(
    catches: DataFrame,
    matched: DataFrame,
    sites: DataFrame,
    status: DataFrame,
    keys: Sequence[str] = SITE,
    xy: tuple[str, str] = ("lon", "lat"),
    focal: Focal = WATCHED,
    rules: str = "v2",
    drop: Sequence[str] = CATCH_NOTES,
) -> DataFrame:
    """The earlier master: one row per site, species and year with the databases it comes from.

    Catches get the place of the site's first visit, records their own.  ``catches`` carry a unique ``row_id``; columns in ``drop``
    (those no analysis uses) are left out.
    """
    main = catches.drop(*xy).withColumn("__order", F.lit(0)).withColumn("row_id", F.col("row_id").cast("string"))
    second = matched.withColumn("__order", F.lit(1)).withColumn("row_id", F.col("record_id").cast("string")).drop("record_id")
    stacked = _numbered(main.unionByName(second, allowMissingColumns=True), keys)

    group = ["species_name", "year"]
    carried = [c for c in stacked.columns if c not in (*_NUMBER, *keys, *group, "database", "row_id", *drop)]
    # Two databases need no set, whose groups Spark keeps as objects.
    few = stacked.select("database").where("database is not null").distinct().limit(3).count() < 3
    low, high = F.min("database"), F.max("database")
    label = F.concat_ws("+", low, F.when(high != low, high)) if few else F.array_join(F.array_sort(F.collect_set("database")), "+")
    # Rows are moved once, by their site's number and without its names; grouping and joins below find them where they are.
    dealt = stacked.select(*_NUMBER, *group, "database", "row_id", *carried).repartition(*_NUMBER)
    rows = dealt.groupBy(*_NUMBER, *group).agg(
        label.alias("database"), F.min_by(F.struct(*carried), F.struct("__order", "row_id")).alias("__first")
    ).select(*_NUMBER, *group, "database", "__first.*")

    # What is known of a site is put together on the small site table, so that the rows above are joined once.
    site = cut_lineage(status.select(*keys, "status_a", "status_b", "site_status"))
    known = site
    for key, name in (("primary_watershed", "ws_status"), ("county", "county_status")):
        areas = cut_lineage(area_status(site, key, rules, focal, name))
        known = left_lookup(known, F.broadcast(areas) if areas.count() <= BROADCAST_ROWS else areas, key)
    place = top_row(_numbered(sites.select(*keys, *xy, "site_id"), keys).drop(*keys), _NUMBER, ["site_id"]).select(*_NUMBER, *[F.col(c).alias(f"__{c}") for c in xy])
    named = stacked.groupBy(*_NUMBER).agg(*[F.any_value(c).alias(c) for c in keys])
    told = left_lookup(left_lookup(named, _numbered(known, keys).drop(*keys), _NUMBER), place, _NUMBER)

    joined = rows.join(told, list(_NUMBER)).select(*keys, *rows.columns[len(_NUMBER):], *[c for c in told.columns if c not in (*_NUMBER, *keys)])
    placed = joined.withColumns({c: F.when(F.col("__order") == 0, F.col(f"__{c}")).otherwise(F.col(c)) for c in xy})
    return relocate(placed.drop("__order", *[f"__{c}" for c in xy]), ["database"], after="county_status")


_NUMBER = ("__site", "__site_too")


def _numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A site's keys as 128 bits (two hashes), so that its names needn't move with every row; a null is a value, in its own place."""
    told = [*keys, *[F.col(c).isNull() for c in keys]]
    return df.withColumns({_NUMBER[0]: F.xxhash64(*told), _NUMBER[1]: F.xxhash64(F.lit("too"), *told)})


def _map_rows(master: DataFrame, xy: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("site_code", "last_sampled_year")}
    county = F.coalesce("county", F.lit("Unknown_County"))
    return master.dropna(subset=list(xy)).select(
        county.alias("county"), "site_status", "name", *xy,
        F.concat(
            F.lit("County: "), county, F.lit("<br>Site Code: "), shown["site_code"],
            F.lit("<br>Last Sampled: "), shown["last_sampled_year"],
        ).alias("description"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("__id"),
    )


def nested_export(master: DataFrame, xy: tuple[str, str] = ("lon", "lat"), keys: Sequence[str] = SITE, title: str = "Site status") -> DataFrame:
    """The map document as sortable fragments: county, status, site."""
    return nested_fragments(_map_rows(master, xy, keys), "county", "site_status", "name", "description", *xy, "__id", title)


def write_nested_export(master: DataFrame, path: str, xy=("lon", "lat"), keys=SITE, title: str = "Site status") -> None:
    export_nested_kml(_map_rows(master, xy, keys), "county", "site_status", "name", "description", *xy, "__id", path, title)
