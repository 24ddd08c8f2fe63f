"""Site lists of several organisations brought to one schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbook.functions.numbers import west
from tarnbook.operators.tidy import stack

# Column names of the three shapes of site list (target: source; no entry: not recorded).
_PLACE = {"latitude": "Location_Lat", "longitude": "Location_Lon", "date_raw": "Date"}
LAKE_LIST = {"group": "Group", "lake": "LAKE", "site": "Site", "code": "CODE", **_PLACE}
RIVER_LIST = {"group": "Group", "river": "RIVER", "site": "Site", "code": "CODE", **_PLACE}
SAMPLE_LIST = {"group": "Group", "lake": "Lake.Name", "site": "Site.Group", "code": "Sample.Code", **_PLACE}

COLUMNS = ("group", "lake", "river", "site", "code", "latitude", "longitude", "date_raw")


def harmonise(sources: Mapping[str, DataFrame], mappings: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One table of all sites: rows without a latitude are dropped, longitudes are western."""

    def shaped(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
        def column(c: str):
            kind = "double" if c in ("latitude", "longitude") else "string"
            return (F.col(f"`{mapping[c]}`") if c in mapping else F.lit(None)).cast(kind).alias(c)

        return df.select(*[column(c) for c in COLUMNS])

    all_sites = stack(*[shaped(df, mappings[name]) for name, df in sources.items()], fill=False)
    return all_sites.dropna(subset=["latitude"]).withColumn("longitude", west(F.col("longitude"), "if_positive"))
