"""Nested map file: folder per group, folder per subgroup, placemark per row.

The document is a table of fragments with sort keys.  It is sorted by range and written as text, so that the
part files in name order are the document; a folder may run over many tasks, none is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbook.session import cut_lineage

ORDER = ("part", "group1", "depth1", "group2", "depth2", "name", "lon", "lat", "id")

# The fragments of the document.
HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>'
TITLE = "    <name>%s</name>"
OUTER_OPEN = "    <Folder>\n      <name>%s</name>"
INNER_OPEN = "      <Folder>\n        <name>%s</name>"
PLACEMARK = (
    "        <Placemark>\n"
    "          <name><![CDATA[%s]]></name>\n"
    "          <description><![CDATA[%s]]></description>\n"
    "          <Point>\n"
    "            <coordinates>%s,%s,0</coordinates>\n"
    "          </Point>\n"
    "        </Placemark>"
)
INNER_CLOSE = "      </Folder>"
OUTER_CLOSE = "    </Folder>"
FOOTER = "  </Document>\n</kml>"


def _escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def _in_cdata(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("NA")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def nested_fragments(
    df: DataFrame, group1: str, group2: str, name: str, desc: str, lon: str, lat: str, row_id: str, title: str
) -> DataFrame:
    """The document as rows ``(*ORDER, fragment)``; groups must not be null.  Runs a job that stores the rows."""
    # Stored once: the folders are read from it by their columns alone.
    rows = cut_lineage(df.select(
        F.col(group1).alias("group1"), F.col(group2).alias("group2"), F.col(name).alias("name"),
        F.col(desc).alias("desc"), F.col(lon).alias("lon"), F.col(lat).alias("lat"),
        F.col(row_id).cast("string").alias("id"),
    ))

    def keyed(source: DataFrame, part: int, depth1: int, depth2: int, fragment: Column) -> DataFrame:
        def own(c: str, kind: str) -> Column:
            return F.col(c).cast(kind) if c in source.columns else F.lit(None).cast(kind)

        return source.select(
            F.lit(part).alias("part"), own("group1", "string").alias("group1"), F.lit(depth1).alias("depth1"),
            own("group2", "string").alias("group2"), F.lit(depth2).alias("depth2"), own("name", "string").alias("name"),
            own("lon", "double").alias("lon"), own("lat", "double").alias("lat"), own("id", "string").alias("id"),
            fragment.alias("fragment"),
        )

    outer, inner = rows.select("group1").distinct(), rows.select("group1", "group2").distinct()
    once = df.sparkSession.range(1).select()
    placemark = F.format_string(
        PLACEMARK, _in_cdata(F.col("name")), _in_cdata(F.col("desc")), F.col("lon").cast("string"), F.col("lat").cast("string")
    )
    head = keyed(once, 0, 0, 0, F.lit(HEADER + "\n" + TITLE % title.replace("&", "&amp;").replace("<", "&lt;")))
    return (
        head.unionByName(keyed(outer, 1, 0, 0, F.format_string(OUTER_OPEN, _escaped(F.col("group1")))))
        .unionByName(keyed(inner, 1, 1, 0, F.format_string(INNER_OPEN, _escaped(F.col("group2")))))
        .unionByName(keyed(rows, 1, 1, 1, placemark))
        .unionByName(keyed(inner, 1, 1, 2, F.lit(INNER_CLOSE)))
        .unionByName(keyed(outer, 1, 2, 0, F.lit(OUTER_CLOSE)))
        .unionByName(keyed(once, 2, 0, 0, F.lit(FOOTER)))
    )


def export_nested_kml(
    df: DataFrame, group1: str, group2: str, name: str, desc: str, lon: str, lat: str, row_id: str, path: str,
    title: str = "Site status",
) -> None:
    """Write the document; its part files, concatenated in name order, are one KML file."""
    fragments = nested_fragments(df, group1, group2, name, desc, lon, lat, row_id, title)
    fragments.orderBy(*ORDER).select("fragment").write.text(path)
