"""Delimited files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbook.functions.numbers import to_number
from tarnbook.operators.tidy import blank_to_null, canonical_columns

_MALFORMED = "__malformed"


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    na: str = "NA",
    blank: str = "null",
    names: Mapping[str, str] | None = None,
    sep: str = ",",
    multi_line: bool = False,
    malformed: str | None = None,
) -> DataFrame:
    """Read the declared columns of a delimited file by the names in its header.

    Names are compared in snake case (``Site.Code`` is ``site_code``); ``names`` (header to declared) wins where it has an
    entry.  Columns may stand in any order, others are left out; a declared column that is missing, or that two columns
    would become, is an error.  ``na`` is the text of a missing value.  Blank text becomes null, or stays
    (``blank="keep"``).  A number that cannot be read becomes null rather than stopping the job.

    Values may stand in double quotes, a quote inside them doubled; separators in them are text.  So are line ends where
    ``multi_line`` says that the files have such (a file is then read by one task, not in pieces).  A line with more or fewer
    values than the header is kept, filled up with nulls; ``malformed`` names a column to hold its text, which is
    null for all other lines.
    """
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reader = spark.read.option("header", True).option("nullValue", na).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    if blank == "keep":
        reader = reader.option("emptyValue", "")
    raw = reader.csv(path)
    if malformed:
        if malformed in declared.names:
            raise ValueError(f"{malformed} is a declared column")
        whole = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns] + [T.StructField(_MALFORMED, T.StringType())])
        raw = reader.schema(whole).option("columnNameOfCorruptRecord", _MALFORMED).option("enforceSchema", False).csv(path)
        # Whether a line is malformed only shows when all its values are read, whatever a query goes on to use.
        values = F.concat_ws("", *[F.col(f"`{c}`") for c in raw.columns if c != _MALFORMED])
        raw = raw.withColumn(_MALFORMED, F.when(F.length(values) >= 0, F.col(_MALFORMED)))
    raw = canonical_columns(raw, {**(names or {}), _MALFORMED: _MALFORMED} if malformed else names)
    count = Counter(raw.columns)
    for what, bad in (("missing", [f.name for f in declared if not count[f.name]]), ("twice", [f.name for f in declared if count[f.name] > 1])):
        if bad:
            raise ValueError(f"{what} in {path}: {bad}; its columns are {raw.columns}")
    df = raw.select(*declared.names, *([F.col(_MALFORMED).alias(malformed)] if malformed else []))
    if blank != "keep":
        df = blank_to_null(df)
    return df.select(
        *[
            to_number(F.col(f.name)).try_cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, T.NumericType)
            else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in declared
        ],
        *([malformed] if malformed else []),
    )


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write delimited files with a header; nulls as ``NA``.

    Values with a separator, a quote or a line end are quoted, quotes in them doubled; blanks around a value stay.  Files with line
    ends in values are read back with ``multi_line``.
    """
    writer = df.write.mode(mode).option("header", True).option("nullValue", "NA").option("emptyValue", "").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table; used between jobs in place of delimited files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
