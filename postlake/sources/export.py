"""File export (K4-K7, N7): JSON, CSV or Parquet chosen by the path suffix.

Exports are distributed writes (a directory of part files), never a
driver-side list.  JSON is JSON Lines (one object per line); nested values
stay nested.  CSV cannot hold arrays or maps, so those become JSON text.

Part files are compressed: a record holds its text twice and more (``raw_data``,
``title``), and an export as plain text is several times its posts.  Readers go by the
suffix of the part files (``.json.gz``); ``compression="none"`` writes plain ones.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import schemas as S
from postlake.functions.scalars import json_of
from postlake.operators.normalize import export_record
from postlake.session import PACKED_TABLE, PACKED_TEXT

log = logging.getLogger(__name__)

# Accepted suffixes and their formats.
FORMATS = {".json": "json", ".jsonl": "json", ".csv": "csv", ".parquet": "parquet"}
CSV_NULL = "\\N"


def format_of(path: str) -> str:
    """K7: the format from the suffix; unknown suffixes are an error raised
    before any Spark action."""
    low = path.lower().rstrip("/")
    for suf, fmt in FORMATS.items():
        if low.endswith(suf):
            return fmt
    raise ValueError(f"unsupported export format for {path!r}; use one of {sorted(FORMATS)}")


def _csv_ready(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(json_of(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export_posts(posts: DataFrame, path: str, platform: str | None = None,
                 mode: str = "errorifexists", compression: str | None = None) -> int | None:
    """K4-K7: write the export records of ``posts`` (optionally one
    platform) to ``path``.  Returns None when there is nothing to write (a
    warning, no files), else the format used.  ``compression`` of the part files,
    if not that of the format."""
    fmt = format_of(path)
    df = posts if platform is None else posts.where(F.col("platform") == platform)
    if df.isEmpty():
        log.warning("no posts to export to %s", path)
        return None
    rec = export_record(df)
    packed = PACKED_TABLE if fmt == "parquet" else PACKED_TEXT
    w = (_csv_ready(rec) if fmt == "csv" else rec).write.mode(mode).options(**{**packed, **({"compression": compression} if compression else {})})
    if fmt == "json":
        w.option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        # Nulls as \N so that empty strings survive a round trip.
        w.option("header", True).option("escape", '"') \
            .option("nullValue", CSV_NULL).option("emptyValue", '""') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.parquet(path)
    return fmt


EXPORT_SCHEMA = T.StructType(
    [f for f in S.POST.fields if f.name not in ("tags", "metrics", "created_at", "collected_at")] + [
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metrics", S.METRICS),
        T.StructField("created_at", T.StringType()),
        T.StructField("collected_at", T.StringType()),
    ])


def read_export(spark, path: str) -> DataFrame:
    """Read an export back with its explicit schema (round trip)."""
    fmt = format_of(path)
    if fmt == "json":
        return spark.read.schema(EXPORT_SCHEMA).json(path)
    if fmt == "parquet":
        return spark.read.schema(EXPORT_SCHEMA).parquet(path)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(
        f.dataType, (T.ArrayType, T.MapType)) else f.dataType) for f in EXPORT_SCHEMA.fields])
    df = spark.read.schema(flat).option("header", True).option("multiLine", True) \
        .option("escape", '"').option("nullValue", CSV_NULL).option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return df.withColumn("tags", F.from_json("tags", T.ArrayType(T.StringType()))) \
             .withColumn("metrics", F.from_json("metrics", S.METRICS))


def from_export(df: DataFrame) -> DataFrame:
    """Export record back to the post schema (ISO text to instants)."""
    return df.withColumn("created_at", F.to_timestamp("created_at")) \
             .withColumn("collected_at", F.to_timestamp("collected_at")) \
             .select(*S.POST_COLUMNS)


def write_jdbc(posts: DataFrame, url: str, table: str, properties: dict | None = None,
               mode: str = "append", num_partitions: int | None = None) -> None:
    """The export records into a relational table (PostgreSQL, MySQL...)
    through Spark's JDBC writer; arrays and maps become JSON text.  Needs the
    database's JDBC driver on the classpath (not exercised in this repo's
    tests: no database server is started)."""
    df = _csv_ready(export_record(posts))
    if num_partitions:
        df = df.repartition(num_partitions)
    df.write.mode(mode).jdbc(url, table, properties=properties or {})
