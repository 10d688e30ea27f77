"""Landed raw payloads: one JSON object per line, one folder per platform.

Q3: a malformed line never stops a read.  Lines that do not parse are kept
whole in ``_corrupt_record`` (PERMISSIVE mode) and split off, so the good
rows go on and the bad ones can be quarantined with their raw text.  The same
parsing serves batch and stream; blank lines are no records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The lines of column ``value`` parsed into ``schema`` plus CORRUPT."""
    s = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.where(F.trim("value") != "").select(parsed.alias("p")).select("p.*")


def parse_payloads(lines: DataFrame, schemas: dict[str, T.StructType]) -> DataFrame:
    """Lines (payload, value) of many payload kinds, each parsed once: (payload,
    line, and for each kind a struct that is null for other kinds).  ``line`` is the
    raw text of a line that does not parse or is of an unknown kind, else null."""
    known = {name: T.StructType(s.fields + [T.StructField(CORRUPT, T.StringType())]) for name, s in schemas.items()}
    parsed = lines.where(F.trim("value") != "").select("payload", "value", *[
        F.when(F.col("payload") == name, F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})).alias(name)
        for name, s in known.items()])
    bad = F.coalesce(*[F.col(name)[CORRUPT] for name in known], F.when(~F.col("payload").isin(list(known)), F.col("value")))
    return parsed.select("payload", bad.alias("line"), *[F.col(name).dropFields(CORRUPT).alias(name) for name in known])


def split_corrupt(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines with their raw text): two filters."""
    good = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows in ``schema``, corrupt lines with their raw text)."""
    return split_corrupt(parse_lines(spark.read.text(path), schema))
