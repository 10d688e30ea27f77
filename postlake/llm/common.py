"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlake.session import scratch_path

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: As ASCII_LOWER, and every byte that is no word character becomes a space
#: (word characters: 0-9, a-z and all bytes of non-ASCII characters).
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

#: Everything that separates words of the word class above.
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, which the caller deletes when all that was
    derived from it is itself written."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it again: cuts the
    lineage and survives the loss of executors."""
    return written(df, name)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII strings take the fast built-in."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def words(text: Column) -> Column:
    """Words of a text (null: none): lower-cased runs of digits, letters a-z
    and non-ASCII characters."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), WORD_GAP), "")


#: Rows and bytes of the Arrow batches that go to Python.  Texts are long, and an
#: executor holds a batch several times over, outside its heap.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def map_arrow(df: DataFrame, f, schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with small batches; sets the session's batch limits.
    Python workers serve many tasks: what a task leaves unused goes back to the
    system at its end."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def plain(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... by place, and their own names.
    No name that an operator adds can clash with these, whatever the table's
    are; ``toDF(*names, ...)`` brings the own names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def place(names: list[str], name: str) -> str:
    """Name in ``plain`` of a column: the exact name, else the one that equals
    it without regard to case, as Spark resolves names."""
    exact = [i for i, x in enumerate(names) if x == name] or [i for i, x in enumerate(names) if x.lower() == name.lower()]
    if len(exact) != 1:
        raise ValueError(f"column {name!r} occurs {len(exact)} times in {names}")
    return f"c{exact[0]}"


def free_name(names: list[str], wanted: str) -> str:
    """``wanted``, or with a number behind if the table has a column of that
    name (in any case)."""
    taken, n = {x.lower() for x in names}, 1
    while (name := wanted if n == 1 else f"{wanted}_{n}").lower() in taken:
        n += 1
    return name


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named binary column has about ``limit``
    bytes in each (one row at least); no row is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
