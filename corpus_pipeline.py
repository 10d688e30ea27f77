"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written to the shared folder and read again as the next stage's documents.  All
stages but the last return the columns of documents.

Defined results: a null text has no letters, so the first stage drops its row, as it
does empty texts; given to another stage, a null or empty text has no lines, no
windows, fingerprint zero and no tokens.  Rows without an id are kept apart from each
other by their texts.  Repeated rows are treated alike, and of those the near-duplicate
stage keeps one.  Texts of any length are taken whole.  An empty table passes every
stage.  Columns beyond those of documents are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import bpe, decontaminate, language_id, line_dedup, simhash
from postlake.llm.common import read, written
from postlake.session import delete

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (no letters, or no
    language with the needed probability)."""
    found = language_id.identify(docs.select(*COLUMNS))
    return found.where(~F.col("id_rejected")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document has; a document of which
    nothing but white space is left goes."""
    done = line_dedup.line_dedup(docs.select(*COLUMNS))
    emptied = (F.col("lines_gone") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s", " "))) == 0)
    length = F.when(F.col("lines_gone") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return done.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(*COLUMNS)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every SimHash component."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents, and a digest of the decoded bytes."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near_copies),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("byte_bpe", encode_texts),
]

#: No SQL: the language model, the alignment and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table is deleted once the next stage's is written; the last one stays,
    since the result is read from it."""
    docs, at = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        used = at
        docs, at = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if used:
            delete(spark, used)
    return STAGES[-1][1](spark, docs, sf_dir)
