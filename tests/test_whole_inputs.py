"""Fixtures read every row and the whole text; rows, dates and published files
are not lost on the way."""

from pyspark.sql import functions as F

from postlake.functions import scalars as X
from postlake.operators import upsert as U
from postlake.session import read_text, scratch_path, write_text
from postlake.sources import fixtures as FX
from postlake.sources.tables import table
from tests.conftest import SF_SMALL


def total(df, c):
    return df.agg(F.sum(F.char_length(c)), F.count("*")).first()


def test_fixtures_hold_the_whole_tables(spark):
    docs = table(spark, SF_SMALL, "documents")
    chars, rows = total(docs, "text")
    assert tuple(total(FX.raw_reddit_submission(spark, SF_SMALL), "title")) == (chars, rows)
    tag = len(" #topic0")
    assert tuple(total(FX.raw_bluesky_post(spark, SF_SMALL), F.col("record.text"))) == (chars + tag * rows, rows)
    assert tuple(total(FX.raw_mastodon_status(spark, SF_SMALL), "content")) == (chars + len("<p></p>") * rows, rows)
    turns = table(spark, SF_SMALL, "conversations")
    assert tuple(total(FX.raw_reddit_comment(spark, SF_SMALL), "body")) == tuple(total(turns, "text"))
    first = FX.raw_reddit_comment(spark, SF_SMALL).where(F.col("id").endswith("_0")).select("parent_id").distinct()
    assert all(r.parent_id.startswith("t3_d") for r in first.collect())


def test_rows_without_a_sequence_number_are_kept(spark):
    cols = "platform string, object_id string, text string, seq bigint, value double"
    batch = spark.createDataFrame([("p", "1", "a", None, 1.0), ("p", "2", "b", None, 2.0), ("p", "2", "c", 5, 3.0)], cols)
    got = {r.object_id: (r.text, r.value) for r in U.first_copies(batch).collect()}
    assert got == {"1": ("a", 1.0), "2": ("b", 2.0)}
    cur = spark.createDataFrame([("p", "1", "old", 1, 0.0)], cols)
    after = U.upsert(cur, batch, replace=("text", "seq", "value"), replace_if_reddit=())
    assert {r.object_id: r.text for r in after.collect()} == {"1": "a", "2": "b"}


def test_texts_without_a_full_date_do_not_parse(spark):
    rows = spark.createDataFrame([(t,) for t in ("12:30:00", "T10", "2024", "2024-02", "2024-02-03", "2024-02-03T04:05:06Z",
                                                 "2024-02-03T04:05:06.123+01:00", "x2024-02-03", "2024-13-01")], "t string")
    got = {r.t: r.ts for r in rows.select("t", X.parse_iso_ts("t").alias("ts")).collect()}
    assert {t for t, v in got.items() if v} == {"2024-02-03", "2024-02-03T04:05:06Z", "2024-02-03T04:05:06.123+01:00"}


def test_publishing_replaces_in_one_rename(spark):
    path = scratch_path(spark, "published")
    for text in ("one", "two"):
        write_text(spark, path, text)
        assert read_text(spark, path) == text
