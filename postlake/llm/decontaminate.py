"""Benchmark decontamination by a prefix-filtered set join, native throughout.

Every benchmark item is cut into windows of consecutive words.  The words of a
window are ordered by rarity in the corpus (document frequency, counted over all
documents).  A document can hold a window only if it holds all of its words, so
a prefix of one word, the rarest, is enough to join on.  A document word that
meets a prefix word is a candidate; it must leave room for the window before and
after it (positional bound, which implies the length bound), and the words at
that place must equal the window's.

Equal windows of several items are one class: places are found for classes, and
the items of a class join afterwards, once for each document.  Texts are cut into
words once, and the words are written.

Classes are broadcast in blocks of at most ``block_windows`` rows and about
``BLOCK_BYTES``; a larger benchmark takes more passes over the words, never a larger
broadcast.

Defined results: a null text has no words; an item without words has no window;
an item of fewer words than ``window`` is one window.  Items with equal ids are
one item; an item with a null id hits words but is neither counted nor listed.
Of equally rare words of a window the first by name is its prefix, where it stands
first.  Repeated document rows get equal results.  Texts of any length are taken
whole.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import place, plain, stored, words

WINDOW_WORDS = 10
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 64 << 20
WORD_COST = 16  # of a word in a broadcast row, beside its text


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, win): the windows of every item, as arrays of words."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return (w.select("item_id", "w", F.explode(starts).alias("at"))
            .select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("win")).distinct())


def _blocks(rows: DataFrame, text: Column, n_words: Column, block_rows: int) -> int:
    """Broadcasts that the rows take, by their number and by their bytes."""
    n, held = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(text) + WORD_COST * n_words)).first()
    return max(1, -(-n // block_rows), -(-(held or 0) // BLOCK_BYTES))


def _prefixed(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds each class's rarest word, where it first stands in the window, and
    the window's length.  Words of the benchmark are counted in all documents."""
    vocabulary = classes.select(F.explode("win").alias("word")).distinct()
    if _blocks(vocabulary, F.col("word"), F.lit(1), BLOCK_WINDOWS * WINDOW_WORDS) == 1:
        vocabulary = F.broadcast(vocabulary)
    seen = tokens.select(F.explode(F.array_distinct("w")).alias("word"))
    freq = seen.join(vocabulary, "word", "left_semi").groupBy("word").count()
    ranked = classes.select("wid", F.posexplode("win").alias("off", "word")).join(freq, "word", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("word"), F.col("off"))).alias("p"))
    return classes.join(ranked, "wid").select(
        "wid", "win", F.size("win").alias("len"), F.col("p.word").alias("prefix"), F.col("p.off").alias("off"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document row: (doc_id, th, n_words, n_hit, items), ``items``
    being the sorted ids whose windows occur and ``th`` xxhash64 of the text."""
    windows = stored(item_windows(items, item_col, item_text_col, window), "windows")
    # Numbers are fixed once they are written.
    classes = stored(windows.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win"), "classes")
    links = stored(windows.where("item_id is not null").join(classes, "win").select("wid", "item_id"), "links")
    tokens = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                                words(F.col(text_col)).alias("w"))
                    .withColumn("n_words", F.size("w").cast("bigint")), "words")
    prefixed = stored(_prefixed(classes, tokens), "prefixed")
    blocks = _blocks(prefixed, F.array_join("win", " "), F.col("len"), block_windows)
    found = []
    for block in range(blocks):
        part = prefixed.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == block) if blocks > 1 else prefixed
        exploded = tokens.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "word"))
        start = F.col("pos") - F.col("off")
        found.append(
            exploded.join(F.broadcast(part), F.col("word") == F.col("prefix"))
            .where((start >= 0) & (start + F.col("len") <= F.size("w")))
            .where(F.slice("w", start + 1, F.col("len")) == F.col("win"))
            .select("doc_id", "th", start.alias("start"), (start + F.col("len")).alias("end"), "wid"))
    hits = stored(reduce(DataFrame.unionAll, found), "hits")
    # Words inside any occurrence: the union of the spans, walked in order.
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).alias("reach")),
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(x["end"] - F.greatest(x["start"], s["reach"]), F.lit(0))).cast("bigint").alias("hit"),
            F.greatest(s["reach"], x["end"]).alias("reach")))["hit"]
    per_doc = hits.groupBy("doc_id", "th").agg(covered.alias("n_hit"))
    listed = (hits.select("doc_id", "th", "wid").distinct().join(links, "wid").groupBy("doc_id", "th")
              .agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    out = tokens.select("doc_id", "th", "n_words")
    for i, more in enumerate((per_doc, listed)):
        more = more.withColumnsRenamed({"doc_id": f"d{i}", "th": f"t{i}"})
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col(f"d{i}")) & (F.col("th") == F.col(f"t{i}")), "left").drop(f"d{i}", f"t{i}")
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    own, names = plain(docs)
    id_at, text_at = place(names, id_col), place(names, text_col)
    hit = (decontaminate(own, items, id_at, text_at, **options).where("n_hit > 0")
           .select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th")).distinct())
    same = (F.col(id_at).cast("bigint").eqNullSafe(F.col("hit_id"))) & (F.xxhash64(text_at) == F.col("hit_th"))
    return own.join(hit, same, "left_anti").toDF(*names)
