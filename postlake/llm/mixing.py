"""Mixing sources to target weights by capped water-filling, native throughout.

The mix takes ``share`` times the words of all documents.  Every source gets a
part in proportion to its weight, but at most ``epochs`` times its own words.
Water-filling: sources whose part is above their cap are clamped, what they cannot
take is dealt to the others by weight, and so on until no part is above its cap.
A round is one aggregate over the table of sources, of which the driver sees three
numbers; sums are exact decimals, so they do not depend on any order.

Sampling: a source of S words and a target of t words gives t div S whole
repetitions of all its documents.  For the remaining words its documents stand in
an order drawn by a seeded hash of id and text, and those at the front are taken
once more; the one at the mark is taken in part, its first words (or, with
``whole_documents``, whole if more than half of it lies before the mark).  The mark
is found without sorting a source: sums by the leading digits of the hash tell the
cell that holds it, digits are added until no such cell has more than
``cell_rows`` documents, and only those documents are put in order.

Defined results: a null text has no words; a null source is a source of its own,
behind all others.  Rows with equal id and text stand next to each other; which of
them is taken does not matter.  A source without words has target 0.  If all caps
together are below the mix, every source is at its cap.  An empty table gives an
empty mix.  Texts of any length are counted whole.  The result does not depend on partitions or
on the number of tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import free_name, place, plain, stored

SHARE, EPOCHS, WEIGHTS = 1.5, 2, (3, 1, 2)
SEED = 12
DIGITS = 3  # of the hexadecimal hash: 4096 cells a step
CELL_ROWS = 50_000
SPACE = r"[\x20\x09-\x0D]+"

_EXACT = "decimal(22,4)"  # of words; weights are decimal(12,4), their sum decimal(15,4)


def n_words(text: Column) -> Column:
    """Words of a text (null: 0), runs without white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("bigint")


def ranked_sources(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, place): the distinct sources, numbered from 0 by code point, null
    last.  Ranges are sorted each on its own; the driver sees nothing."""
    null = F.col("source").isNull()
    distinct = docs.select(F.col(source_col).alias("source")).distinct()
    dealt = stored(distinct.repartitionByRange(null, "source").withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range, so one small task.
    starts = dealt.groupBy("part").agg(F.count("*").alias("held")).select(
        "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(null, "source")) - 1
    return dealt.withColumn("own", own).join(starts, "part").select("source", (F.col("start") + F.col("own")).alias("place"))


def cycled_weights(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, weight): the weights dealt to the numbered sources in turn."""
    cycle = F.array(*[F.lit(Decimal(str(w))) for w in weights])
    return sources.select("source", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, words, weight) with ``target``: double, the words that the mix takes."""
    cap = (F.col("words") * F.lit(Decimal(str(epochs)))).cast(_EXACT)
    weight = F.col("weight").cast("decimal(12,4)")
    rows = sources.withColumns({"cap": cap, "weight": weight})
    total = rows.agg(F.sum("words").alias("n")).first()["n"] or 0
    mix = Decimal(int(total)) * Decimal(str(share))
    level, above = None, None  # targets are weight * level; level is a fraction
    while True:
        if level is None:
            clamped = F.lit(False)
        elif level[1] == 0:
            clamped = F.col("weight") > 0
        else:
            clamped = F.col("cap") * F.lit(level[1]).cast("decimal(15,4)") < F.col("weight") * F.lit(level[0]).cast(_EXACT)
        got = rows.select("cap", "weight", clamped.alias("clamped")).agg(
            F.sum(F.when(F.col("clamped"), F.col("cap"))).alias("full"),
            F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("open"),
            F.count_if("clamped").alias("n")).first()
        if got["n"] == above:
            break
        above, level = got["n"], (mix - (got["full"] or 0), got["open"] or Decimal(0))
    free = (F.col("weight") * F.lit(level[0]).cast(_EXACT)).cast("double") / F.lit(level[1]).cast("double") if level[1] else F.lit(0.0)
    return rows.withColumn("target", F.when(clamped, F.col("cap").cast("double")).otherwise(free)).drop("cap")


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED, whole_documents: bool = False,
        cell_rows: int = CELL_ROWS, digits: int = DIGITS, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (of ``keep``, only these columns) with ``size`` (words),
    ``source_size`` (words of its source), ``target`` (double, of its source) and
    ``taken`` (bigint, words that the mix takes, repeats counted); a number stands
    behind a name that the table has.  ``weights``: (source, weight); a source that
    it lacks, or with a weight that is null or not positive, gets nothing; of several
    weights of a source the largest counts."""
    own, names = plain(docs)
    held = names if keep is None else keep
    at = [place(names, c) for c in held]
    id_at, text_at = F.col(place(names, id_col)).cast("string"), F.col(place(names, text_col))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_at, F.lit("-")), F.sha2(F.coalesce(text_at, F.lit("")), 256)), 256)
    source = F.col(place(names, source_col))
    rows = own.select(*at, F.isnull(source).alias("none"), F.coalesce(source, F.lit("")).alias("key"), n_words(text_at).alias("size"),
                      F.substring(digest, 1, 32).alias("draw"))
    rows = stored(rows, "sized")
    sizes = rows.groupBy("none", "key").agg(F.sum("size").alias("words"))
    weighed = (weights.groupBy(F.isnull("source").alias("none"), F.coalesce("source", F.lit("")).alias("key"))
               .agg(F.max("weight").alias("weight")))
    weight = F.greatest(F.coalesce(F.col("weight").cast("decimal(12,4)"), F.lit(0)), F.lit(0)).cast("decimal(12,4)")
    sources = stored(sizes.join(weighed, ["none", "key"], "left").withColumn("weight", weight), "weighed")
    # A cap may end within a word; whole words are taken.
    whole = F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("words") * F.lit(Decimal(str(epochs))))).cast("bigint")
    filled = water_fill(sources, share, epochs).withColumn("whole", whole)
    reps = F.when(F.col("words") > 0, F.call_function("div", F.col("whole"), F.col("words"))).otherwise(F.lit(0)).cast("bigint")
    plan = stored(filled.withColumn("reps", reps).select(
        "none", "key", F.col("words").alias("source_size"), "target", "reps",
        (F.col("whole") - F.col("reps") * F.col("words")).alias("rest")), "plan")
    cells = _mark_cells(rows, plan, digits, cell_rows)
    joined = rows.join(plan, ["none", "key"]).join(cells, ["none", "key"], "left")
    head = F.substring("draw", F.lit(1), F.length("mark"))
    once = F.col("reps") * F.col("size")
    outside = joined.where(F.col("mark").isNull() | (head != F.col("mark")))
    outside = outside.withColumn("taken", once + F.when(head < F.col("mark"), F.col("size")).otherwise(F.lit(0)))
    inside = joined.where(head == F.col("mark"))
    order = Window.partitionBy("none", "key").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.least(left, F.col("size")), F.lit(0))
    if whole_documents:
        part = F.when(2 * left > F.col("size"), F.col("size")).otherwise(F.lit(0))
    inside = inside.withColumn("taken", once + part)
    out = outside.unionByName(inside)
    fresh = [free_name(held, c) for c in ("size", "source_size", "target", "taken")]
    return out.select(*at, "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken")).toDF(*held, *fresh)


def _mark_cells(rows: DataFrame, plan: DataFrame, digits: int, cell_rows: int) -> DataFrame:
    """(none, key, mark, before): for every source with words left to take, the
    leading digits of the draws around its mark, and the words before that cell.
    A step has at most 16 ** ``digits`` cells a source."""
    keys = ["none", "key"]
    open_ = stored(plan.where("rest > 0").select(*keys, "rest", F.lit("").alias("mark"), F.lit(0).cast("bigint").alias("before")), "open")
    depth = 0
    while True:
        depth += digits
        inside = rows.join(open_, keys).where(F.substring("draw", F.lit(1), F.length("mark")) == F.col("mark"))
        sums = inside.groupBy(*keys, "rest", "before", F.substring("draw", 1, depth).alias("cell")).agg(
            F.sum("size").alias("words"), F.count("*").alias("held"))
        upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0))
        found = sums.withColumn("start", start).where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") >= F.col("rest")))
        open_ = stored(found.select(*keys, "rest", F.col("cell").alias("mark"), F.col("start").alias("before"), "held"), "marks")
        most = open_.agg(F.max("held").alias("n")).first()["n"] or 0
        open_ = open_.drop("held")
        if most <= cell_rows or depth >= 32:
            return open_.drop("rest")


def expand(mixed: DataFrame, text_col: str = "text", size_col: str = "size", taken_col: str = "taken") -> DataFrame:
    """The mix itself: a row for every repetition, numbered in ``repetition`` from
    1, the last with the first words of the text if it is taken in part."""
    names = mixed.columns
    own = mixed.toDF(*[f"c{i}" for i in range(len(names))])
    text, size, taken = (F.col(place(names, c)) for c in (text_col, size_col, taken_col))
    times = F.ceil(taken / size).cast("int")
    rows = own.where((size > 0) & (taken > 0)).withColumn("rep", F.explode(F.sequence(F.lit(1), times)))
    left = (taken - (F.col("rep") - 1) * size).cast("int")
    cut = F.array_join(F.slice(F.array_remove(F.split(text, SPACE), ""), F.lit(1), left), " ")
    return rows.withColumn("cut", F.when(left < size, cut).otherwise(text)).select(
        *[F.col("cut") if c == place(names, text_col) else F.col(c) for c in own.columns], "rep").toDF(*names, free_name(names, "repetition"))
