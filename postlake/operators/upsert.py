"""Keyed upsert with edit detection.

Rule (per batch; ``cur`` is the store before the batch, ``seq`` the arrival
order inside the batch):

1. key not in ``cur``: insert the copy with the lowest seq; later copies of
   that key in the same batch have no stored effect.
2. key in ``cur``: among copies whose text differs from the *stored* text,
   the one with the highest seq wins; none means unchanged.
3. the winner replaces the ``replace`` columns (text, raw_data, metrics; and
   title for Reddit posts); everything else keeps its first value.

Plan shape (no per-row loop, no collected groups):

* the batch is summarised per key without ever gathering a key's rows in one
  task: a partial aggregation per (key, text) collapses copies map-side, then
  a ``row_number() <= 2`` window -- planned as WindowGroupLimit, which keeps
  two rows per key in every map task before the shuffle -- yields the latest
  text and the latest *other* text.  Rule 2 only ever needs those two: if the
  latest copy differs from the stored text it wins, otherwise the latest copy
  with another text does.
* the one-row-per-key summary meets the store in a single full outer join on
  the key (one row per key on both sides, so no join skew).

Multi-batch replay (J6) uses the same per-(key, batch) summary and resolves
the batch-to-batch dependency with window functions: after every batch the
stored text is either that batch's latest text ``t`` or its latest other text
``m``; which one is a two-state automaton whose transitions compose, so it is
a running parity since the last reset -- a window scan per key over its
batches, not a fold over collected arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.operators import keys as K
from postlake.schemas import KEY
from postlake.session import free_names, staged

POST_REPLACE = ("text", "raw_data", "metrics")
POST_REPLACE_IF_REDDIT = ("title",)


# Types whose values an aggregation keeps in place.
_IN_PLACE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType,
             T.TimestampType, T.TimestampNTZType)


def _row(cols: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _arrival(order: str, compare: str) -> Column:
    """Arrival order of a row, never null: ``min_by``/``max_by`` ignore rows
    whose order is null, which would lose the row.  Rows without a sequence
    number come first, by a hash of the compared value."""
    return F.struct(F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**63))).alias("seq"),
                    F.xxhash64(F.col(compare)).alias("tie"))


def _per_text(batch: DataFrame, key: list[str], order: str, compare: str) -> DataFrame:
    """Per key and ``compare`` value: the rows of the lowest and the highest arrival,
    these arrivals, and the number of rows."""
    cols, arrival = batch.columns, _arrival(order, compare)
    ends = (("_first", F.min_by, F.min), ("_last", F.max_by, F.max))
    rest = [c for c in cols if c not in key and c != compare]
    if not all(isinstance(batch.schema[c].dataType, _IN_PLACE) for c in rest):
        return batch.groupBy(*key, compare).agg(
            *[x for name, by, end in ends for x in (by(_row(cols), arrival).alias(name), end(arrival).alias(f"{name}_seq"))],
            F.count(F.lit(1)).alias("_n"))
    # Columns of a fixed width are aggregated one by one, in hash tables, where a row as
    # a whole needs a sort.  Within a group the value compared, and so the tie, is the
    # same; all the columns see the same rows in the same order, and keep the same one.
    at = arrival["seq"]
    found = batch.groupBy(*key, compare).agg(
        *[by(F.col(c), at).alias(f"{name}_of_{i}") for name, by, _ in ends for i, c in enumerate(rest)],
        *[end(at).alias(f"{name}_at") for name, _, end in ends], F.count(F.lit(1)).alias("_n"))
    out = [F.col(k) for k in key]
    for name, _, _ in ends:
        values = {c: F.col(f"{name}_of_{i}") for i, c in enumerate(rest)}
        out.append(F.struct(*[values.get(c, F.col(c)).alias(c) for c in cols]).alias(name))
        out.append(F.struct(F.col(f"{name}_at").alias("seq"), F.xxhash64(F.col(compare)).alias("tie")).alias(f"{name}_seq"))
    return found.select(*out, "_n")


def batch_summary(batch: DataFrame, key: list[str], order: str = "seq",
                  compare: str = "text") -> DataFrame:
    """Per key of ``key`` (which may include a batch column): ``first`` (row
    with the lowest seq), ``last`` (highest seq), ``alt`` (highest seq among
    rows whose ``compare`` value differs from ``last``'s, or null) and ``n``
    (rows)."""
    per_text = _per_text(batch, key, order, compare)
    firsts = per_text.groupBy(*key).agg(
        F.min_by("_first", F.col("_first_seq")).alias("first"),
        F.sum("_n").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.col("_last_seq").desc())
    top2 = per_text.select(*key, "_last", "_last_seq", F.row_number().over(w).alias("_rn")) \
        .where(F.col("_rn") <= 2)
    lasts = top2.groupBy(*key).agg(
        F.max_by(F.when(F.col("_rn") == 1, F.col("_last")), F.col("_rn") == 1).alias("last"),
        F.max_by(F.when(F.col("_rn") == 2, F.col("_last")), F.col("_rn") == 2).alias("alt"))
    return firsts.join(lasts, key)


def _insert_side(within_batch: str) -> str:
    if within_batch not in ("first", "last"):
        raise ValueError("within_batch must be 'first' or 'last'")
    return within_batch


def _edit_winner(summary_alias: str, stored_compare: Column, compare: str) -> Column:
    last = F.col(f"{summary_alias}.last")
    alt = F.col(f"{summary_alias}.alt")
    return (F.when(last.isNull(), F.lit(None))
            .when(~last[compare].eqNullSafe(stored_compare), last)
            .when(alt.isNotNull(), alt))


def upsert(cur: DataFrame, batch: DataFrame, key: list[str] | None = None, order: str = "seq",
           compare: str = "text", replace=POST_REPLACE,
           replace_if_reddit=POST_REPLACE_IF_REDDIT, with_outcome: bool = False,
           within_batch: str = "first", refresh=(), blocks: int | None = None) -> DataFrame:
    """The store after applying ``batch`` to ``cur`` (same columns as
    ``cur``).  ``with_outcome`` adds ``_outcome`` in
    {inserted, updated, unchanged, untouched} and ``_copies`` (rows of the
    batch for the key).

    ``blocks``: for a store that is much larger than the batch.  A Bloom filter
    of that many blocks is built from the batch's keys; rows of ``cur`` that it
    rules out pass straight through, only the others are shuffled for the join.

    Options (ours; the defaults are the reference's observable rule):
    ``within_batch='last'`` inserts a new key's latest copy instead of its
    first (D7); ``refresh`` names columns taken from the latest copy of
    every key in the batch even without an edit, e.g. ``("metrics",)``
    (D8)."""
    key = list(key or KEY)
    cols = cur.columns
    missing = [c for c in cols if c not in batch.columns]
    if missing:
        raise ValueError(f"batch lacks store columns {missing}")
    if blocks:
        near, far = split_by_keys(cur, batch, key, blocks)
        far = far.withColumns({"_outcome": F.lit("untouched"), "_copies": F.lit(0).cast("long")}) if with_outcome else far
        return upsert(near, batch, key, order, compare, replace, replace_if_reddit, with_outcome, within_batch,
                      refresh).unionByName(far)
    s = batch_summary(batch.select(*cols), key, order, compare).alias("s")
    mark, = free_names(cols, ["in_cur"])
    c = cur.withColumn(mark, F.lit(True)).alias("c")
    j = c.join(s, key, "full_outer")
    # The winning version is worked out once per row, not once per column.
    won, found, copies, added, newest = free_names(cols, ["won", "found", "copies", "added", "newest"])
    j = j.select(*[F.col(k) for k in key], *[F.col(f"c.{c}").alias(c) for c in cols if c not in key],
                 F.col(f"c.{mark}").isNotNull().alias(found), F.col("s.n").alias(copies), F.col("s.last").alias(newest),
                 F.col(f"s.{_insert_side(within_batch)}").alias(added), _edit_winner("s", F.col(f"c.{compare}"), compare).alias(won))
    in_cur, win, latest = F.col(found), F.col(won), F.col(newest)
    out_cols = []
    for col in cols:
        if col in key:
            out_cols.append(F.col(col))
            continue
        if col in refresh:
            kept = F.when(F.col(copies).isNotNull(), latest[col]).otherwise(F.col(col))
        elif col in replace:
            kept = F.when(win.isNotNull(), win[col]).otherwise(F.col(col))
        elif col in replace_if_reddit:
            kept = F.when(win.isNotNull() & (F.col("platform") == "reddit"), win[col]).otherwise(F.col(col))
        else:
            kept = F.col(col)
        inserted = (latest if col in refresh else F.col(added))[col]
        out_cols.append(F.when(in_cur, kept).otherwise(inserted).alias(col))
    if with_outcome:
        out_cols.append(
            F.when(~in_cur, F.lit("inserted"))
             .when(F.col(copies).isNull(), F.lit("untouched"))
             .when(win.isNotNull(), F.lit("updated"))
             .otherwise(F.lit("unchanged")).alias("_outcome"))
        out_cols.append(F.coalesce(F.col(copies), F.lit(0)).cast("long").alias("_copies"))
    return j.select(*out_cols)


def split_by_keys(cur: DataFrame, batch: DataFrame, key: list[str] | None = None,
                  blocks: int = K.BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(rows of ``cur`` whose key may be in ``batch``, rows whose key is not)."""
    key = list(key or KEY)
    flag, = free_names(cur.columns, ["might"])
    marked = K.might_hold(cur, batch, key, flag, blocks)
    return marked.where(F.col(flag)).drop(flag), marked.where(~F.col(flag)).drop(flag)


def outcome_counts(cur: DataFrame, batch: DataFrame, key: list[str] | None = None,
                   order: str = "seq", compare: str = "text", blocks: int | None = None) -> DataFrame:
    """Incoming, inserted, updated, unchanged, duplicate counts of one
    batch (duplicate = copies beyond the first per key inside the batch).
    ``blocks`` as for ``upsert``."""
    key = list(key or KEY)
    s = batch_summary(batch.select(*key, order, compare), key, order, compare).alias("s")
    narrow = cur.select(*key, F.col(compare).alias("_stored"))
    c = (K.lookup(narrow, batch, key, blocks) if blocks else narrow).withColumn("_in_cur", F.lit(True))
    j = s.join(c, key, "left")
    win = _edit_winner("s", F.col("_stored"), compare)
    outcome = (F.when(F.col("_in_cur").isNull(), F.lit("inserted"))
               .when(win.isNotNull(), F.lit("updated")).otherwise(F.lit("unchanged")))
    agg = j.agg(
        F.sum("n").alias("incoming"),
        F.count_if(outcome == "inserted").alias("inserted"),
        F.count_if(outcome == "updated").alias("updated"),
        F.count_if(outcome == "unchanged").alias("unchanged"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate"))
    return agg.select(F.expr(
        "stack(5, 'incoming', incoming, 'inserted', inserted, 'updated', updated, "
        "'unchanged', unchanged, 'duplicate', duplicate) as (outcome, n)")) \
        .select("outcome", F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n"))


def strict_append_conflicts(cur: DataFrame, batch: DataFrame, key: list[str] | None = None,
                            blocks: int | None = None) -> DataFrame:
    """K2/Q4: batch rows that a strict insert would reject: the key exists in
    the store, or appears more than once in the batch.  Empty means the
    batch may be appended as is.  ``blocks`` as for ``upsert``."""
    key = list(key or KEY)
    known = K.lookup(cur.select(*key), batch, key, blocks) if blocks else cur.select(*key)
    exists = batch.join(known, key, "left_semi").withColumn("reason", F.lit("exists"))
    dup_keys = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*key)
    dups = batch.join(dup_keys, key, "left_semi").withColumn("reason", F.lit("duplicate_in_batch"))
    return exists.unionByName(dups)


def strict_append(cur: DataFrame, batch: DataFrame, key: list[str] | None = None) -> DataFrame:
    """K2: the store plus ``batch``; raises when any key conflicts (the store
    is untouched because nothing has been written yet)."""
    conflicts = strict_append_conflicts(cur, batch, key)
    if not conflicts.isEmpty():
        raise ValueError("strict append rejected: duplicate keys")
    return cur.unionByName(batch.select(*cur.columns))


# --------------------------------------------------------------------------
# Multi-batch replay (J6) and edit history
# --------------------------------------------------------------------------

# Column names the replay adds (Spark names are case insensitive).
_INTERNAL = {"_i", "_first", "_pt", "_pm", "_t", "_m", "_tl", "_g0", "_g1", "_const", "_c", "_not", "_cum_not", "_reset_c",
             "_reset_cum", "_bit", "_state", "prev_text", "changed", "version", "_is_last", "first",
             "last", "alt", "n", "_insert", "_applied_batch"}


def _replay_steps(versions: DataFrame, batch_col: str, key: list[str], order: str,
                  compare: str, within_batch: str = "first") -> DataFrame:
    """One row per (key, batch) with the state after that batch: ``_state``
    (the row whose ``compare`` value is stored), ``version`` (the row last
    applied), ``changed``, ``prev_text``, ``_first`` (the key's first batch)
    and ``_is_last`` (its last batch).

    Five window passes over the same sorted partitions (no re-sort, no
    extra shuffle): neighbours, running count of "not" transitions, last
    reset, previous state, last applied version."""
    # Columns of a version travel inside structs, so their names do not matter.
    clash = {c.lower() for c in [*key, batch_col]} & _INTERNAL
    if clash:
        raise ValueError(f"key and batch columns must not be named {sorted(clash)}")
    s = batch_summary(versions, key + [batch_col], order, compare)
    w = Window.partitionBy(*key).orderBy(batch_col)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ins = _insert_side(within_batch)
    # Pass 1: neighbours.  A row is the key's first batch when it has no
    # predecessor; the previous row's candidates (_T if its bit is 0, _M if
    # 1) follow from whether *it* was the first.  (Spark names are case
    # insensitive: internal names stay distinct ignoring case.)
    prev1, prev2 = F.lag(batch_col, 1).over(w), F.lag(batch_col, 2).over(w)
    prev_is_first = prev1.isNotNull() & prev2.isNull()
    s = s.select(
        "*",
        prev1.isNull().alias("_first"),
        F.when(prev_is_first, F.lag(F.col(ins)[compare]).over(w))
         .otherwise(F.lag(F.col("last")[compare]).over(w)).alias("_pT"),
        F.when(prev_is_first, F.lit(None))
         .otherwise(F.lag(F.col("alt")[compare]).over(w)).alias("_pM"),
        F.lead(batch_col).over(w).isNull().alias("_is_last"))
    first_b = F.col("_first")
    s = s.withColumn("_M", F.when(first_b, F.lit(None)).otherwise(F.col("alt")[compare])) \
         .withColumn("_tl", F.col("last")[compare])
    has_m = F.col("_M").isNotNull()
    g0 = F.coalesce(has_m & F.col("_pT").eqNullSafe(F.col("_tl")), F.lit(False))
    g1 = F.coalesce(has_m & F.col("_pM").isNotNull() & F.col("_pM").eqNullSafe(F.col("_tl")), F.lit(False))
    s = s.withColumn("_g0", g0).withColumn("_g1", g1)
    s = s.withColumn("_const", first_b | (F.col("_g0") == F.col("_g1"))) \
         .withColumn("_c", F.when(first_b, F.lit(False)).otherwise(F.col("_g0"))) \
         .withColumn("_not", (~F.col("_const") & F.col("_g0")).cast("int"))
    # Pass 2: running count of "not" transitions.
    s = s.withColumn("_cum_not", F.sum("_not").over(wr))
    # Pass 3: value and count at the last reset (a constant transition).
    s = s.select("*",
                 F.last(F.when(F.col("_const"), F.col("_c")), ignorenulls=True).over(wr).alias("_reset_c"),
                 F.last(F.when(F.col("_const"), F.col("_cum_not")), ignorenulls=True).over(wr)
                 .alias("_reset_cum"))
    b = F.col("_reset_c") != (((F.col("_cum_not") - F.col("_reset_cum")) % 2) == 1)
    s = s.withColumn("_bit", b)
    state_row = F.when(F.col("_bit"), F.col("alt")).when(first_b, F.col(ins)).otherwise(F.col("last"))
    s = s.withColumn("_state", state_row)
    # Pass 4: previous state's text.
    prev_text = F.lag(F.col("_state")[compare]).over(w)
    s = s.withColumn("prev_text", prev_text)
    s = s.withColumn("changed", first_b | F.col("_bit") | ~F.col("prev_text").eqNullSafe(F.col("_tl")))
    # Pass 5: the version last applied.
    s = s.withColumn("version", F.last(F.when(F.col("changed"), F.col("_state")), ignorenulls=True).over(wr))
    return s


def replay(versions: DataFrame, batch_col: str, key: list[str] | None = None, order: str = "seq",
           compare: str = "text") -> DataFrame:
    """The final stored row per key after applying every batch in
    ``batch_col`` order to an empty store.  Returns the columns of
    ``versions`` (the stored ``compare`` value, other columns of the version
    last applied)."""
    key = list(key or KEY)
    cols = versions.columns
    s = _replay_steps(versions, batch_col, key, order, compare).where(F.col("_is_last"))
    return s.select(*[F.col(k) for k in key],
                    *[F.col("version")[c].alias(c) for c in cols if c not in key])


def edit_history(versions: DataFrame, batch_col: str, key: list[str] | None = None,
                 order: str = "seq", compare: str = "text") -> DataFrame:
    """The change log the reference destroys by updating in place: one
    row per key and batch in which the stored row changed (insert or edit),
    with the previous text."""
    key = list(key or KEY)
    s = _replay_steps(versions, batch_col, key, order, compare).where(F.col("changed"))
    return s.select(*[F.col(k) for k in key], F.col(batch_col),
                    F.col("_state")[compare].alias(compare), F.col("prev_text"),
                    F.col("_state")[order].alias(order),
                    F.when(F.col("_first"), F.lit("insert")).otherwise(F.lit("edit")).alias("change"))


def first_copies(batch: DataFrame, key: list[str] | None = None, order: str = "seq",
                 copies: str | None = None) -> DataFrame:
    """In-batch de-duplication, first arrival wins (``min_by`` per key,
    a partial aggregation -- unlike ``dropDuplicates`` it is deterministic).
    ``copies`` names a column for the number of rows of the key."""
    key = list(key or KEY)
    cols = batch.columns
    compare = "text" if "text" in cols else cols[0]
    agg = batch.groupBy(*key).agg(F.min_by(_row(cols), _arrival(order, compare)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return agg.select(*[F.col("_r")[c].alias(c) for c in cols], *([F.col("_n").alias(copies)] if copies else []))


def fingerprints(posts: DataFrame, with_url: bool = False) -> DataFrame:
    """Text fingerprint (normalized text), or text plus URL."""
    from postlake.functions.scalars import norm_text
    parts = [norm_text("text")]
    if with_url:
        parts.append(F.lower(F.coalesce(F.col("url"), F.lit(""))))
    return posts.withColumn("fingerprint", F.sha2(F.concat_ws("\u001f", *parts), 256))


def canonical_by_fingerprint(posts: DataFrame) -> DataFrame:
    """One canonical post per fingerprint -- earliest created_at, then
    (platform, object_id) -- and the number of copies.

    Two steps over a narrow table that is written once (the texts are hashed
    once): the earliest instant and the count of each fingerprint are numbers, so
    the partial aggregation hashes in place and a fingerprint that a third of all
    rows share collapses map-side; then the smallest key among the rows of that
    instant, where a window keeps one row per fingerprint in every map task."""
    narrow = staged(posts.select("fingerprint", F.unix_micros("created_at").alias("us"), "platform", "object_id"), "fingerprints")
    earliest = narrow.groupBy("fingerprint").agg(F.min("us").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    tied = narrow.join(earliest, "fingerprint").where(F.col("us").eqNullSafe(F.col("least"))).select(
        "fingerprint", "platform", "object_id", "n_copies")
    w = Window.partitionBy("fingerprint").orderBy("platform", "object_id")
    return tied.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def resolve(versions: DataFrame, batch_col: str, key: list[str] | None = None, order: str = "seq",
            compare: str = "text", replace=POST_REPLACE, replace_if_reddit=POST_REPLACE_IF_REDDIT,
            within_batch: str = "first", refresh=()) -> DataFrame:
    """The stored rows after applying every batch of ``versions`` in
    ``batch_col`` order to an empty store, with rule 3: columns in
    ``replace`` come from the version last applied, the rest from the row
    that inserted the key (``replace_if_reddit`` only for Reddit posts).

    A stored row can enter as the only row of an earlier batch; it is then
    the inserting row and its columns are kept as stored (merge-on-read)."""
    key = list(key or KEY)
    steps = _replay_steps(versions, batch_col, key, order, compare, within_batch)
    return resolve_steps(steps, [c for c in versions.columns if c != batch_col], batch_col, key,
                         replace, replace_if_reddit, within_batch, refresh)


def resolve_steps(steps: DataFrame, cols: list[str], batch_col: str, key: list[str],
                  replace=POST_REPLACE, replace_if_reddit=POST_REPLACE_IF_REDDIT,
                  within_batch: str = "first", refresh=()) -> DataFrame:
    """Final rows from replay steps (see ``resolve``; ``refresh`` columns
    come from the key's latest copy)."""
    w = Window.partitionBy(*key).orderBy(batch_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ins = _insert_side(within_batch)
    s = steps.withColumn("_insert", F.first(F.col(ins)).over(w)).where(F.col("_is_last"))
    out = []
    for c in cols:
        if c in key:
            out.append(F.col(c))
        elif c in refresh:
            out.append(F.col("last")[c].alias(c))
        elif c in replace:
            out.append(F.col("version")[c].alias(c))
        elif c in replace_if_reddit:
            out.append(F.when(F.col("platform") == "reddit", F.col("version")[c])
                       .otherwise(F.col("_insert")[c]).alias(c))
        else:
            out.append(F.col("_insert")[c].alias(c))
    return s.select(*out)


def replay_steps(versions: DataFrame, batch_col: str, key: list[str] | None = None,
                 order: str = "seq", compare: str = "text", within_batch: str = "first") -> DataFrame:
    """Public form of the per-(key, batch) replay steps (for callers that
    derive several results -- rows, outcomes -- from one replay)."""
    return _replay_steps(versions, batch_col, list(key or KEY), order, compare, within_batch)


def batch_outcomes(steps: DataFrame, batch_col: str, skip_batch=None, by=()) -> DataFrame:
    """J8 for many batches at once, from the replay steps: per batch, rows
    (incoming), keys inserted, keys updated and keys present but unchanged.
    ``skip_batch`` leaves out a pseudo-batch (the stored base); ``by`` names
    key columns to count by besides the batch."""
    s = steps if skip_batch is None else steps.where(F.col(batch_col) != F.lit(skip_batch))
    first = F.col("_first")
    return s.groupBy(batch_col, *by).agg(
        F.sum("n").cast("long").alias("incoming"),
        F.count_if(first).cast("long").alias("inserted"),
        F.count_if(~first & F.col("changed")).cast("long").alias("updated"),
        F.count_if(~first & ~F.col("changed")).cast("long").alias("unchanged"))
