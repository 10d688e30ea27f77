"""The upsert rule against a plain sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import upsert as U

COLS = ["platform", "object_id", "text", "seq", "value", "batch"]
SCHEMA = "platform string, object_id string, text string, seq bigint, value double, batch int"


def model(batches):
    """Sequential rule: returns final {key: (text, seq)} and edit log."""
    state, log = {}, []
    for b, rows in batches:
        rows = sorted(rows, key=lambda r: r[3])
        new = {}
        edits = {}
        for r in rows:
            k = (r[0], r[1])
            if k not in state:
                new.setdefault(k, r)  # first copy wins
            elif r[2] != state[k][2]:
                edits[k] = r          # last differing copy wins
        for k, r in new.items():
            state[k] = r
            log.append((k, b, r[2], None, r[3]))
        for k, r in edits.items():
            log.append((k, b, r[2], state[k][2], r[3]))
            state[k] = r
    return state, log


def random_batches(rng, n_batches=6, n_keys=5, texts="abc", per_batch=12):
    batches, seq = [], 0
    for b in range(n_batches):
        rows = []
        for _ in range(rng.randint(0, per_batch)):
            seq += rng.randint(1, 3)
            k = rng.randrange(n_keys)
            rows.append(("p", f"k{k}", rng.choice(texts), seq, float(seq), b))
        batches.append((b, rows))
    return batches


@pytest.mark.parametrize("seed", range(6))
def test_replay_and_history_match_model(spark, seed):
    rng = random.Random(seed)
    batches = random_batches(rng)
    rows = [r for _, rs in batches for r in rs]
    if not rows:
        return
    df = spark.createDataFrame(rows, SCHEMA)
    final, log = model(batches)
    got = {(r.platform, r.object_id): (r.text, r.seq) for r in U.replay(df, "batch").collect()}
    assert got == {k: (v[2], v[3]) for k, v in final.items()}
    hist = {((r.platform, r.object_id), r.batch, r.text, r.prev_text, r.seq)
            for r in U.edit_history(df, "batch").collect()}
    assert hist == set(log)


@pytest.mark.parametrize("seed", range(4))
def test_single_batch_upsert_matches_model(spark, seed):
    rng = random.Random(100 + seed)
    batches = random_batches(rng, n_batches=2, per_batch=20)
    first = [r for r in batches[0][1]]
    second = [r for r in batches[1][1]]
    if not first or not second:
        return
    state, _ = model([batches[0]])
    cur = spark.createDataFrame([v for v in state.values()], SCHEMA).drop("batch")
    batch = spark.createDataFrame(second, SCHEMA).drop("batch")
    out = U.upsert(cur, batch, replace=("text", "seq", "value"), replace_if_reddit=(), with_outcome=True)
    final, _ = model(batches)
    got = {(r.platform, r.object_id): (r.text, r.seq) for r in out.collect()}
    assert got == {k: (v[2], v[3]) for k, v in final.items()}
    counts = {r.outcome: r.n for r in U.outcome_counts(cur, batch).collect()}
    assert counts["incoming"] == len(second)
    assert counts["duplicate"] == len(second) - len({(r[0], r[1]) for r in second})


def test_stored_ab_batch_ba_gives_b(spark):
    """Rule 2 compares with the stored text: stored A, batch [B, A] -> B."""
    cur = spark.createDataFrame([("p", "k", "A", 1, 1.0)], "platform string, object_id string, text string, seq bigint, value double")
    batch = spark.createDataFrame([("p", "k", "B", 2, 2.0), ("p", "k", "A", 3, 3.0)], cur.schema)
    r = U.upsert(cur, batch, replace=("text", "seq", "value"), replace_if_reddit=()).collect()[0]
    assert (r.text, r.seq) == ("B", 2)


def test_title_replaced_only_for_reddit_and_url_kept(spark):
    schema = "platform string, object_id string, text string, seq bigint, title string, url string, raw_data string, metrics map<string,bigint>"
    cur = spark.createDataFrame([("reddit", "r", "A", 1, "t1", "u1", None, {"x": 1}),
                                 ("mastodon", "m", "A", 1, None, "u1", None, {"x": 1})], schema)
    batch = spark.createDataFrame([("reddit", "r", "B", 2, "t2", "u2", "{}", {"x": 2}),
                                   ("mastodon", "m", "B", 2, "t2", "u2", "{}", {"x": 2})], schema)
    out = {r.platform: r for r in U.upsert(cur, batch).collect()}
    assert out["reddit"].title == "t2" and out["reddit"].url == "u1" and out["reddit"].metrics == {"x": 2}
    assert out["mastodon"].title is None and out["mastodon"].text == "B"


def test_strict_append_rejects(spark):
    cur = spark.createDataFrame([("p", "k", "A", 1)], "platform string, object_id string, text string, seq bigint")
    batch = spark.createDataFrame([("p", "k", "B", 2), ("p", "n", "C", 3), ("p", "n", "D", 4)], cur.schema)
    reasons = sorted((r.object_id, r.reason) for r in U.strict_append_conflicts(cur, batch).collect())
    assert reasons == [("k", "exists"), ("n", "duplicate_in_batch"), ("n", "duplicate_in_batch")]
    with pytest.raises(ValueError):
        U.strict_append(cur, batch)
    ok = spark.createDataFrame([("p", "z", "Z", 5)], cur.schema)
    assert U.strict_append(cur, ok).count() == 2


def test_summary_plan_limits_rows_per_key_before_shuffle(spark):
    # One hot key derived from the data (literals would be folded away).
    df = spark.range(1000).select(F.lit("p").alias("platform"), F.when(F.col("id") < 10**9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("object_id"),
                                  (F.col("id") % 97).cast("string").alias("text"), F.col("id").alias("seq"))
    plan = U.batch_summary(df, ["platform", "object_id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "collect_list" not in plan


def model_opts(batches, within_batch="first", refresh=False):
    """Sequential rule with the D7/D8 options (``refresh`` refreshes the
    value column from the latest copy of every key in a batch)."""
    state = {}
    for _, rows in batches:
        rows = sorted(rows, key=lambda r: r[3])
        new, edits, latest = {}, {}, {}
        for r in rows:
            k = (r[0], r[1])
            latest[k] = r
            if k not in state:
                if within_batch == "first":
                    new.setdefault(k, r)
                else:
                    new[k] = r
            elif r[2] != state[k][2]:
                edits[k] = r
        state.update(new)
        state.update(edits)
        if refresh:
            for k, r in latest.items():
                s = state[k]
                state[k] = (s[0], s[1], s[2], s[3], r[4], s[5])
    return {k: (v[2], v[3], v[4]) for k, v in state.items()}


@pytest.mark.parametrize("within_batch,refresh", [("last", False), ("first", True), ("last", True)])
@pytest.mark.parametrize("seed", range(3))
def test_options_match_model(spark, seed, within_batch, refresh):
    rng = random.Random(1000 + seed)
    batches = [(b, rs) for b, rs in random_batches(rng, n_batches=5, n_keys=5) if rs]
    rows = [r for _, rs in batches for r in rs]
    want = model_opts(batches, within_batch, refresh)
    ref = ("value",) if refresh else ()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.platform, r.object_id): (r.text, r.seq, r.value) for r in
           U.resolve(df, "batch", replace=("text", "seq", "value"), replace_if_reddit=(),
                     within_batch=within_batch, refresh=ref).collect()}
    assert got == want
    # single-batch form, batch by batch
    cur = None
    for b, rs in batches:
        bdf = spark.createDataFrame(rs, SCHEMA).drop("batch")
        if cur is None:
            cur = spark.createDataFrame([], bdf.schema)
        # Materialize each small step on the driver (test-sized data) so the
        # plan does not nest one upsert per batch.
        step = U.upsert(cur, bdf, replace=("text", "seq", "value"), replace_if_reddit=(),
                        within_batch=within_batch, refresh=ref)
        cur = spark.createDataFrame(step.collect(), bdf.schema)
    assert {(r.platform, r.object_id): (r.text, r.seq, r.value) for r in cur.collect()} == want


def test_key_filter_stands_below_the_exchange_of_the_store(spark):
    """The batch's keys reach the scan of the store; rows that they rule out
    are not shuffled.  Joins on keys are exact, whatever the filter lets through."""
    from postlake.operators import keys as K
    from postlake.session import staged
    rows = spark.range(5000).select(F.lit("p").alias("platform"), F.col("id").cast("string").alias("object_id"),
                                    F.concat(F.lit("t"), F.col("id")).alias("text"), F.col("id").alias("seq"))
    base = staged(rows, "t-base")
    batch = staged(rows.where("id % 100 = 7").withColumn("text", F.lit("new")).unionAll(rows.limit(1).withColumn("object_id", F.lit("x"))), "t-batch")
    key = ["platform", "object_id"]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = K.lookup(base, batch, key)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        at = lambda text, start=0: next(i for i in range(start, len(plan)) if text in plan[i])
        exchange = at("Exchange hashpartitioning(platform")
        assert exchange < at("BroadcastHashJoin", exchange) < at("FileScan", exchange)
        assert found.count() == 50
        for blocks in (K.BLOCKS, 1):                               # one block lets more through
            near, far = U.split_by_keys(base, batch, key, blocks)
            assert near.count() + far.count() == 5000 and near.join(batch, key, "left_semi").count() == 50
            assert far.count() > 4900 and (far.count() == 4950) == (blocks > 1)
            whole, split = (U.upsert(base, batch, replace=("text", "seq"), replace_if_reddit=(), with_outcome=True, blocks=b) for b in (None, blocks))
            assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [K.blocks_for(n) for n in (0, 10**5, 10**6, 10**12)] == [256, 4096, 32768, K.MOST_BLOCKS]


def test_columns_named_like_internal_ones(spark):
    """Columns named n, first, last, version and the like travel through replay and
    upsert unchanged."""
    names = ["n", "first", "last", "version", "alt", "in_cur", "won", "found", "copies", "added", "might", "block", "w0"]
    schema = "platform string, object_id string, text string, seq bigint, batch int, " + ", ".join(f"`{c}` string" for c in names)
    rows = [("p", k, t, s, b, *[f"{c}{s}" for c in names]) for k, t, s, b in (("a", "x", 1, 0), ("a", "y", 2, 1), ("b", "x", 3, 1), ("b", "x", 4, 2))]
    df = spark.createDataFrame(rows, schema)
    got = {r.object_id: r for r in U.replay(df, "batch").collect()}
    assert {k: r.seq for k, r in got.items()} == {"a": 2, "b": 3} and got["a"].asDict()["version"] == "version2"
    done = U.upsert(df.where("batch = 0").drop("batch"), df.where("batch > 0").drop("batch"), replace=("text", "seq"),
                    replace_if_reddit=(), blocks=256)
    got = {r.object_id: r for r in done.collect()}
    assert (got["a"].text, got["a"].n, got["b"].found) == ("y", "n1", "found3")


def test_fixed_width_columns_are_summarised_without_a_sort(spark):
    """Narrow rows are aggregated column by column in hash tables, and the columns of a
    summary come from one row, also among rows of the same arrival."""
    from postlake.operators import upsert as U
    cols = "platform string, object_id string, text string, seq bigint, value double, flag boolean, n int"
    rows = [("p", f"k{i % 7}", f"t{i % 3}", None if i % 5 == 0 else i % 4, float(i), i % 2 == 0, i if i % 6 else None) for i in range(200)]
    rows += [("p", "z", None, 3, 0.5, True, 1), ("p", "z", "a", 3, 0.25, None, 2)]
    batch = spark.createDataFrame(rows, cols).repartition(5)
    per_text = U._per_text(batch, ["platform", "object_id"], "seq", "text")
    plan = per_text._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    got = U.batch_summary(batch, ["platform", "object_id"]).collect()
    lowest = lambda s: -(2**63) if s is None else s
    by_key = {}
    for r in rows:
        by_key.setdefault(r[:2], []).append(r)
    assert {(r.platform, r.object_id): r.n for r in got} == {k: len(v) for k, v in by_key.items()}
    for r in got:
        mine = by_key[r.platform, r.object_id]
        assert {tuple(r["first"]), tuple(r["last"]), tuple(r["alt"])} <= set(mine)
        assert lowest(r["first"].seq) == min(lowest(x[3]) for x in mine) and lowest(r["last"].seq) == max(lowest(x[3]) for x in mine)
        assert r["alt"].text != r["last"].text
        assert lowest(r["alt"].seq) == max(lowest(x[3]) for x in mine if x[2] != r["last"].text)
