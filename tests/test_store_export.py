"""Store snapshots, idempotent batches, paging and export."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import schemas as S
from postlake.plans.common import unified
from postlake.session import scratch_path
from postlake.sources import export as EX
from postlake.sources.store import Store
from tests.conftest import SF_SMALL


def test_store_upsert_idempotent_and_atomic(spark):
    posts = unified(spark, SF_SMALL)
    st = Store(spark, scratch_path(spark, "t-store"), parts=4).create()
    assert st.read().count() == 0
    r = st.upsert(posts, 0)
    n = posts.count()
    assert r["inserted"] == r["incoming"] == n and st.read().count() == n
    assert st.upsert(posts, 0)["skipped"]                     # replayed batch id
    assert r["by_platform"] == {p.platform: {"incoming": p["count"], "inserted": p["count"], "updated": 0, "unchanged": 0}
                                for p in posts.groupBy("platform").count().collect()}
    at = st.pointer()
    with pytest.raises(Exception):
        st.upsert(posts.drop("text"), 1)                       # fails before publishing
    assert st.pointer() == at and st.read().count() == n
    edited = posts.where(F.col("platform") == "bluesky").limit(3) \
        .withColumn("text", F.lit("edited")).withColumn("seq", F.lit(10**9))
    r = st.upsert(edited.unionAll(edited), 2)
    assert (r["incoming"], r["inserted"], r["updated"], r["unchanged"]) == (6, 0, 3, 0)
    assert st.read().where(F.col("text") == "edited").count() == 3
    assert st.read().count() == n
    r = st.upsert(posts.where(F.col("platform") == "mastodon").limit(2), 3)
    assert (r["inserted"], r["updated"], r["unchanged"]) == (0, 0, 2) and st.read().count() == n
    assert st.upsert(posts.limit(0), 4)["incoming"] == 0 and st.read().count() == n


def test_platform_filter_prunes_partitions(spark):
    posts = unified(spark, SF_SMALL)
    st = Store(spark, scratch_path(spark, "t-store"), parts=2).create()
    st.upsert(posts, 0)
    st.upsert(posts.where(F.col("platform") == "bluesky").limit(3).withColumn("text", F.lit("x")), 1)
    plan = st.read().where(F.col("platform") == "reddit")._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet .*?PartitionFilters: \[([^\]]*)\]", plan)
    assert scans and all("(platform" in s for s in scans)


def test_page_none_vs_zero(spark):
    posts = unified(spark, SF_SMALL)
    st = Store(spark, scratch_path(spark, "t-store"), parts=2).create()
    st.upsert(posts, 0)
    assert st.page("mastodon", 0, 0).count() == 0          # 0 means 0 (D9)
    assert st.page("mastodon", None, None).count() == posts.where(F.col("platform") == "mastodon").count()


def test_export_errors_and_empty(spark):
    posts = unified(spark, SF_SMALL)
    with pytest.raises(ValueError):
        EX.export_posts(posts, "/nonexistent/out.xml")
    assert EX.export_posts(posts.where(F.lit(False)), scratch_path(spark, "e") + ".json") is None


@pytest.mark.parametrize("suffix", [".json", ".csv", ".parquet"])
def test_export_round_trip(spark, suffix):
    posts = unified(spark, SF_SMALL)
    path = scratch_path(spark, "e") + suffix
    EX.export_posts(posts, path)
    back = EX.from_export(EX.read_export(spark, path))
    expect = posts.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    cols = [c for c in S.POST_COLUMNS if c not in ("metrics",)]
    assert back.select(*cols).exceptAll(expect.select(*cols)).count() == 0
    assert back.count() == posts.count()


@pytest.mark.parametrize("suffix", [".json", ".csv", ".parquet"])
def test_exports_are_compressed(spark, suffix):
    """A record holds its text several times: written plain it is larger by far."""
    import glob
    import os
    from postlake.session import local_path
    posts = unified(spark, SF_SMALL)
    size = {}
    for compression in (None, "none"):
        path = scratch_path(spark, "e") + suffix
        EX.export_posts(posts, path, compression=compression)
        files = glob.glob(f"{local_path(path)}/part-*")
        size[compression] = sum(os.path.getsize(f) for f in files)
        assert all(f.endswith({".parquet": ".zstd.parquet"}.get(suffix, f"{suffix}.gz")) for f in files) == (compression is None)
        assert EX.read_export(spark, path).count() == posts.count()
    assert size[None] < 0.6 * size["none"]


def _model(batches):
    from tests.test_upsert import model
    state, _ = model(batches)
    return {k: (v[2], v[3]) for k, v in state.items()}


SMALL = T.StructType([T.StructField("platform", T.StringType()), T.StructField("object_id", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("seq", T.LongType()),
                      T.StructField("value", T.DoubleType())])


def _versions(spark, name, **options):
    return Store(spark, scratch_path(spark, name), SMALL, parts=3, replace=("text", "seq", "value"), replace_if_reddit=(), **options)


def _rows(st):
    return {(r.platform, r.object_id): (r.text, r.seq) for r in st.read().collect()}


@pytest.mark.parametrize("seed", range(2))
def test_store_equals_model(spark, seed):
    """Joined whole, and with the filter of the batch's keys."""
    import random
    from tests.test_upsert import SCHEMA, random_batches
    batches = [(b, rows) for b, rows in random_batches(random.Random(seed), n_batches=6, n_keys=12) if rows]
    stores = [_versions(spark, "t-model", small_rows=n) for n in (10**6, 0)]
    for i, (b, rows) in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).drop("batch")
        got = [st.upsert(df, b) for st in stores]
        before, after = _model(batches[:i]), _model(batches[:i + 1])
        want = {"incoming": len(rows), "inserted": len(after) - len(before),
                "updated": sum(before[k] != after[k] for k in before)}
        assert all({c: g[c] for c in want} == want for g in got)
        assert all(g["inserted"] + g["updated"] + g["unchanged"] == len({r[:2] for r in rows}) for g in got)
        assert all(_rows(st) == after for st in stores)


def test_a_failed_write_leaves_the_store_and_spoils_nothing(spark):
    """Faults before the write, after it, and after publishing, at many batches in a
    row: the store is the model's after each, whatever the other snapshot holds."""
    import random
    from tests.test_upsert import SCHEMA, random_batches
    from postlake.plans.q_stream import Fault
    batches = [(b, rows) for b, rows in random_batches(random.Random(5), n_batches=7, n_keys=9) if rows]
    fault = Fault({})
    st = _versions(spark, "t-fault", on_step=fault)
    for i, (b, rows) in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).drop("batch")
        step = ("write", "publish", "publish", "done")[i % 4]
        fault.left = {b: step}
        with pytest.raises(RuntimeError, match="fault"):
            st.upsert(df, b)
        assert _rows(st) == _model(batches[:i + (step == "done")])
        other = df.where(F.col("object_id") == "k0")
        if step == "publish" and i % 2 and other.count():  # another batch than the one that failed comes next
            st.upsert(other, b, "other")
            batches[i] = (b, [r for r in rows if r[1] == "k0"])
            assert _rows(st) == _model(batches[:i + 1])
            continue
        r = st.upsert(df, b)
        assert r["skipped"] == (step == "done") and r["incoming"] == len(rows)
        assert _rows(st) == _model(batches[:i + 1])


def test_a_batch_writes_only_its_partitions(spark):
    import glob
    import os
    from postlake.session import local_path
    posts = unified(spark, SF_SMALL)
    st = Store(spark, scratch_path(spark, "t-touch"), parts=16).create()
    st.upsert(posts, 0)
    files = lambda i: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{local_path(st.root)}/snapshot={i}/*/*/*.parquet")}
    some = posts.where("platform = 'mastodon'").orderBy("object_id").limit(2)
    st.upsert(some.withColumn("text", F.lit("t1")).withColumn("seq", F.lit(10**9 + 1)), 1)   # fills the second copy
    first = files(0)
    st.upsert(some.withColumn("text", F.lit("t2")).withColumn("seq", F.lit(10**9 + 2)), 2)
    folder = lambda fs: {os.path.dirname(f) for f in fs}
    changed = folder(set(first.items()) ^ set(files(0).items()) and {f for f, _ in set(first.items()) ^ set(files(0).items())})
    assert 1 <= len(changed) <= 2 and all("platform=mastodon" in d for d in changed)
    assert st.read().count() == posts.count() and st.read().where("text = 't2'").count() == 2
    assert not glob.glob(f"{local_path(st.root)}/_staged/*")
    assert set(os.listdir(local_path(st.root))) <= {"_current.json", "._current.json.crc", "_staged", "snapshot=0", "snapshot=1"}


def test_a_first_batch_is_written_once(spark, monkeypatch):
    """Partitions whose keys stand once are published as staged; of the others the
    first copies count, joined whole or with the filter of the keys that come again."""
    import glob
    import os
    import pyarrow.parquet as pq
    from postlake.operators import upsert as U
    from postlake.session import local_path
    from postlake.sources import store as store_module
    rows = [("a b/c", f"k{i}", f"t{i}", i, 0.0) for i in range(60)]
    rows += [("b", f"k{i % 55}", f"t{i}", 100 - i, 0.0) for i in range(60)] + [("b", None, "x", 7, 0.0), ("b", None, "y", 5, 0.0)]
    rows += [(None, "n", "x", 3, 0.0), (None, "n", "y", 2, 0.0), (None, "m", "z", None, 0.0)]
    batch = spark.createDataFrame(rows, SMALL).repartition(3)
    want = {(r.platform, r.object_id): (r.text, r.seq) for r in U.first_copies(batch).collect()}
    moved, move = [], store_module.move
    monkeypatch.setattr(store_module, "move", lambda spark, a, b: (moved.append(b), move(spark, a, b)))
    for small_rows in (10**6, 0):
        moved.clear()
        st = _versions(spark, "t-first", small_rows=small_rows)
        got = st.upsert(batch, 0)
        assert _rows(st) == want and st.read().count() == len(want) == st.pointer()["rows"]
        assert got["by_platform"] == {"a b/c": {"incoming": 60, "inserted": 60, "updated": 0, "unchanged": 0},
                                      "b": {"incoming": 62, "inserted": 56, "updated": 0, "unchanged": 0},
                                      "": {"incoming": 3, "inserted": 2, "updated": 0, "unchanged": 0}}
        assert len([x for x in moved if "platform=a b%2Fc" in x]) == 3
        files = glob.glob(f"{local_path(st.root)}/snapshot=0/*/*/*.parquet")
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
        assert not os.listdir(f"{local_path(st.root)}/_staged")
        assert st.upsert(batch.limit(0), 1)["incoming"] == 0
        again = st.upsert(spark.createDataFrame([("a b/c", "k1", "new", 999, 0.0), ("b", "z", "t", 1, 0.0)], SMALL), 2)
        assert (again["inserted"], again["updated"]) == (1, 1)
        assert _rows(st) == {**want, ("a b/c", "k1"): ("new", 999), ("b", "z"): ("t", 1)}


def test_pages_by_cursor(spark):
    posts = unified(spark, SF_SMALL)
    st = Store(spark, scratch_path(spark, "t-pages"), parts=2)
    st.upsert(posts.where("seq % 3 = 0").withColumn("seq", F.when(F.col("seq") % 2 == 0, F.col("seq"))), 0)  # some without a number
    st.upsert(posts.where("seq % 3 = 1"), 1)
    want = [(r.platform, r.object_id) for r in st.page("mastodon").collect()]
    got, cursor = [], None
    while True:
        page = st.page_after(cursor, 30, "mastodon")
        rows = page.collect()
        if not rows:
            break
        got += [(r.platform, r.object_id) for r in rows]
        cursor = st.cursor(page)
    assert got == want and st.cursor(st.page_after(cursor, 5, "mastodon")) is None
    plan = st.page_after({"batch_id": 1, "seq": 5, "platform": "mastodon", "object_id": "x"}, 30)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(batch_id,1)" in plan and "TakeOrderedAndProject(limit=30" in plan


def test_strict_insert(spark):
    posts = unified(spark, SF_SMALL).where(F.col("platform") == "bluesky")
    n = posts.count()
    st = Store(spark, scratch_path(spark, "t-strict"), parts=2).create()
    st.insert(posts, 0)
    at = st.pointer()
    new = posts.limit(3).withColumn("object_id", F.concat(F.lit("new"), "object_id"))
    for bad in (posts.limit(1), new.unionAll(posts.limit(1)), new.unionAll(new)):
        with pytest.raises(ValueError, match="duplicate"):
            st.insert(bad, 1)
    assert st.pointer() == at and st.read().count() == n
    st.insert(new, 1)
    assert st.insert(new, 1)["skipped"] and st.read().count() == n + 3


def test_store_options(spark):
    import random
    from tests.test_upsert import SCHEMA, model_opts, random_batches
    schema = T.StructType([T.StructField("platform", T.StringType()), T.StructField("object_id", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("seq", T.LongType()),
                           T.StructField("value", T.DoubleType())])
    batches = [(b, rows) for b, rows in random_batches(random.Random(7), n_batches=5, n_keys=5) if rows]
    want = model_opts(batches, "last", True)
    st = Store(spark, scratch_path(spark, "t-opt"), schema, parts=2, replace=("text", "seq", "value"),
               replace_if_reddit=(), within_batch="last", refresh=("value",))
    for b, rows in batches:
        st.upsert(spark.createDataFrame(rows, SCHEMA).drop("batch"), b)
    got = {(r.platform, r.object_id): (r.text, r.seq, r.value) for r in st.read().collect()}
    assert got == want


def test_other_source_starts_its_batch_ids_anew(spark):
    posts = unified(spark, SF_SMALL).where(F.col("platform") == "bluesky")
    st = Store(spark, scratch_path(spark, "t-src"), parts=2).create()
    st.upsert(posts, 0, "a")
    st.upsert(posts.limit(2).withColumn("text", F.lit("x")), 5, "a")
    assert st.upsert(posts, 0, "a")["skipped"]
    new = posts.limit(3).withColumn("object_id", F.concat(F.lit("new"), "object_id"))
    assert not st.upsert(new, 0, "b")["skipped"] and st.upsert(new, 0, "b")["skipped"]
    assert st.read().count() == posts.count() + 3
    assert not st.upsert(posts.limit(1).withColumn("text", F.lit("y")), 6, "a")["skipped"]
    assert st.read().where(F.col("text") == "y").count() == 1


def test_reopening_with_other_settings_is_an_error(spark):
    root = scratch_path(spark, "t-open")
    Store(spark, root, parts=4).create()
    with pytest.raises(ValueError, match="parts"):
        Store(spark, root, parts=8).upsert(unified(spark, SF_SMALL), 0)
