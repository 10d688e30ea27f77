"""Queries over the keyed upsert."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.operators import keys as K
from postlake.operators import upsert as U
from postlake.plans import oracle as O
from postlake.plans.common import unified
from postlake.plans.registry import register
from postlake.session import configure, scratch_path
from postlake.sources import fixtures as FX
from postlake.sources.store import Store

VCOLS = ["platform", "object_id", "text", "seq", "value"]
REPLACE = ("text", "seq", "value")


def day_batches(spark, sf_dir):
    """(cur, batch): the store after the first half of the days, and the
    versions of all later days.  The middle day is one value, computed once."""
    configure(spark)
    v = FX.post_versions(spark, sf_dir)
    span = F.datediff(F.max("batch_day"), F.min("batch_day"))
    mid = F.lit(v.agg(F.date_add(F.min("batch_day"), F.floor(span / 2).cast("int"))).first()[0])
    cur = U.first_copies(v.where(F.col("batch_day") <= mid).select(*VCOLS))
    batch = v.where(F.col("batch_day") > mid).select(*VCOLS)
    return cur, batch


_DAYS = f"""with post_versions as ({O.FIX["post_versions"]}),
d1 as (select cast(min(batch_day) as date) + cast(floor(date_diff('day', cast(min(batch_day) as date), cast(max(batch_day) as date)) / 2) as integer) as d from post_versions),
cur as (select platform, object_id, text, seq, value from (
          select *, row_number() over (partition by platform, object_id order by seq) as rn
          from post_versions where cast(batch_day as date) <= (select d from d1)) where rn = 1),
batch as (select platform, object_id, text, seq, value from post_versions where cast(batch_day as date) > (select d from d1)),
e as (select b.*, row_number() over (partition by b.platform, b.object_id order by b.seq desc) as rn
      from batch b join cur c on c.platform = b.platform and c.object_id = b.object_id
      where b.text <> c.text),
n as (select b.*, row_number() over (partition by b.platform, b.object_id order by b.seq) as rn
      from batch b where not exists (select 1 from cur c
        where c.platform = b.platform and c.object_id = b.object_id))"""

_UPSERT_SQL = _DAYS + """
select c.platform, c.object_id,
       case when e.rn is null then c.text else e.text end as text,
       case when e.rn is null then c.seq else e.seq end as seq,
       case when e.rn is null then c.value else e.value end as value
from cur c left join e on e.platform = c.platform and e.object_id = c.object_id and e.rn = 1
union all
select platform, object_id, text, seq, value from n where rn = 1"""


@register("upsert_batch", _UPSERT_SQL)
def upsert_batch(spark, sf_dir):
    cur, batch = day_batches(spark, sf_dir)
    return U.upsert(cur, batch, replace=REPLACE, replace_if_reddit=(), blocks=K.BLOCKS)


_OUTCOME_SQL = _DAYS + """,
k as (select platform, object_id, count(*) as n from batch group by all),
cls as (select k.*, case when c.object_id is null then 'inserted'
                         when exists (select 1 from e where e.platform = k.platform and e.object_id = k.object_id)
                           then 'updated' else 'unchanged' end as outcome
        from k left join cur c on c.platform = k.platform and c.object_id = k.object_id)
select 'incoming' as outcome, cast(sum(n) as bigint) as n from cls
union all select 'inserted', cast(count(*) filter (where outcome = 'inserted') as bigint) from cls
union all select 'updated', cast(count(*) filter (where outcome = 'updated') as bigint) from cls
union all select 'unchanged', cast(count(*) filter (where outcome = 'unchanged') as bigint) from cls
union all select 'duplicate', cast(sum(n) - count(*) as bigint) from cls"""


@register("upsert_outcomes", _OUTCOME_SQL)
def upsert_outcomes(spark, sf_dir):
    cur, batch = day_batches(spark, sf_dir)
    return U.outcome_counts(cur, batch, blocks=K.BLOCKS)


_CONFLICT_SQL = _DAYS + """
select b.platform, b.object_id, b.seq, 'exists' as reason from batch b
where exists (select 1 from cur c where c.platform = b.platform and c.object_id = b.object_id)
union all
select b.platform, b.object_id, b.seq, 'duplicate_in_batch' as reason from batch b
where (select count(*) from batch x where x.platform = b.platform and x.object_id = b.object_id) > 1"""


@register("strict_append_conflicts", _CONFLICT_SQL)
def strict_append_conflicts(spark, sf_dir):
    cur, batch = day_batches(spark, sf_dir)
    return U.strict_append_conflicts(cur, batch, blocks=K.BLOCKS).select("platform", "object_id", "seq", "reason")


_INSERT_SQL = _DAYS + """
select * from cur
union all
select platform, object_id, text, seq, value from (
  select b.*, count(*) over (partition by platform, object_id) as copies from batch b) x
where copies = 1 and not exists (select 1 from cur c where c.platform = x.platform and c.object_id = x.object_id)"""


@register("strict_insert", _INSERT_SQL)
def strict_insert(spark, sf_dir):
    """K2: the whole batch is refused, because of its conflicts, and leaves the store
    as it was; the rows without a conflict are then inserted."""
    cur, batch = day_batches(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store-strict"), T.StructType([cur.schema[c] for c in VCOLS]),
                  replace=REPLACE, replace_if_reddit=(), parts=4)
    store.insert(cur, 0)
    try:
        store.insert(batch, 1)
    except ValueError:
        bad = U.strict_append_conflicts(store.read(), batch, blocks=K.BLOCKS).select("platform", "object_id").distinct()
        store.insert(batch.join(bad, ["platform", "object_id"], "left_anti"), 1)
    return store.read().select(*VCOLS)


# A.2: many batches, recursive, with the state after every batch.
_STATES = f"""with recursive post_versions as ({O.FIX["post_versions"]}),
dd as (select d, row_number() over (order by d) as i from (select distinct batch_day as d from post_versions)),
v as (select p.*, dd.i from post_versions p join dd on dd.d = p.batch_day),
st as (select 0 as i, platform, object_id, cast(null as varchar) as text, cast(null as bigint) as seq,
              cast(null as double) as value, false as changed
       from (select distinct platform, object_id from post_versions)
  union all
  select st.i + 1, st.platform, st.object_id, coalesce(n.text, st.text), coalesce(n.seq, st.seq),
         case when n.seq is null then st.value else n.value end, n.seq is not null
  from st left join lateral (
    select case when st.text is null then arg_min(v.text, v.seq) else arg_max(v.text, v.seq) end as text,
           case when st.text is null then min(v.seq) else max(v.seq) end as seq,
           case when st.text is null then arg_min(v.value, v.seq) else arg_max(v.value, v.seq) end as value
    from v where v.i = st.i + 1 and v.platform = st.platform and v.object_id = st.object_id
      and (st.text is null or v.text <> st.text)) n on true
  where st.i < (select max(i) from dd))"""

_REPLAY_SQL = _STATES + """
select platform, object_id, text, seq, value from st where i = (select max(i) from dd) and text is not null"""


@register("replay_batches", _REPLAY_SQL)
def replay_batches(spark, sf_dir):
    configure(spark)
    v = FX.post_versions(spark, sf_dir)
    r = U.replay(v.select(*VCOLS, "batch_day"), "batch_day")
    return r.select(*VCOLS)


_HISTORY_SQL = _STATES + """,
h as (select st.*, lag(st.text) over (partition by platform, object_id order by st.i) as prev_text from st)
select h.platform, h.object_id, cast(dd.d as varchar) as batch_day, h.text, h.prev_text, h.seq,
       case when h.prev_text is null then 'insert' else 'edit' end as change
from h join dd on dd.i = h.i where h.changed"""


@register("edit_history", _HISTORY_SQL)
def edit_history(spark, sf_dir):
    configure(spark)
    v = FX.post_versions(spark, sf_dir).select(*VCOLS, "batch_day")
    h = U.edit_history(v, "batch_day")
    return h.select("platform", "object_id", F.col("batch_day").cast("string").alias("batch_day"),
                    "text", "prev_text", "seq", "change")


_RT_SQL = f"""with post_versions as ({O.FIX["post_versions"]}),
firsts as (select platform, object_id, min(batch_day) as d from post_versions group by all),
days as (select distinct platform, batch_day as d from post_versions),
c as (select days.platform, days.d, count(firsts.object_id) as inserted
      from days left join firsts on firsts.platform = days.platform and firsts.d = days.d group by all)
select platform, cast(d as varchar) as batch_day, cast(inserted as bigint) as inserted,
       cast(sum(inserted) over (partition by platform order by d) as bigint) as total
from c"""


@register("running_totals", _RT_SQL)
def running_totals(spark, sf_dir):
    """A4: posts inserted per batch and the running store size per platform."""
    from postlake.operators import stats as ST
    configure(spark)
    v = FX.post_versions(spark, sf_dir)
    r = ST.running_totals(v, "batch_day")
    return r.select("platform", F.col("batch_day").cast("string").alias("batch_day"), "inserted", "total")


_NORM_SQL = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def _fp_sql(value: str) -> str:
    return f"""{O.posts_cte()},
f as (select platform, object_id, created_us, sha256({value}) as fingerprint from posts),
r as (select *, row_number() over (partition by fingerprint order by created_us, platform, object_id) as rn,
             count(*) over (partition by fingerprint) as n_copies from f)
select fingerprint, platform, object_id, cast(n_copies as bigint) as n_copies from r where rn = 1"""


@register("fingerprint_dedup", _fp_sql(_NORM_SQL))
def fingerprint_dedup(spark, sf_dir):
    """Cross-platform duplicate detection by a text fingerprint."""
    return U.canonical_by_fingerprint(U.fingerprints(unified(spark, sf_dir)))


@register("fingerprint_dedup_url", _fp_sql(_NORM_SQL + " || chr(31) || lower(coalesce(url, ''))"))
def fingerprint_dedup_url(spark, sf_dir):
    """The same by text and URL."""
    return U.canonical_by_fingerprint(U.fingerprints(unified(spark, sf_dir), with_url=True))
