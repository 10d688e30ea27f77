"""Queries over the store, stats and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.operators import stats as ST
from postlake.plans import oracle as O
from postlake.plans import params as P
from postlake.plans.common import unified
from postlake.plans.flat import flat_posts
from postlake.plans.registry import register
from postlake.session import exists, scratch_path
from postlake.sources import export as EX
from postlake.sources.store import Store


def loaded_store(spark, sf_dir, name="store"):
    """All fixture posts validated and upserted into a fresh store as batch 0."""
    posts = unified(spark, sf_dir)
    st = Store(spark, scratch_path(spark, name)).create()
    st.ingest(posts, 0)
    return st


_STATS_SQL = f"""{O.posts_cte()},
l(platform) as (values {", ".join(f"('{p}')" for p in P.PLATFORMS)}),
b as (select case when platform in (select platform from l) then platform else 'other' end as platform from posts),
c as (select platform, count(*) as n from b group by platform),
w(platform) as (select platform from l union all select 'other' union all select 'total')
select w.platform, cast(case when w.platform = 'total' then (select count(*) from b)
                             else coalesce(c.n, 0) end as bigint) as n
from w left join c on c.platform = w.platform"""


@register("stats_by_platform", _STATS_SQL)
def stats_by_platform(spark, sf_dir):
    """Flagship: payloads -> normalized -> upserted store -> counts per
    platform (zero-filled), other and total."""
    st = loaded_store(spark, sf_dir)
    return ST.count_by_platform(spark, st.read(), P.PLATFORMS)


PAGE = ("mastodon", 10, 25)
_PAGE_SQL = f"""{O.posts_cte(("mastodon",))}
select * from posts where platform = '{PAGE[0]}' order by seq, platform, object_id
limit {PAGE[2]} offset {PAGE[1]}"""


@register("posts_page", _PAGE_SQL)
def posts_page(spark, sf_dir):
    st = loaded_store(spark, sf_dir)
    return flat_posts(st.page(*PAGE))


AFTER = (3, 20)  # pages of twenty rows, the third
_AFTER_SQL = f"""{O.posts_cte()}
select platform, object_id, seq from posts where object_id <> '' order by seq, platform, object_id
limit {AFTER[1]} offset {(AFTER[0] - 1) * AFTER[1]}"""


@register("posts_page_after", _AFTER_SQL)
def posts_page_after(spark, sf_dir):
    """Pages by cursor, each behind the last row of the one before."""
    st = loaded_store(spark, sf_dir)
    page = st.page_after(None, AFTER[1])
    for _ in range(AFTER[0] - 1):
        page = st.page_after(st.cursor(page), AFTER[1])
    return page.select("platform", "object_id", "seq")


_DISPATCH_SQL = f"""{O.posts_cte()},
f(suffix) as (values ('.json'), ('.csv'), ('.parquet'), ('.xml'), ('')),
n as (select count(*) as n from posts)
select suffix, case when suffix in ('.xml', '') then 'refused' else 'written' end as outcome,
  case when suffix in ('.xml', '') then 0 else n end as n from f, n
union all select '.json of nothing', 'skipped', 0"""


@register("export_dispatch", _DISPATCH_SQL)
def export_dispatch(spark, sf_dir):
    """K7: the format follows the suffix; an unknown one is refused before anything
    is written, and nothing is written for no rows."""
    posts = unified(spark, sf_dir)
    out = []
    for suffix in (".json", ".csv", ".parquet", ".xml", ""):
        path = scratch_path(spark, "dispatch") + suffix
        try:
            EX.export_posts(posts, path)
        except ValueError:
            out.append((suffix, "refused", int(exists(spark, path))))
        else:
            out.append((suffix, "written", EX.read_export(spark, path).count()))
    path = scratch_path(spark, "dispatch") + ".json"
    nothing = EX.export_posts(posts.where(F.lit(False)), path)
    out.append((".json of nothing", "skipped" if nothing is None else "written", int(exists(spark, path))))
    return spark.createDataFrame(out, "suffix string, outcome string, n bigint")


def _roundtrip(suffix):
    def run(spark, sf_dir):
        posts = unified(spark, sf_dir)
        path = scratch_path(spark, "export") + suffix
        EX.export_posts(posts, path)
        return flat_posts(EX.from_export(EX.read_export(spark, path)))
    return run


# The export record turns null tags into an empty list.
_ALL_SQL = f"{O.posts_cte()}\nselect * replace (coalesce(tags, '') as tags) from posts"
register("export_roundtrip_json", _ALL_SQL)(_roundtrip(".json"))
register("export_roundtrip_csv", _ALL_SQL)(_roundtrip(".csv"))
register("export_roundtrip_parquet", _ALL_SQL)(_roundtrip(".parquet"))


_COLLECTED_SQL = f"""{O.posts_cte()}
select platform, count(*) as collected from posts group by platform"""


@register("collected_per_platform", _COLLECTED_SQL)
def collected_per_platform(spark, sf_dir):
    """A3: rows collected per platform in one run, before de-duplication."""
    return ST.collected_per_platform(unified(spark, sf_dir))
