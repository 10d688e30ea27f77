"""One registered query per operator: each applies its operator, with production
parameters, to the whole of its table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import (ann, bpe, collocations, decontaminate, html_extract, language_id, licenses, line_dedup, mixing, pii, simhash,
                          url_filter, whitening)
from postlake.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f
    return add


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_decode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "lines_gone", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    held = [pii.count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)]
    return found.select("doc_id", *held, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"),
                        pii.digest(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"),
                        pii.count_kind(F.col("spans"), pii.KINDS.index("secret")).alias("n_secret"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: text, declared language, and the source as host."""
    found = language_id.identify(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "id_lang", "id_best", F.round("id_probability", 6).alias("id_probability"), "id_rejected")


@query("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: text, language declared in the markup, address suffix and host,
    with the text model fitted on the labelled documents."""
    model = language_id.fit(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = language_id.identify(language_id.page_evidence(read(spark, sf_dir, "pages")), "page_id", "text", "host",
                                 "declared", model, keep=["page_id", "host", "declared"])
    return found.select("page_id", "host", "declared", "id_lang", "id_best",
                        F.round("id_probability", 6).alias("id_probability"), "id_rejected")


@query("op7_url_filter", """
with u as (
  select page_id, url,
    case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages),
p as (
  select page_id, url,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r(h, q, v, own) as (values
  ('net', '/', 'block', true), ('example.net', '/en/', 'allow', true), ('example.com', '/de/', 'block', true), ('org', '/fr/', 'allow', true),
  LISTED),
x as (select distinct host, path,
  regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') as plain from p),
m as (
  select host, path, max(struct_pack(n := length(h) + length(q), h := h, q := q, v := v)) filter (own) as a,
    max(struct_pack(n := length(h) + length(q), h := h, q := q, v := v)) filter (not own) as b
  from x join r on (case when own then host else plain end = h or case when own then host else plain end like '%.' || h)
    and starts_with(path, q) group by host, path)
select p.page_id, p.url, p.host, p.path, m.a.h || m.a.q as rule, coalesce(m.a.v, m.b.v, 'allow') as verdict
from p left join m on p.host = m.host and p.path = m.path
""".replace("LISTED", ", ".join(f"('{h}', '{p}', '{v}', false)" for h, p, v in url_filter.LISTED)))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "host string, path string, verdict string"
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(url_filter.RULES, schema),
                                  spark.createDataFrame(url_filter.LISTED, schema))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_nearest_vectors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


@query("op10_decontamination", r"""
with d as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from documents),
b as (
  select item_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as n, list_slice(w, i, i + 9) as win
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, i, n, list_slice(w, i, i + n - 1) as win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos on d.doc_id = pos.doc_id left join its on d.doc_id = its.doc_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op11_collocations", r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] as w
  from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
f1 as (select lang, x, cast(count(*) as hugeint) as f from (select lang, unnest(w) as x from p) group by all),
n as (select lang, cast(sum(f) as bigint) as n from f1 group by lang),
f2 as (select lang, w[i] as x, w[i + 1] as y, cast(count(*) as hugeint) as f
  from (select lang, w, unnest(generate_series(1, len(w) - 1)) as i from p) group by all),
f3 as (select lang, w[i] as x, w[i + 1] as y, w[i + 2] as z, cast(count(*) as hugeint) as f
  from (select lang, w, unnest(generate_series(1, len(w) - 2)) as i from p) group by all having count(*) >= 10),
c2 as (select f2.lang, f2.x, f2.y, f2.f as a, p.f as l, q.f as r from f2 join f1 p on p.lang = f2.lang and p.x = f2.x
  join f1 q on q.lang = f2.lang and q.x = f2.y where f2.f >= 10),
s3 as (select f3.*, p.f as f1, q.f as f23, s.f as f12, t.f as f3,
    1000000 * f3.f * f3.f // (p.f * q.f) as s1, 1000000 * f3.f * f3.f // (s.f * t.f) as s2
  from f3 join f1 p on p.lang = f3.lang and p.x = f3.x join f2 q on q.lang = f3.lang and q.x = f3.y and q.y = f3.z
  join f2 s on s.lang = f3.lang and s.x = f3.x and s.y = f3.y join f1 t on t.lang = f3.lang and t.x = f3.z),
longer as (select lang, x, y, max(f) as f from (select lang, x, y, f from f3 union all select lang, y, z, f from f3) group by all),
c as (
  select c2.lang, c2.x || ' ' || c2.y as phrase, a, l, r, 1000000 * a * a // (l * r) as score
  from c2 left join longer g on g.lang = c2.lang and g.x = c2.x and g.y = c2.y where g.f is null or 100 * g.f < 50 * a
  union all
  select lang, x || ' ' || y || ' ' || z, f, case when s1 <= s2 then f1 else f12 end,
    case when s1 <= s2 then f23 else f3 end, least(s1, s2) from s3),
k as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from c)
select k.lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n,
  cast(score as bigint) as score from k join n on n.lang = k.lang where rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op12_source_mix", r"""
with w as (
  select doc_id, source is null as none, coalesce(source, '') as key,
    cast(len([x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']) as bigint) as size,
    substr(sha256('12|' || coalesce(cast(doc_id as varchar), '-') || '|' || sha256(coalesce(text, ''))), 1, 32) as draw from documents),
s as (
  select none, key, cast(sum(size) as bigint) as source_size, 2 * cast(sum(size) as bigint) as cap,
    [3, 1, 2][cast((row_number() over (order by none, encode(key)) - 1) % 3 + 1 as integer)] as weight from w group by none, key),
-- In the order of cap / weight the first k sources are clamped.
o as (
  select *, coalesce(sum(cap) over (order by cap / weight, none, key rows between unbounded preceding and 1 preceding), 0) as clamped,
    sum(weight) over (order by cap / weight, none, key rows between current row and unbounded following) as rest,
    (select 1.5 * sum(source_size) from s) as mix from s),
level as (select min(cap / weight) as least from o where cap * rest >= weight * (mix - clamped)),
f as (
  select none, key, source_size, case when cap / weight < least then cast(cap as double)
    else cast(weight * (select any_value(mix) - coalesce(sum(cap) filter (cap / weight < least), 0) from o, level) as double)
      / cast((select sum(weight) filter (cap / weight >= least) from o, level) as double) end as target
  from s, level),
g as (
  select *, least(floor(target + 0.5), 2 * source_size)::bigint as whole,
    case when source_size > 0 then least(floor(target + 0.5), 2 * source_size)::bigint // source_size else 0 end as reps from f),
d as (
  select w.*, g.source_size, target, reps, whole - reps * source_size as rest,
    coalesce(sum(size) over (partition by w.none, w.key order by draw rows between unbounded preceding and 1 preceding), 0) as before
  from w join g on w.none = g.none and w.key = g.key)
select doc_id, size, source_size, target, cast(reps * size + greatest(least(rest - before, size), 0) as bigint) as taken from d
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = mixing.cycled_weights(mixing.ranked_sources(docs))
    return mixing.mix(docs, weights, keep=["doc_id"])


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))
