"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, embed_dedup, licenses, mixing, packing, pii, simhash, toxicity, urlfilter, warc
from gridloom.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.quality_of(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), quality=quality).select("doc_id", "size", "source_size", "target", "taken")


OP1 = r"""
with rated as (
  select doc_id, avg(quality) q from labels where doc_id is not null and quality is not null group by doc_id
), rows as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    -ln((('0x' || substr(md5('17:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double)
      / coalesce(0.5::double + 1.5::double * r.q, 1.0::double) as k
  from documents d left join rated r on d.doc_id = r.doc_id
), per as (
  select source, sum(size)::bigint size, ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w
  from rows group by source
), ranked as (
  select *, row_number() over (order by 2.0 * size / w, source nulls last) i, sum(size) over () total from per
), levels as (
  select *, coalesce(sum(size) over (order by i rows between unbounded preceding and 1 preceding), 0)::double held,
    sum(w) over (order by i rows between current row and unbounded following) open from ranked
), level as (
  -- the first source, by the level that fills it, which stays open
  select coalesce(min_by((1.5 * total - 2.0 * held) / open, i) filter (where (1.5 * total - 2.0 * held) / open < 2.0 * size / w), 1e300) as t from levels
), goal as (
  select source, size source_size, least(2.0 * size, (select t from level) * w)::double target from per
), parts as (
  select *, case when source_size > 0 then floor(target / source_size) else 1 end::bigint epochs from goal
), summed as (
  select r.doc_id, r.size, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::bigint rest,
    sum(r.size) over (partition by r.source order by r.k, r.doc_id, r.size rows unbounded preceding) upto
  from rows r join parts p on r.source is not distinct from p.source
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - (upto - size))))::bigint taken from summed
"""


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP2 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda c: c::double) e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0
), links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    and list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), n as (select a, count(*) n from links group by a), c as (select a, min(b) m from reach group by a)
select e.vec_id, coalesce(n.n, 0)::bigint n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) component_id,
  e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) kept
from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP6 = """
with p as (
  select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages
), k as (select d, max(page_id) keeper from p where n >= 1000 group by d)
select page_id, n::bigint payload_bytes, d payload_digest, case when k.keeper <> page_id then 'revisit' else 'response' end record_type,
  case when k.keeper <> page_id then k.keeper end refers_to
from p left join k using (d)
"""


def list_entries(pages: DataFrame, first_day: str = "2024-01-01") -> DataFrame:
    """A dated filter list over the hosts and domains of pages, by a rule on their md5: three entries for about half of them."""
    name = F.explode(urlfilter.suffixes(urlfilter.host(F.col("url")))).alias("pattern")
    names = pages.where(urlfilter.host(F.col("url")).isNotNull()).select(name).where("pattern like '%.%'").distinct()
    number = lambda c, n: F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("int")
    entry = F.concat_ws("#", "pattern", F.col("k").cast("string"))
    rows = names.where(number(F.col("pattern"), 1) < 8).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    action = F.element_at(F.array(*map(F.lit, ("block", "block", "allow", "remove"))), number(entry, 4) % 4 + 1)
    return rows.select("pattern", action.alias("action"), F.date_add(F.lit(first_day).cast("date"), number(entry, 3) % 366).alias("day"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are taken as fetched on day page_id mod 366 of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return urlfilter.filter_urls(pages.withColumn("day", day), list_entries(pages))


_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '')"
OP7 = rf"""
with caps as (select page_id, {_HOST} host, date '2024-01-01' + (page_id % 366)::int as day from pages),
keys as (
  select *, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) pattern
  from caps where host is not null
), names as (
  select distinct pattern from keys where pattern like '%.%' and ('0x' || substr(md5(pattern), 1, 1))::int < 8
), entries as (
  select pattern, (['block', 'block', 'allow', 'remove'])[('0x' || substr(md5(pattern || '#' || k), 1, 4))::int % 4 + 1] action,
    date '2024-01-01' + ('0x' || substr(md5(pattern || '#' || k), 1, 3))::int % 366 as day
  from names, range(3) t(k)
), one as (select pattern, day, max(action) action from entries group by all),
spans as (select pattern, action, day valid_from, lead(day) over (partition by pattern order by day) valid_to from one),
met as (
  select k.page_id, k.day, s.* from keys k join spans s on k.pattern = s.pattern and k.day >= s.valid_from
    and (s.valid_to is null or k.day < s.valid_to) where s.action <> 'remove'
  qualify row_number() over (partition by page_id order by length(k.pattern) desc) = 1
)
select c.page_id, c.host, c.day::date as day, m.pattern, m.action, m.valid_from::date valid_from, m.valid_to::date valid_to,
  coalesce(m.action <> 'block', true) kept
from caps c left join met m using (page_id)
"""


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_mixing,
        op2_embedding_near_dedup,
        op3_toxicity,
        op4_pii,
        op5_license_scans,
        op6_warc,
        op7_url_filters,
        op8_simhash_near_dedup,
        op9_nearest_neighbours,
        op10_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_embedding_near_dedup": OP2, "op6_warc": OP6, "op7_url_filters": OP7}
