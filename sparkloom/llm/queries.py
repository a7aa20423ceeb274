"""Registered queries of this subpackage; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, iblt, mixing, near_dup, ogg, packing, quality, simple8b, token_counts, urls
from .common import table
from .tokens import vocabulary_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from ``labels`` outside the held-out fold."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of ``documents``."""
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b token files of ``documents``, read back."""
    path = simple8b.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=2)
    return simple8b.read_token_files(spark, path)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ogg media column of ``documents``, read back."""
    return ogg.read_media(ogg.store_media(table(spark, sf_dir, "documents")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on 4-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invertible fingerprints of ``documents`` and their edited texts."""
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from transcripts of all ``conversations``."""
    parts = chat.transcripts(table(spark, sf_dir, "conversations"))
    return chat.parse(parts.select("conv_id", "part", "text"), chat.fit_model(parts))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` at weights 5, 2, 1 and 150 % of their words."""
    return mixing.taken(mixing.plan_mix(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_section_tokens": op2_section_tokens,
    "op3_token_files": op3_token_files,
    "op4_media": op4_media,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_urls": op6_urls,
    "op7_fingerprints": op7_fingerprints,
    "op8_chat": op8_chat,
    "op9_mix": op9_mix,
    "op10_packing": op10_packing,
}

#: The mix in SQL: words, water-filled targets (a source's cap binds in order of size over weight), then
#: the overlap of each document's two places on its source's line with what the source gives; golden-ratio
#: points give each block of a source its slot.
_MIX_SQL = """
with sized as (
  select row_number() over () as rid, doc_id, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5('mix-' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
sources as (
  select source, sum(size)::hugeint as source_size, row_number() over (order by source nulls last) - 1 as queue
  from sized group by source),
weighed as (
  select *, (case queue % 3 when 0 then 5 when 1 then 2 else 1 end)::hugeint as weight,
    sum(source_size) over () as total
  from sources),
ranked as (
  select *,
    coalesce(sum(source_size) over w, 0)::hugeint as capped_before,
    (sum(weight) over () - coalesce(sum(weight) over w, 0))::hugeint as weight_left
  from weighed
  window w as (order by source_size::double / weight, queue rows between unbounded preceding and 1 preceding)),
flagged as (
  select *, weight * (3 * total - 4 * capped_before) >= 4 * source_size * weight_left as capped from ranked),
rest as (
  select coalesce(sum(source_size) filter (capped), 0)::hugeint as capped_size,
    coalesce(sum(weight) filter (not capped), 0)::hugeint as weight_left from flagged),
targets as (
  select f.*, case when total = 0 then 0 when capped then 2 * source_size else (weight * (3 * total - 4 * r.capped_size)) // (2 * r.weight_left) end as give,
    case when total = 0 then 0.0 when capped then cast(2 * source_size as double)
      else cast(weight * (3 * total - 4 * r.capped_size) as double) / cast(2 * r.weight_left as double) end as target
  from flagged f, rest r),
placed as (
  select s.rid, t.queue, s.doc_id, s.size, t.source_size, t.target, t.give,
    coalesce(sum(s.size) over (partition by t.queue order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as place
  from sized s join targets t on s.source is not distinct from t.source),
opened as (
  select queue, give, (give + 255) // 256 as needs, sum(give) over () as all_give,
    coalesce(sum(give) over w, 0)::hugeint as give_before, coalesce(sum((give + 255) // 256) over w, 0) as needs_before
  from targets where give > 0
  window w as (order by queue rows between unbounded preceding and 1 preceding)),
starts as (select *, give_before * 4611686018427387904 // all_give as lo from opened),
intervals as (select *, coalesce(lead(lo) over (order by queue), 4611686018427387904) as hi from starts),
points as (
  select i as slot, ((i + 1)::hugeint * 2850178704830799621) % 4611686018427387904 as point
  from (select unnest(generate_series(0, (select coalesce(sum(needs), 0)::bigint from opened) - 1)) as i)),
dealt as (
  select o.queue, o.needs, p.slot, row_number() over (partition by o.queue order by p.slot) - 1 as block
  from points p join intervals o on p.point >= o.lo and p.point < o.hi),
given as (select o.queue, o.needs, o.needs_before, count(r.slot) as given from opened o left join dealt r using (queue) group by all),
slots as (
  select queue, block, slot from dealt where block < needs
  union all
  select queue, block, (select sum(needs) from opened) + needs_before + block
  from (select *, unnest(generate_series(given, (needs - 1)::bigint)) as block from given where given < needs)),
spans as (
  select rid, queue, e as epoch, place + e * source_size as low, least(place + e * source_size + size, give) as high
  from placed, (values (0), (1)) v(e) where size > 0),
first_slots as (
  select rid, min(slot) as first_slot, count(*) as slots
  from spans p join slots s on s.queue = p.queue and s.block between p.low // 256 and (p.high - 1) // 256
  where p.high > p.low group by rid)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(greatest(0, least(place + size, give) - place)
    + greatest(0, least(place + source_size + size, give) - (place + source_size)) as bigint) as taken,
  cast(first_slot as bigint) as first_slot, cast(coalesce(slots, 0) as bigint) as slots
from placed left join first_slots using (rid)
"""

ORACLE_SQL: dict[str, str] = {"op9_mix": _MIX_SQL}
