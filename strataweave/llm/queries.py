"""The corpus queries: one per operator, over whole tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import exact_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, suffix_dedup, token_output, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_ids(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), threshold=0.85)


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7_pii that SQL can express."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def rule_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8_quality_rules, from its counts alone."""
    counts = quality_rules.text_statistics(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


OP1_SQL = r"""
with base as (
  select doc_id, source, length(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]+', '', 'g'))
           + case when regexp_matches(text, '[^\x20\x09-\x0D]') then 1 else 0 end as size,
         md5(concat_ws('|', cast(doc_id as varchar), md5(coalesce(text, '')))) as key
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
         [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3] as weight
  from base group by source),
levels as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(source_size * 2.0::double) over (order by source_size * 2.0::double / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by source_size * 2.0::double / weight, source is null, encode(source) rows between current row and unbounded following) as own
  from sources),
targets as (
  select source, source_size, least(source_size * 2.0::double, weight * max(own) over ()) as target, row_number() over (order by source is null, encode(source)) as source_no from levels),
cuts as (
  select source_no, cast(ceil(round(target) / 4096) as bigint) as n_blocks, cast(coalesce(sum(ceil(round(target) / 4096)) over (order by source_no rows between unbounded preceding and 1 preceding), 0) as bigint) as lo
  from targets),
size_of as (select cast(sum(n_blocks) as bigint) as total, greatest(1, cast(ceil(log2(greatest(sum(n_blocks), 1))) as int)) as bits from cuts),
points as (
  select s.slot, cast(list_sum(list_transform(range(0, bits), lambda b: ((s.slot >> b) & 1) << (bits - 1 - b))) as bigint) as point
  from size_of, lateral (select unnest(range(0, cast(1 << bits as bigint))) as slot) s),
schedule as (
  select p.slot, c.source_no, row_number() over (partition by c.source_no order by p.slot) - 1 as block
  from points p join cuts c on p.point >= c.lo and p.point < c.lo + c.n_blocks),
placed as (
  select b.doc_id, b.size, t.source_size, t.target, t.source_no, cast(round(t.target) as bigint) as stop,
         coalesce(sum(b.size) over (partition by b.source order by b.key, b.size rows between unbounded preceding and 1 preceding), 0) as place
  from base b join targets t on b.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(case when size = 0 then 0 else size * (stop // source_size) + greatest(0, least(size, stop % source_size - place)) end as bigint) as taken,
       case when size > 0 and place < stop then slot end as first_slot
from placed left join schedule s on s.source_no = placed.source_no and s.block = place // 4096
"""

OP5_SQL = r"""
with base as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size, doc_id is not distinct from min(doc_id) over same as kept, text_sha256
from base window same as (partition by text_sha256)
"""

OP6_SQL = r"""
with base as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
bits as (select *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') as b from base),
named as (
  select *, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + list_sum(list_transform(range(1, 6), lambda k: cast(substr(b, 5 * j + k, 1) as int) * (1 << (5 - k)))) as bigint), 1)), '') as payload_digest
  from bits)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, payload_digest,
       case when page_id = max(page_id) over same then 'response' else 'revisit' end as record_type,
       case when page_id <> max(page_id) over same then max(page_id) over same end as refers_to
from named window same as (partition by html)
"""

PII_SQL = r"""
with found as (
  select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as n_email,
         list_filter(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast(right('000' || p, 3) as int) > 255)) = 0) as ips,
         list_transform(regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) as cards,
         list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 9 and 15) as phones
  from (select doc_id, coalesce(text, '') as text from documents)),
sums as (
  select *, list_filter(cards, lambda c: length(c) between 13 and 19 and list_sum(list_transform(range(1, length(c) + 1), lambda i:
           case when i % 2 = 1 then cast(substr(c, i, 1) as int) when substr(c, i, 1) < '5' then 2 * cast(substr(c, i, 1) as int) else 2 * cast(substr(c, i, 1) as int) - 9 end)) % 10 = 0) as good
  from found)
select doc_id, n_email::bigint as n_email, len(ips)::bigint as n_ip, len(good)::bigint as n_card, len(phones)::bigint as n_phone from sums
"""

RULES_SQL = r"""
with base as (
  select row_number() over () as row_no, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (
  select row_no, unnest(range(1, len(words) - 1)) as place, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as three
  from base where len(words) >= 3),
twice as (select row_no, three from windows group by all having count(*) > 1),
covered as (select distinct row_no, place + d as place from windows join twice using (row_no, three), (values (0), (1), (2)) t(d)),
counted as (select row_no, count(*) as n from covered group by row_no)
select doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
       (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
from base left join counted using (row_no)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_ids": op9_token_ids,
    "op10_near_dedup": op10_near_dedup,
    "pii_base_counts": pii_base_counts,
    "rule_base_counts": rule_base_counts,
}
SQL: dict[str, str] = {"op1_mix": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op6_warc": OP6_SQL, "pii_base_counts": PII_SQL, "rule_base_counts": RULES_SQL}
