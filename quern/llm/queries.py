"""The corpus operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import compression, decontam, htmltext, lattice, linededup, neardup, packing, toxicity, urlfilter, warc
from quern.llm.common import read


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents"), with_text=False)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive_pages(read(spark, sf_dir, "pages"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_line_dedup, op3_url_filters, op4_decontamination, op5_html_extraction,
        op6_lm_scoring, op7_quality_rules, op8_toxicity, op9_warc, op10_minhash_near_dedup,
    )
}

WS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A-Z only, as lower() would change other letters too.
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op2_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (select *, translate(trim(line, {WS}), {UPPER}, {LOWER}) as key from lines),
shared as (select key, max(doc_id) as last_doc from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (select k.*, s.key is null or k.doc_id = s.last_doc as stays from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where not stays) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where stays), '')) as kept_sha256
from judged group by doc_id""",
    "op4_decontamination": f"""
with item_words as (
  select item_id, regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, w[i : i + least(10, len(w)) - 1] as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)),
sizes as (select distinct len(win) as n from windows),
doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
places as (
  select doc_id, n, i, w[i : i + n - 1] as win
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from doc_words, sizes where len(w) >= n)),
hits as (select p.doc_id, p.n, p.i, x.item_id from places p join windows x on p.win = x.win),
covered as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + n)) as spot from (select distinct doc_id, n, i from hits)) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join covered using (doc_id) left join items using (doc_id)""",
    "op9_warc": """
with hashed as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as first from hashed where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, h.payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from hashed h left join firsts f on h.payload_digest = f.payload_digest and payload_bytes >= 100""",
    "op10_minhash_near_dedup": """
with recursive words as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
held as (select s, doc_id, n from shingles join sizes using (doc_id)),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as both_have, any_value(a.n) as na, any_value(b.n) as nb
  from held a join held b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
links as (select a, b from pairs where 100 * both_have >= 80 * (na + nb - both_have)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, node) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join edges e on r.node = e.a)
select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sizes using (doc_id) join (select doc_id, min(node) as component_id from reach group by doc_id) c using (doc_id)""",
}
