"""The corpus queries: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taglog.llm.common import table
from taglog.llm.decontaminate import contamination_report
from taglog.llm.html_text import extract_text
from taglog.llm.jaccard import jaccard_classes
from taglog.llm.langid import identify, train
from taglog.llm.licenses import oracle as license_oracle
from taglog.llm.licenses import scan_licenses
from taglog.llm.media import encode_media, media_features
from taglog.llm.packing import pack_documents
from taglog.llm.pii import find_pii
from taglog.llm.quality import judge
from taglog.llm.quality import train as train_quality
from taglog.llm.sharding import shard_report


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = train_quality(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text", "source"), evidence, with_text=False)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100).drop("n_members")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_media_columns": op6_media_columns,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op2_license_scan": license_oracle(),
    "op5_jaccard_join": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, g from (
    select doc_id, array_to_string(w, ' ') as g from w where len(w) between 1 and 3 union all
    select doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from w where len(w) > 3))),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
r(x, y) as (select doc_id, doc_id from n union select r.x, e.b from r join e on r.y = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id
from documents d left join n on d.doc_id = n.doc_id left join (select x, min(y) as c from r group by x) m on m.x = d.doc_id
""",
    "op10_decontaminate": f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') as w from benchmark),
bw as (select distinct item_id, least(len(w), 8) as n, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
hit as (select doc_id, item_id, s, dw.n from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(words.n_hit, 0) as n_hit, coalesce(found.n_items, 0) as n_items,
       sha256(coalesce(found.ids, '')) as items_sha256, coalesce(found.n_items, 0) >= 2 as contaminated
from d left join words on d.doc_id = words.doc_id left join found on d.doc_id = found.doc_id
""",
}
