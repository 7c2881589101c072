"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import chat, decontaminate, langid, lm, mixing, simhash, sketch, suffixes, toxicity, urls

#: The rules of op6.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_part(4) != 2))
    held = F.coalesce(_part(4) == 2, F.lit(False))
    return langid.identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_part(3) != 1))
    held = F.coalesce(_part(3) == 1, F.lit(False))
    return toxicity.score(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted", "lang_group")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs, key="doc_id"))


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_decontaminate, op4_simhash, op5_toxicity, op6_url_filter, op7_suffix_dedup, op8_mixing, op9_lm_score, op10_sketch)}


_OP6 = """
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(verdict, h, p) as (values %s
), fits as (
  select page_id, arg_max(struct_pack(rule := h || p, verdict := r.verdict), length(h) * 10000 + length(p)) as best
  from cut join rules r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select c.page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from cut c left join fits f on c.page_id = f.page_id
""" % ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

_SPLIT = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda s: s <> '')"
_SKETCH = """list_sort(list_distinct(list_filter(case when len({w}) = 0 then [] else list_transform(range(1, greatest(1, len({w}) - 4) + 1),
  lambda i: substr(md5(array_to_string(list_slice({w}, i, i + 4), ' ')), 1, 12)) end, lambda x: x < '4')))"""
_PRINT = "substr(md5({t}), 1, 12) || '|' || array_to_string({h}, ',')"
_NEAR = """case when {a} = {b} then 1.0 when least(len({x}), len({y})) = 0 then 0.0
  else len(list_intersect({x}, {y}))::double / least(len({x}), len({y})) end"""

_OP10 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as x from d),
e as (select doc_id, t, x, left(t, length(t) - length(t) // 4) || left(x, length(t) // 4) as e from n),
w as (select doc_id, t, e, x, {_SPLIT.format(t='t')} as wt, {_SPLIT.format(t='e')} as we, {_SPLIT.format(t='x')} as wx from e),
h as (select doc_id, t, e, x, {_SKETCH.format(w='wt')} as ht, {_SKETCH.format(w='we')} as he, {_SKETCH.format(w='wx')} as hx from w)
select doc_id, length(t)::bigint as n_chars, sha256(e) as edited_sha256, {_PRINT.format(t='t', h='ht')} as fingerprint, {_PRINT.format(t='e', h='he')} as edited_fingerprint,
  {_NEAR.format(a='t', b='e', x='ht', y='he')} as near_edited, {_NEAR.format(a='t', b='x', x='ht', y='hx')} as near_next
from h
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": _OP6, "op10_sketch": _OP10}
