"""The queries of the training-data operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, discriminant, langid, licenses, packing, passages, quality, sentencepieces, simhash, sketches, toxicity, urls
from .common import documents


#: Rules of the URL query: host and path, and what they say.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), with_ids=False, with_digests=True)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_edited(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "flagged")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.cut_passages(documents(spark, sf_dir), digest=True)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 counts, for comparison with SQL."""
    return op2_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 says by rules alone, for comparison with SQL."""
    out = op6_urls(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's edited texts, for comparison with SQL."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    compared = {f.__name__: f for f in (quality_counters, url_rules, edited_texts)}
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | compared


_WORD = r"[^\x20\x09-\x0D]+"
_RULES = sorted(URL_RULES, key=lambda r: (-len(r), r))
_FITS = " ".join(f"when (host = '{d}' or ends_with(host, '.{d}')) and starts_with(path, '/{p}') then '{d}/{p}'" for d, _, p in (r.partition("/") for r in _RULES))

SQL = {
    "op11_filter_audit": f"""with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') as words from t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
+ 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
+ 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as fails from w left join l using (doc_id)),
g as (select part, fails, good, toxic, count(*) as n from f group by all),
x as (select unnest(range(5)) as i),
o as (select '' as filter_order, 0 as used, 0 as step, 0 as first, 0 as own union all
select filter_order || chr(65 + i::int), used | (1 << i)::int, step + 1, used, (1 << i)::int from o, x where used & (1 << i)::int = 0),
s as (select d.filter_order, k.step, k.first, k.own from o d join o k on starts_with(d.filter_order, k.filter_order) where d.step = 5 and k.step > 0),
c as (select part, filter_order, step, own, cast(sum(case when fails & (first | own) = 0 then n else 0 end) as bigint) as kept,
cast(sum(case when fails & own > 0 and fails & first = 0 then n else 0 end) as bigint) as removed, cast(sum(case when fails & own > 0 and fails & first > 0 then n else 0 end) as bigint) as redundant,
cast(sum(case when fails = own then n else 0 end) as bigint) as unique_fails, cast(sum(case when fails & own > 0 and fails & first = 0 then n * good else 0 end) as bigint) as good_lost,
cast(sum(case when fails & own > 0 and fails & first = 0 then n * toxic else 0 end) as bigint) as toxic_lost from g, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from c""",
    "quality_counters": f"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents),
windows as (select doc_id, s, count(*) over (partition by doc_id, words[s], words[s + 1], words[s + 2]) as n from (select doc_id, words, unnest(range(1, len(words) - 1)) as s from t)),
repeats as (select doc_id, count(distinct s + k) as n_repeat_words from windows, range(3) as r(k) where n > 1 group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as l from t)
select doc_id, len(words) as n_words, coalesce(cast(list_sum(list_transform(words, lambda w: length(w))) as bigint), 0) as word_chars,
length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
len(words) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(words) as base_failed from t join lines using (doc_id) left join repeats using (doc_id)""",
    "url_rules": f"""with u as (select page_id, case when contains(url, '://') then substring(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select page_id, host, path, case {_FITS} end as rule from p)
select page_id, host, path, rule, case {" ".join(f"when rule = '{r}' then '{v}'" for r, v in URL_RULES.items())} end as rule_verdict from r""",
    "edited_texts": """with t as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, length(text) as n_chars, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as follower from t)
select doc_id, n_chars, sha256(substring(text, 1, n_chars - n_chars // 3) || substring(follower, 1, n_chars // 3)) as edited_sha256 from n""",
}


def oracle_sql() -> dict[str, str]:
    """Of the opN queries SQL tells some columns only; these are queries of their own. tests/llm holds brute-force versions."""
    return SQL
