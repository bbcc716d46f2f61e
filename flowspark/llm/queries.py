"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, jaccard_join, ppm, quality_model, quality_rules, revisits, secrets, sharding, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve_revisits(revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    line = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.col("headers")[k])), ";")
    return out.select("record_id", "canonical_url", "resolved", "source_id", "digest", line.alias("headers"))


def op3_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))  # no doc_id: no remainder 2
    out = ppm.ppm_score(table(spark, sf_dir, "documents"), trains)
    return out.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0, fold == 4)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _digest(spans, base_only: bool):
    """kind:start:end of an array of (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    if base_only:
        spans = F.filter(spans, lambda x: x["kind"] < len(secrets.BASE))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(secrets.BASE)], F.sha2(_digest(F.col("spans"), True), 256).alias("base_sha256"), _digest(F.col("spans"), False).alias("spans"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_spans(table(spark, sf_dir, "documents")).drop("runs")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    out = byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, ids=False)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op10_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_ppm_scoring": op3_ppm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_linking": op5_secret_linking,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_adaptive_rules": op10_adaptive_rules,
}
_OP2 = """
with p as (
    select page_id, url, sha1(coalesce(html, '')) as digest, '"' || substr(sha1(coalesce(html, '')), 1, 12) || '"' as tag, length(coalesce(html, '')) % 2 = 0 as even,
           strftime(date '2024-01-01' + (page_id % 300)::int, '%Y-%m-%d') as day, regexp_replace(url, '#.*$', '') || '#again' as other
    from pages
),
c as (
    select 'a:' || page_id as record_id, url, page_id * 10 + 1 as ts, 'response' as kind, digest, tag, 'text/html' as ctype, day, null as cache, null as expires from p
    union all select 'b:' || page_id, other, page_id * 10 + 2, 'revisit', digest, tag, null, day, 'max-age=60', null from p
    union all select 'c:' || page_id, url, page_id * 10 + 3, 'response', sha1(digest), '"n' || substr(digest, 1, 12) || '"', 'text/html', null, null, null from p where even
    union all select 'd:' || page_id, other, page_id * 10 + 4, 'revisit', digest, tag, null, null, null, '0' from p
),
u as (select *, regexp_replace(url, '#.*$', '') as bare from c),
h as (
    select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^:/?#]+://([^/?#]*)', 1)), '(^[^@]*@)|(:(80|443)$)', '', 'g'), '^www\\.', '') as host,
           regexp_replace(bare, '^[^:/?#]+://[^/?#]*', '') as rest
    from u
),
q as (
    select *, regexp_replace(split_part(rest, '?', 1), '/+$', '') as path,
           array_to_string(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)=')), '&') as query
    from h
),
k as (select *, host || path || case when query <> '' then '?' || query else '' end as canonical_url from q),
j as (
    select r.record_id, r.canonical_url, r.tag = o.tag as same, o.record_id as source_id, o.digest, o.ctype, coalesce(r.day, o.day) as day, r.cache, r.expires, r.tag
    from (select * from k where kind = 'revisit') r asof left join (select * from k where kind = 'response') o on r.canonical_url = o.canonical_url and r.ts > o.ts
)
select record_id, canonical_url, coalesce(same, false) as resolved, case when same then source_id end as source_id, case when same then digest end as digest,
       case when same then array_to_string(list_filter([case when cache is not null then 'cache-control=' || cache end, 'content-type=' || ctype, case when day is not null then 'date=' || day end,
           'etag=' || case when record_id like 'b:%' then 'W/' else '' end || tag, case when expires is not null then 'expires=' || expires end], lambda x: x is not null), ';') end as headers
from j
"""

SQL: dict[str, str] = {"op2_warc_revisits": _OP2}
