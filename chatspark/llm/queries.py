"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import decompose, digests
    return digests(decompose(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


@query
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pareto_mix
    return pareto_mix(read_documents(spark, sf_dir), weights=[5, 2, 1], share=1.5, limit=2.0).drop("row_key")


@query
def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates
    return near_duplicates(read_documents(spark, sf_dir)).drop("row_key")


@query
def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import hilbert_shards
    return hilbert_shards(read_documents(spark, sf_dir), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts
    return quality_verdicts(read_documents(spark, sf_dir), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance")


@query
def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE_RULES, MORE_RULES, find_secrets, span_text
    rules = BASE_RULES + MORE_RULES
    kinds = [r.kind for r in rules]
    found = find_secrets(read_documents(spark, sf_dir), rules)

    def of_kind(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kinds[k]}")

    return found.select(
        "doc_id", *[of_kind(k) for k in range(len(BASE_RULES))], F.sha2(span_text("spans", kinds, len(BASE_RULES)), 256).alias("base_sha256"),
        span_text("spans", kinds).alias("spans"))


@query
def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_folder
    from .warc import read_warc, resolved, write_warc
    folder = shared_folder(spark, "warc")
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = resolved(read_warc(index, folder), index.count())
    kind = dict(index.dtypes)["page_id"]
    return found.select(F.nullif("page", F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


@query
def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import stupid_backoff
    return stupid_backoff(read_documents(spark, sf_dir))


@query
def op9_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import radix_dedup
    return radix_dedup(read_documents(spark, sf_dir)).drop("row_key")


ORACLES["op9_radix_dedup"] = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t
  from documents),
g as (select t, count(*) as group_size, arg_min(doc_id, struct_pack(c := -chars, d := doc_id)) as keep_id
      from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t
"""


@query
def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores
    return toxicity_scores(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op12_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged_and_repaired
    return damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import ngram_jaccard_join
    return ngram_jaccard_join(read_documents(spark, sf_dir), percent=90, width=3)


ORACLES["op13_token_combination_join"] = r"""
with recursive w as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
s as (
  select r, doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from w),
d as (select min(r) as r, s, len(s) as n, min(doc_id) as least from s where len(s) > 0 group by s),
t as materialized (select r, n, unnest(s) as t from d),
p as materialized (
  select a.r as a, b.r as b from t a join t b on a.t = b.t and a.r <> b.r
  group by a.r, b.r, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (select r as a, r as b from d union select reach.a, p.b from reach join p on p.a = reach.b),
c as (select reach.a as r, min(d.least) as component_id from reach join d on d.r = reach.b group by 1)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.component_id, case when len(s.s) = 0 then s.doc_id end) as component_id
from s left join d on d.s = s.s left join c on c.r = d.r
"""


@query
def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import build_index, search
    return search(build_index(read_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


ORACLES["op11_block_max_search"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select cast(count(*) as bigint) as docs, cast(sum(len(w)) as bigint) as words from d where len(w) > 0),
i as (select row_number() over () as i, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
it as (select distinct i, item_id, unnest(w) as t from i),
p as (select r, doc_id, n, t, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as t from d)
      where t in (select t from it) group by all),
wt as (select t, cast(floor(1000 * ln((2.0 * max(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from p, g group by t),
s as (select it.i, it.item_id, p.r, p.doc_id,
        cast(sum(wt.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * g.docs) // g.words)))) as bigint) as score
      from it join p on p.t = it.t join wt on wt.t = it.t cross join g group by all),
k as (select *, row_number() over (partition by i order by score desc, doc_id, r) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 10
"""
