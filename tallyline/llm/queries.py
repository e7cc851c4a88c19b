"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (encoding, language_model, multi_index, near_duplicates, neighbours, packing, pages, quality,
                           repetitions, sharding, substrings, toxicity, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query
def op2_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents"), size=20)
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


ORACLES["op4_difference_cover"] = r"""with w as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p, len(words) as n, words
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents)),
win as (select doc_id, p, list_slice(words, p, p + 19) as key from w where p + 19 <= n),
firsts as (select key, min((doc_id, p)) as f from win group by key),
bad as (select win.doc_id, win.p from win join firsts using (key) where (win.doc_id, win.p) <> firsts.f),
flag as (select w.doc_id, w.p, w.word, max(case when bad.p is not null then w.p end)
    over (partition by w.doc_id order by w.p) as last_bad
  from w left join bad on w.doc_id = bad.doc_id and w.p = bad.p),
agg as (select doc_id, count(*) as n_words, count(*) filter (last_bad is not null and p - last_bad < 20) as n_removed,
    coalesce(string_agg(word, ' ' order by p) filter (last_bad is null or p - last_bad >= 20), '') as kept
  from flag group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents d left join agg on d.doc_id = agg.doc_id"""


@query
def op5_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


@query
def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


ORACLES["op6_superminhash"] = r"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, list_distinct(case when len(w) > 1
    then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from w),
items as materialized (select doc_id, len(s) as n, unnest(s) as item from s),
pairs as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared
  from items a join items b on a.item = b.item and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n),
edges as materialized (select a, b from pairs where 100 * shared >= 80 * (na + nb - shared)),
sides as materialized (select a, b from edges union select b, a from edges),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from reach r join sides e on r.b = e.a),
roots as (select a as doc_id, min(b) as component_id from reach group by a)
select s.doc_id, len(s.s) as n_shingles, r.component_id, s.doc_id = r.component_id as kept
from s join roots r on s.doc_id = r.doc_id"""


@query
def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoding.round_trip_digests(F.col("text"), public_tokenizers.path("word_bpe_49k.json"))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", "c.*")


@query
def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


@query
def op10_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLES["op11_inverted_multi_index"] = """with recursive v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
fit as materialized (select * from v where label is not null and v is not null and len(v) > 0
  and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
edges as materialized (select a.vec_id as a, b.vec_id as b from fit a join fit b
  on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
  and list_cosine_similarity(a.v, b.v) >= 0.93),
sides as materialized (select a, b from edges union all select b, a from edges),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, s.b from reach r join sides s on r.b = s.a),
roots as (select a as vec_id, min(b) as component_id from reach group by a),
degree as (select a as vec_id, count(*) as n from sides group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join roots r on e.vec_id = r.vec_id left join degree d on e.vec_id = d.vec_id"""


@query
def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitions.digests(table(spark, sf_dir, "documents"))


@query
def op13_householder_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))
