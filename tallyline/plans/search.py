"""Retrieval over the documents, with conversation turns as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.operators import lexical as lx
from tallyline.operators import retrieval as rt
from tallyline.operators.index_store import IndexStore
from tallyline.plans.registry import cte, query
from tallyline.session import fresh_path
from tallyline.sources import driver_tables as dt
from tallyline.sources import knowledge

CHUNK_EXPRS = [
    "concat('D', lpad(cast(doc_id as string), 12, '0')) as chunk_id", "cast(doc_id as string) as doc_id", "text",
    "case when doc_id % 7 = 5 then 'restricted' when doc_id % 7 = 6 then 'plant' else 'all' end as access_level",
    "case when doc_id % 7 = 6 then concat('PLT-0', cast(1 + doc_id % 3 as string)) end as plant",
    "case doc_id % 10 when 7 then 'superseded' when 8 then 'expired' else 'current' end as status",
    "lang as doc_type",
]
QUESTION_EXPRS = [
    "concat(cast(conv_id as string), '-', cast(turn as string)) as query_id", "query",
    "case conv_id % 4 when 0 then 'analyst' when 1 then 'leadership' when 2 then 'plant_user' else 'data_owner' end "
    "as role",
    "case when conv_id % 4 = 2 then concat('PLT-0', cast(1 + conv_id % 3 as string)) end as asker_plant",
]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return dt.spread(dt.table(spark, d, "documents"), "doc_id").selectExpr(*CHUNK_EXPRS)


def questions(spark: SparkSession, d: str) -> DataFrame:
    turns = dt.table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id", "turn").agg(
        F.min("text").alias("query"))
    return turns.selectExpr(*QUESTION_EXPRS).withColumn("history", rt.wants_history(F.col("query")))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and questions with hashing vectors; stored, because every vector query reads them."""
    zero = F.array_repeat(F.lit(0.0), rt.DIMENSIONS)  # a text without a word is kept, at the origin
    c = dt.stored(spark, d, "chunk_vectors", lambda: chunks(spark, d).drop("doc_type").join(
        rt.hashing_vectors(chunks(spark, d), "chunk_id", "text"), "chunk_id", "left").withColumn(
        "vector", F.coalesce("vector", zero)))
    q = dt.stored(spark, d, "question_vectors", lambda: questions(spark, d).join(
        rt.hashing_vectors(questions(spark, d), "query_id", "query"), "query_id", "left").withColumn(
        "vector", F.coalesce("vector", zero)))
    return c, q


def _store(spark: SparkSession, d: str):  # noqa: ANN202
    return lambda name, df: dt.stored(spark, d, name, lambda: df)


def lexical(spark: SparkSession, d: str) -> lx.Index:
    """The inverted index over the chunks, built once for all that search in it."""
    return lx.index(lx.counted(chunks(spark, d)), _store(spark, d))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return lx.bm25(lexical(spark, d), questions(spark, d))


def bm25_top(spark: SparkSession, d: str, k: int = rt.TOP_K) -> DataFrame:
    return rt.top_k(lx.bm25_best(lexical(spark, d), questions(spark, d), k), k)


_STOP = ", ".join(f"'{w}'" for w in rt.STOP_WORDS)
_TOK = lambda c: (f"list_filter(regexp_extract_all(lower({c}), '{rt.TOKEN}'), lambda t: t not in ({_STOP}))")
_SEE = """(access_level = 'all' or (access_level = 'restricted' and role in ('leadership', 'data_owner')) or (access_level
    = 'plant' and (role = 'leadership' or coalesce(role = 'plant_user' and plant = asker_plant, false))))"""
_VIS = f"({_SEE} and (status in ('current', 'expired') or history))"
_CTX = "concat_ws('|', role, coalesce(asker_plant, ''), cast(history as varchar))"
cte("chs", [], f"select {', '.join(CHUNK_EXPRS)} from documents")
cte("qs", [], f"""select *, {_CTX} as ctx from (select *, regexp_matches(query, '(?i)\\b(?:version|v)\\s*\\d+(?:\\.\\d+)?\\b') as
    history from (select {', '.join(QUESTION_EXPRS)} from (select conv_id, turn, min(text) as query from conversations
    where role = 'user' group by 1, 2) t) u) w""")
cte("ctxs", ["qs"], "select distinct ctx, role, asker_plant, history from qs")
cte("ctoks", ["chs"], f"select *, {_TOK('text')} as toks from chs")
cte("tfs", ["ctoks"], """select chunk_id, access_level, plant, status, term, count(*) as tf from (select chunk_id,
    access_level, plant, status, unnest(toks) as term from ctoks) x group by all""")
cte("pool", ["ctxs", "ctoks"], f"""select ctx, count(*) as n, avg(len(toks)) as mean_length from ctxs join ctoks on {_VIS}
    group by 1""")
cte("qterms", ["qs"], f"select distinct query_id, ctx, unnest({_TOK('query')}) as term from qs")
cte("bm", ["tfs", "pool", "qterms", "ctxs", "ctoks"], f"""with vis as (select ctx, t.* from ctxs join tfs t on {_VIS}),
    dfs as (select ctx, term, count(*) as df from vis group by 1, 2)
    select q.query_id, v.chunk_id, round(sum(ln(1 + (p.n - d.df + 0.5) / (d.df + 0.5)) * v.tf * 2.5 / (v.tf + 1.5 * (0.25 +
    0.75 * len(c.toks) / p.mean_length))), 9) as score from qterms q join vis v on v.ctx = q.ctx and v.term = q.term join
    dfs d on d.ctx = q.ctx and d.term = q.term join pool p on p.ctx = q.ctx join ctoks c on c.chunk_id = v.chunk_id
    group by 1, 2""")
_WORDS = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _hash_sql(src: str, key: str, text: str) -> str:
    return f"""select {key}, list(coalesce(s, 0) order by i) as v from (select k.{key}, r.i, h.s from (select distinct {key}
      from {src}) k cross join (select unnest(range(64)) as i) r left join (select {key}, h % 64 as i, sum(case when h % 2
      = 1 then 1 else -1 end) as s from (select {key}, cast(concat('0x', substr(sha256(w), 1, 8)) as bigint) as h from
      (select {key}, unnest({_WORDS(text)}) as w from {src}) a) b group by 1, 2) h on h.{key} = k.{key} and h.i = r.i) x
      group by 1"""


cte("cvec", ["chs"], _hash_sql("chs", "chunk_id", "text"))
cte("qvec", ["qs"], _hash_sql("qs", "query_id", "query"))
cte("sims", ["chs", "qs", "cvec", "qvec"], """select q.*, c.chunk_id, c.access_level, c.plant, c.status, case when
    len(list_filter(qv.v, lambda z: z <> 0)) > 0 and len(list_filter(cv.v, lambda z: z <> 0)) > 0 then round(coalesce(
    list_cosine_similarity(cast(cv.v as double[]), cast(qv.v as double[])), 0), 9) + 0 else 0 end as score from qs q join
    qvec qv using (query_id) cross join chs c join cvec cv on cv.chunk_id = c.chunk_id""")
_RANK = "row_number() over (partition by query_id order by score desc, chunk_id)"
cte("vrank", ["sims"], f"select query_id, chunk_id, score, {_RANK} as rank from sims where {_VIS}")
cte("brank", ["bm"], f"select *, {_RANK} as rank from bm")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round(F.col("score") + 1e-10, 6).alias("score"),
                     F.col("rank").cast("bigint").alias("rank"))


# scores were cut at nine decimals; the nudge keeps the second rounding off a tie
_OUT = "query_id, chunk_id, round(score + cast(1e-10 as double), 6) as score, cast(rank as bigint) as rank"


@query("f04_row_level_access", ["chs", "ctxs"], f"""select role, coalesce(asker_plant, '-') as asker_plant, access_level,
    cast(count(*) as bigint) as chunks from (select distinct role, asker_plant from ctxs) x join chs on {_SEE} group by all""")
def row_level_access(spark: SparkSession, d: str) -> DataFrame:
    askers = questions(spark, d).select("role", "asker_plant").distinct()
    classes = chunks(spark, d).groupBy("access_level", "plant").agg(F.count(F.lit(1)).alias("n"))
    seen = askers.join(classes, rt.permits(*map(F.col, ("access_level", "plant", "role", "asker_plant"))))
    return seen.groupBy("role", F.coalesce("asker_plant", F.lit("-")).alias("asker_plant"), "access_level").agg(
        F.sum("n").alias("chunks"))


@query("f05_status_filter", ["qs", "chs"], """select query_id, history, cast((select count(*) from chs where status in
    ('current', 'expired') or qs.history) as bigint) as chunks from qs""")
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    by_status = chunks(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return questions(spark, d).join(by_status, rt.in_force(F.col("status"), F.col("history"))).groupBy(
        "query_id", "history").agg(F.sum("n").alias("chunks"))


@query("r02_tokens", ["ctoks"], """select chunk_id, cast(len(toks) as integer) as tokens, cast(len(list_distinct(toks)) as
    integer) as terms from ctoks""")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    t = rt.tokens(F.col("text"))
    return chunks(spark, d).select("chunk_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("terms"))


@query("r03_bm25", ["brank"], f"select {_OUT} from brank where rank <= 6")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return _out(bm25_top(spark, d))


@query("r15_pruned_top_k", ["brank"], f"select {_OUT} from brank where rank <= 6")
def pruned_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The same from bounds of posting blocks, without the lists of all matches."""
    return _out(lx.bm25_top(lexical(spark, d), questions(spark, d), rt.TOP_K, _store(spark, d)))


@query("w13_rank_lists", ["brank"], f"select {_OUT} from brank")
def rank_lists(spark: SparkSession, d: str) -> DataFrame:
    return _out(rt.ranked(bm25_scores(spark, d)))


_BI = lambda t: (f"list_concat({t}, list_transform(range(1, len({t})), lambda i: concat({t}[i], ' ', {t}[i + 1])))")


@query("r04_tfidf", ["ctoks", "qs", "ctxs", "pool"], f"""with g as (select chunk_id, access_level, plant, status, term,
    count(*) as tf from (select chunk_id, access_level, plant, status, unnest({_BI('toks')}) as term from ctoks) a group by
    all), vis as (select ctx, g.* from ctxs join g on {_VIS}), idf as (select ctx, term, ln((1 + n) / (1 + count(*))) + 1 as
    idf from vis join pool using (ctx) group by ctx, term, n), w as (select ctx, chunk_id, term, (1 + ln(tf)) * idf as w
    from vis join idf using (ctx, term)), nm as (select ctx, chunk_id, sqrt(sum(w * w)) as norm from w group by 1, 2),
    qg as (select query_id, ctx, term, count(*) as tf from (select query_id, ctx, unnest({_BI('qt')}) as term from (select
    *, {_TOK('query')} as qt from qs) b) c group by all), qw as (select query_id, ctx, term, (1 + ln(tf)) * idf as w from qg
    join idf using (ctx, term)), qn as (select query_id, sqrt(sum(w * w)) as norm from qw group by 1),
    s as (select q.query_id, w.chunk_id, round(sum(q.w * w.w) / (nm.norm * qn.norm), 9) as score from qw q join w on w.ctx =
    q.ctx and w.term = q.term join nm on nm.ctx = w.ctx and nm.chunk_id = w.chunk_id join qn on qn.query_id = q.query_id
    group by q.query_id, w.chunk_id, nm.norm, qn.norm) select {_OUT} from (select *, {_RANK} as rank from s) z where rank <= 6""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _out(rt.top_k(rt.tfidf(chunks(spark, d), questions(spark, d))))


@query("r11_hashing_vectors", ["cvec"], """select chunk_id, cast(i as integer) as dim, round(x / sqrt(list_sum(
    list_transform(cast(v as double[]), lambda z: z * z))), 6) as value from (select chunk_id, v, unnest(v) as x,
    unnest(range(64)) as i from cvec) a where x <> 0""")
def hashing(spark: SparkSession, d: str) -> DataFrame:
    v = rt.hashing_vectors(chunks(spark, d), "chunk_id", "text")
    return v.select("chunk_id", F.posexplode("vector").alias("dim", "value")).where("value <> 0").withColumn(
        "value", F.round("value", 6))


@query("r05_vector_ranking", ["vrank"], f"select {_OUT} from vrank where rank <= 20")
def vector_ranking(spark: SparkSession, d: str) -> DataFrame:
    c, q = vectors(spark, d)
    return _out(rt.vector_topk(rt.require_vectors(c, q), q, k=20))


@query("r06_rank_fusion", ["brank", "vrank"], f"""select query_id, chunk_id, round(score, 6) as score, cast(rank as bigint)
    as rank from (select *, {_RANK} as rank from (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) as score from
    (select query_id, chunk_id, rank from brank union all select query_id, chunk_id, rank from vrank) u group by 1, 2) f) z
    where rank <= 6""")
def fusion(spark: SparkSession, d: str) -> DataFrame:
    c, q = vectors(spark, d)
    ix = lx.prepared(lexical(spark, d), q)
    return _out(rt.hybrid(rt.require_vectors(c, q), q, lambda n: lx.bm25_best(ix, q, n), lambda pairs: lx.bm25_ranks(ix, q, pairs)))


@query("t01_top_k", ["vrank"], "select query_id, chunk_id, cast(rank as bigint) as rank from vrank where rank <= 6")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return rt.vector_topk(*vectors(spark, d), k=rt.TOP_K).select("query_id", "chunk_id", F.col("rank").cast("bigint")
                                                               .alias("rank"))


@query("r08_access_gate", ["sims"], f"""select query_id, chunk_id, not {_SEE} as refuse from (select *, {_RANK} as rank from
    sims where status <> 'superseded') x where rank = 1""")
def access_gate(spark: SparkSession, d: str) -> DataFrame:
    return rt.access_gate(*vectors(spark, d))


@query("r09_similarity_floor", ["vrank"], """select query_id, round(score + cast(1e-10 as double), 6) as score, score < 0.1 as refuse from vrank where
    rank = 1""")
def floor(spark: SparkSession, d: str) -> DataFrame:
    return rt.floor_gate(rt.vector_topk(*vectors(spark, d), k=1)).withColumn("score", F.round(F.col("score") + 1e-10, 6))


# ---- the embeddings table: one vector per text hash ----------------------------------------------------------

cte("store", ["chs"], """select text_sha256, min_by(embedding, vec_id) as embedding from (select sha256(c.text) as
    text_sha256, e.vec_id, e.embedding from embeddings e join chs c on c.doc_id = cast(e.vec_id as varchar)) x group by 1""")
cte("hashed", ["chs"], "select chunk_id, doc_id, sha256(text) as text_sha256 from chs")


def store(spark: SparkSession, d: str) -> DataFrame:
    e = dt.table(spark, d, "embeddings").withColumn("doc_id", F.col("vec_id").cast("string"))
    keyed = e.join(chunks(spark, d).select("doc_id", F.sha2("text", 256).alias("text_sha256")), "doc_id")
    return keyed.groupBy("text_sha256").agg(F.min_by("embedding", "vec_id").alias("vector"))


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).withColumn("text_sha256", F.sha2("text", 256))


@query("j16_vectors_by_content", ["hashed", "store"], """select chunk_id, cast(len(embedding) as integer) as dims,
    round(cast(embedding[1] as double), 6) as first from hashed join store using (text_sha256)""")
def vectors_by_content(spark: SparkSession, d: str) -> DataFrame:
    return hashed(spark, d).join(store(spark, d), "text_sha256").select(
        "chunk_id", F.size("vector").alias("dims"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("u04_missing_vectors", ["hashed", "store"], """select chunk_id, text_sha256 from hashed where text_sha256 not in
    (select text_sha256 from store)""")
def missing(spark: SparkSession, d: str) -> DataFrame:
    return rt.missing_vectors(hashed(spark, d), store(spark, d)).select("chunk_id", "text_sha256")


@query("j17_exact_vector_scan", [], """with c as (select label, list(m order by i) as v from (select label, i, avg(x) as m
    from (select label, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as i from embeddings) a
    group by 1, 2) b group by 1), s as (select cast(c.label as varchar) as query_id, lpad(cast(vec_id as varchar), 12, '0')
    as chunk_id, round(list_cosine_similarity(cast(embedding as double[]), v), 9) as score from embeddings cross join c)
    select query_id, chunk_id, round(score + cast(1e-10 as double), 6) as score, cast(rank as bigint) as rank from (select *, row_number() over
    (partition by query_id order by score desc, chunk_id) as rank from s) z where rank <= 10""")
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """Nearest stored vectors to the centroid of each label."""
    e = dt.table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_v")).select(
        F.col("label").cast("string").alias("query_id"), F.transform("_v", lambda s: s["m"]).alias("vector"),
        F.lit("leadership").alias("role"), F.lit(None).cast("string").alias("asker_plant"), F.lit(True).alias("history"))
    pool = e.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), F.lit("all").alias("access_level"),
                    F.lit(None).cast("string").alias("plant"), F.lit("current").alias("status"),
                    F.col("embedding").cast("array<double>").alias("vector"))
    return _out(rt.vector_topk(pool, centre, 10))


@query("u03_chunk_sync", ["hashed"], """with old as (select distinct cast(doc_id as varchar) as doc_id, case when doc_id % 5 = 0
    then 'older text' end as text from labels), o as (select old.doc_id, coalesce(old.text, h.text_sha256, 'gone') as sha from old
    left join hashed h on h.doc_id = old.doc_id), j as (select o.doc_id as a, h.doc_id as b, o.sha, h.text_sha256 from o full join
    hashed h on h.doc_id = o.doc_id) select 'removed' as change, cast(count(*) filter (where b is null) as bigint) as n from j
    union all select 'added', cast(count(*) filter (where a is null) as bigint) from j union all select 'updated', cast(count(*)
    filter (where a is not null and b is not null and sha <> text_sha256) as bigint) from j union all select 'kept', cast(count(*)
    filter (where sha = text_sha256) as bigint) from j union all select 'before', cast(count(a) as bigint) from j union all select
    'after', cast(count(b) as bigint) from j""")
def chunk_sync(spark: SparkSession, d: str) -> DataFrame:
    """The index of the labelled documents, some with an older text, brought up to the corpus of today. `before` is counted
    afterwards, by a reader that holds on to the version of before."""
    now = hashed(spark, d).select("doc_id", "text_sha256")
    ids = dt.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    old = ids.join(now, "doc_id", "left").select("doc_id", F.when(F.col("doc_id").cast("bigint") % 5 == 0, "older text").otherwise(
        F.coalesce("text_sha256", F.lit("gone"))).alias("text_sha256"))
    index = IndexStore(spark, fresh_path(spark, "chunk-index"), "doc_id string, text_sha256 string", "doc_id")
    first = index.sync(old)
    second = index.sync(now)
    before, after = index.read(first.version).count(), index.read().count()
    rows = [("removed", second.deleted), ("added", second.inserted), ("updated", second.updated),
            ("kept", after - second.inserted - second.updated), ("before", before), ("after", after)]
    return spark.createDataFrame(rows, "change string, n bigint")


_LEAVES = "(select sha256(concat(doc_id, ':', text_sha256)) as leaf, doc_id, text_sha256 from hashed)"


@query("r10_corpus_hash", ["hashed"], f"""with leaves as {_LEAVES}, b as (select left(leaf, 5) as node, sha256(string_agg(leaf, ''
    order by leaf)) as digest from leaves group by 1), c as (select left(node, 3) as node, sha256(string_agg(concat(node, digest),
    '' order by node)) as digest from b group by 1), e as (select left(node, 1) as node, sha256(string_agg(concat(node, digest), ''
    order by node)) as digest from c group by 1), old as (select left(sha256(concat(doc_id, ':', t)), 5) as node, sha256(string_agg(
    sha256(concat(doc_id, ':', t)), '' order by sha256(concat(doc_id, ':', t)))) as digest from (select doc_id, case when
    cast(doc_id as bigint) % 100 = 3 then 'older text' else text_sha256 end as t from hashed where cast(doc_id as bigint) % 50 <> 7)
    o group by 1) select (select sha256(string_agg(concat(node, digest), '' order by node)) from e) as corpus_sha256, (select
    cast(count(*) as bigint) from hashed) as chunks, (select cast(count(*) as bigint) from b full join old on b.node = old.node where
    b.digest is distinct from old.digest) as stale""")
def corpus_hash(spark: SparkSession, d: str) -> DataFrame:
    """The corpus digest, and in how many places an index of before some texts came and others changed differs from it."""
    now = hashed(spark, d).select(F.col("doc_id").alias("path"), "text_sha256")
    n = F.col("path").cast("bigint")
    old = now.where(n % 50 != 7).withColumn("text_sha256", F.when(n % 100 == 3, "older text").otherwise(F.col("text_sha256")))
    held = fresh_path(spark, "held-buckets")
    knowledge.buckets(old).write.parquet(held)
    stale = knowledge.stale_buckets(spark.read.parquet(held), now).agg(F.count(F.lit(1)).alias("stale"))
    return knowledge.corpus_digest(now).crossJoin(F.broadcast(stale))  # one row each


@query("r01_section_chunks")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = dt.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), "doc_id").alias("title"),
        F.col("text").alias("body"))
    return rt.chunk_documents(docs).select("chunk_id", "doc_id", "section", F.length("text").alias("n_chars"),
                                           F.size(F.split(F.trim("text"), r"\s+")).alias("words"))


# Rules over documents of the corpus: the first two share a document, so the second sees what the first brought in.
RULES = [(1, "11", "12", "deadlines", ["the", "der"]), (2, "12", "40", "amounts", ["an", "und"]), (3, "3", "11", "signatures", ["de"])]
RULE_SCHEMA = "rule_no int, winner string, loser string, topic string, terms array<string>"


@query("r07_declared_precedence")
def precedence(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks with declared precedences applied in order, and status notes. Of all chunks only those of the rules'
    documents are scored beside the best."""
    c, q, ix = chunks(spark, d), questions(spark, d), lexical(spark, d)
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    note = rt.status_note(F.col("status"), F.lit("a later version"), F.lit("an earlier date")).alias("status_note")
    shown = c.select("chunk_id", "doc_id", "text", note)
    ruled = shown.join(F.broadcast(rules.select(F.explode(F.array("winner", "loser")).alias("doc_id")).distinct()), "doc_id")
    of_rules = lx.bm25(lx.narrowed(ix, ruled), q).withColumn("rank", -F.round("score", 9))  # an order like the rank's
    top = bm25_top(spark, d).withColumn("rank", -F.col("score"))
    column = lambda df, of: df.join(of, "chunk_id").select("query_id", "chunk_id", "doc_id", "text", "rank", "status_note")
    found = rt.precedence(column(of_rules, ruled), column(top, shown), rules)
    return found.select("query_id", F.col("position").cast("bigint").alias("position"), "chunk_id",
                        F.array_join("notes", " ").alias("notes"))


@query("r12_boilerplate_filter")
def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", "doc_type")
    hits = rt.vector_topk(*vectors(spark, d), k=20).join(c, "chunk_id")
    return rt.drop_boilerplate(hits.select("query_id", "chunk_id", "doc_type", "score", "rank")).withColumn(
        "score", F.round("score", 6))


@query("r13_restricted_search", ["bm", "chs"], """select doc_type, query_id, chunk_id, round(score + cast(1e-10 as double), 6) as
    score, cast(rank as bigint) as rank from (select b.*, doc_type, row_number() over (partition by query_id, doc_type order by score
    desc, chunk_id) as rank from bm b join chs using (chunk_id)) z where rank <= 5""")
def restricted_search(spark: SparkSession, d: str) -> DataFrame:
    """Search narrowed to each document type, scored by the whole permitted pool."""
    ix, q = lexical(spark, d), questions(spark, d)
    types = chunks(spark, d).select("chunk_id", "doc_type")
    part = types.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("doc_type", F.lit("\u0001")))), "|").alias(
        "part"))
    scores = lx.bm25_best(ix, q, 5, part).join(types, "chunk_id")
    order = Window.partitionBy("query_id", "doc_type").orderBy(F.desc("score"), "chunk_id")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)
    return _out(best.withColumn("query_id", F.struct("doc_type", "query_id"))).select(
        "query_id.doc_type", "query_id.query_id", "chunk_id", "score", "rank")


@query("a34_document_rollup", ["chs"], """select doc_id, doc_type, status, access_level, plant, cast(count(*) as bigint) as chunks from
    chs group by all union all select null, 'prior_resolution', null, null, null, cast(count(*) as bigint) from labels where toxic
    = 1""")
def document_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the knowledge base; labels of toxic texts stand for prior resolutions."""
    from tallyline.operators.ops import knowledge_documents

    columns = ["doc_id", "doc_type", "status", "access_level", "plant"]
    prior = dt.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("R"), "doc_id").alias("doc_id"), F.lit(
        "prior_resolution").alias("doc_type"))
    return knowledge_documents(chunks(spark, d).select(*columns).unionByName(prior, allowMissingColumns=True))


# ---- answers and their scores --------------------------------------------------------------------------------
# An assistant turn is the answer to the user turn before it; it cites the three chunks ranked first and, every third
# time, one nobody retrieved.

_CITED = """(select query_id, list(chunk_id order by rank) as retrieved, case when cast(string_split(query_id, '-')[1] as
    bigint) % 3 = 0 then list_concat(list(chunk_id order by rank)[1:3], ['D-none']) else list(chunk_id order by rank)[1:3] end
    as cited from brank where rank <= 6 group by 1)"""


@query("r14_citation_validity", ["brank"], f"""select query_id, array_to_string(list_filter(cited, lambda c: not
    list_contains(retrieved, c)), ',') as unknown, len(cited) > 0 and len(list_filter(cited, lambda c: not list_contains(
    retrieved, c))) = 0 as valid, cast(len(list_filter(cited, lambda c: list_contains(retrieved, c))) as integer) as
    cited_docs from {_CITED} x""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators.evaluate import citation_check

    hits = bm25_top(spark, d)
    per = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))),
                                                   lambda h: h["chunk_id"]).alias("retrieved"))
    stray = F.split("query_id", "-")[0].cast("bigint") % 3 == 0
    cited = F.slice("retrieved", 1, 3)
    return citation_check(per.withColumn("citations", F.when(stray, F.concat(cited, F.array(F.lit("D-none")))).otherwise(
        cited))).select("query_id", F.array_join("unknown", ",").alias("unknown"), "valid",
                        F.size("cited_docs").alias("cited_docs"))


_LAB = """select b.query_id, qs.role as challenge, bool_or(l.quality = 1) as doc_hit, cast(count(*) filter (where l.toxic = 1)
    as bigint) as forbidden, bool_or(l.toxic = 1) and qs.role = 'analyst' as exposure from brank b join qs using (query_id)
    left join chs c using (chunk_id) left join (select cast(doc_id as varchar) as doc_id, max(quality) as quality, max(toxic)
    as toxic from labels group by 1) l using (doc_id) where rank <= 6 group by 1, 2"""


@query("e06_retrieval_recall", ["brank", "qs", "chs"], f"""select q.role as challenge, 'bm25' as mode, cast(count(*) as bigint) as
    questions, cast(count(*) filter (where doc_hit) as bigint) as doc_hits, cast(coalesce(sum(forbidden), 0) as bigint) as
    forbidden_retrieved, cast(count(*) filter (where exposure) as bigint) as exposures from qs q left join ({_LAB}) x
    using (query_id) group by 1""")
def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    """Quality labels stand for expected documents, toxic labels for forbidden ones."""
    from tallyline.operators.evaluate import retrieval_score

    q = questions(spark, d)
    labels = dt.table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(
        F.max("quality").alias("expected"), F.max("toxic").alias("forbidden"))
    hits = bm25_top(spark, d).join(chunks(spark, d).select("chunk_id", "doc_id"), "chunk_id")
    asked = q.select("query_id", F.col("role").alias("challenge"), (F.col("role") == "analyst").alias("should_refuse"))
    return retrieval_score(hits.withColumn("mode", F.lit("bm25")), asked, labels)


@query("e07_answer_verdicts", [], """with a as (select u.conv_id, u.turn, u.role as r0, min(u.text) as question, min(x.text) as
    answer from conversations u left join conversations x on x.conv_id = u.conv_id and x.turn = u.turn + 1 and x.role =
    'assistant' where u.role = 'user' group by 1, 2, 3), v as (select *, case when conv_id % 5 = 0 then case when answer is
    null then 'correct_refusal' when conv_id % 10 = 0 then 'leak' else 'answered_unanswerable' end when answer is null then
    'over_refusal' when contains(lower(nfc_normalize(answer)), 'e') and not contains(lower(nfc_normalize(answer)), 'zq') then
    'correct' else 'wrong_answer' end as verdict from a) select verdict, cast(count(*) as bigint) as n from v group by 1""")
def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators.evaluate import verdicts

    t = dt.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    user = t.where("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("question"))
    reply = t.where("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(
        F.min("text").alias("answer"))
    asked = user.join(reply, ["conv_id", "turn"], "left").select(
        "conv_id", F.col("answer").isNotNull().alias("answered"), F.coalesce("answer", F.lit("")).alias("answer"),
        (F.col("conv_id") % 5 == 0).alias("should_refuse"), (F.col("conv_id") % 10 == 0).alias("has_forbidden_docs"),
        F.array(F.lit("E")).alias("must_contain"), F.array(F.lit("ZQ")).alias("must_not_contain"))
    return verdicts(asked).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
