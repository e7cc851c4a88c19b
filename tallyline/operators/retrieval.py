"""Permission-filtered ranking of text: BM25, TF-IDF, vectors, and their reciprocal-rank fusion.

Chunks: chunk_id, doc_id, text, access_level, plant, status. Questions: query_id, query, role, asker_plant,
history. What an asker may not see contributes nothing, term statistics included, so every statistic is held per
access class (level, plant, status) and added up over the classes a context (role, plant, history) may see.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import strip
from tallyline.operators import blocks
from tallyline.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 6
RRF_K = 60
K1, B = 1.5, 0.75
DIMENSIONS = 64
SIMILARITY_FLOOR = 0.10
QUESTION_BLOCK, CHUNK_BLOCK = 8192, 65536  # questions and chunks a task multiplies
STRIP = 64  # questions it multiplies at a time
# The token pattern, the words left out, and the version mention that opens history.
TOKEN = r"[a-z0-9]+(?:[.%][0-9]+%?)?"
VERSION_MENTION = r"(?i)\b(?:version|v)\s*\d+(?:\.\d+)?\b"
STOP_WORDS = """
a about above again against am an and are as at be because been being below between both but by can could did do
does doing down during each for from further had has have having he her here hers him his how i if in into is it its
itself just me my of off on once or other our ours out over own same she should so some such than that the their theirs
them then there these they this those through to too under until up very was we were what when where which while who whom
why will with would you your yours
""".split()
CLASS = ["access_level", "plant", "status"]
CONTEXT = ["role", "asker_plant", "history"]


def permits(level: Column, plant: Column, role: Column, asker_plant: Column) -> Column:
    """all: everyone; restricted: leadership and data owners; plant: leadership, and that plant's own users."""
    return ((level == "all") | ((level == "restricted") & role.isin("leadership", "data_owner"))
            | ((level == "plant") & ((role == "leadership") | F.coalesce(
                (role == "plant_user") & (plant == asker_plant), F.lit(False)))))


def wants_history(query: Column) -> Column:
    return query.rlike(VERSION_MENTION)


def in_force(status: Column, history: Column) -> Column:
    """Superseded chunks only for a question about a version."""
    return status.isin("current", "expired") | (history & (status == "superseded"))


def visible() -> Column:
    return permits(F.col("access_level"), F.col("plant"), F.col("role"), F.col("asker_plant")) & in_force(
        F.col("status"), F.col("history"))


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def grams(text: Column) -> Column:
    """Tokens and neighbouring pairs."""
    words = tokens(text)
    pairs = F.when(F.size(words) > 1, F.zip_with(
        F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def postings(chunks: DataFrame, terms) -> DataFrame:  # noqa: ANN001
    """How often each term occurs in each chunk, with the chunk's access class."""
    return chunks.select("chunk_id", *CLASS, F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "chunk_id", *CLASS, "term").agg(F.count(F.lit(1)).alias("tf"))


def contexts(questions: DataFrame) -> DataFrame:
    return questions.select(*CONTEXT).distinct()


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that matches NULL plants."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def pool_statistics(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Per context: chunks it may see and their mean length in tokens."""
    classes = chunks.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size(tokens(F.col("text")))).alias("_l"))
    return contexts(questions).join(classes, visible()).groupBy(*CONTEXT).agg(
        F.sum("_n").alias("pool"), (F.sum("_l") / F.sum("_n")).alias("mean_length"))


def bm25(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, chunk_id, score > 0. Postings meet question terms in one equi join on the term."""
    asked = questions.select("query_id", *CONTEXT, F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    tf = postings(chunks, tokens).join(asked.select("term").distinct(), "term", "left_semi")
    by_class = tf.groupBy(*CLASS, "term").agg(F.count(F.lit(1)).alias("_df"))
    frequency = asked.select(*CONTEXT, "term").distinct().join(by_class, "term").where(visible()).groupBy(
        *CONTEXT, "term").agg(F.sum("_df").alias("df"))
    weights = _null_safe(frequency, pool_statistics(chunks, questions), CONTEXT).withColumn(
        "idf", F.log1p((F.col("pool") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # the weight rides on the question's term, so postings are joined once
    weighted = _null_safe(asked, weights.withColumnRenamed("term", "_term"), CONTEXT).where(
        F.col("term") == F.col("_term")).drop("_term")
    lengths = chunks.select("chunk_id", F.size(tokens(F.col("text"))).alias("length"))
    hit = tf.join(weighted, "term").where(visible()).join(lengths, "chunk_id")
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def tfidf(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, chunk_id, cosine > 0 over uni- and bigrams with weights fitted on the asker's pool."""
    tf = postings(chunks, grams)
    seen = contexts(questions)
    frequency = tf.groupBy(*CLASS, "term").agg(F.count(F.lit(1)).alias("_df")).join(seen, visible()).groupBy(
        *CONTEXT, "term").agg(F.sum("_df").alias("df"))
    pools = pool_statistics(chunks, questions).drop("mean_length")
    idf = _null_safe(frequency, pools, CONTEXT).select(
        *CONTEXT, "term", (F.ln((1 + F.col("pool")) / (1 + F.col("df"))) + 1).alias("idf"))
    plant = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  a key for the equi joins below
    idf = idf.withColumn("ctx", F.concat_ws("|", "role", plant(F.col("asker_plant")), "history"))
    weight = (1 + F.ln("tf")) * F.col("idf")
    docs = tf.join(idf, "term").where(visible()).select("ctx", "chunk_id", "term", weight.alias("w"))
    norms = docs.groupBy("ctx", "chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = questions.withColumn("ctx", F.concat_ws("|", "role", plant(F.col("asker_plant")), "history")).select(
        "query_id", "ctx", F.explode(grams(F.col("query"))).alias("term")).groupBy("query_id", "ctx", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    asked = q.join(idf.select("ctx", "term", "idf"), ["ctx", "term"]).select("query_id", "ctx", "term", weight.alias("qw"))
    qnorm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = asked.join(docs, ["ctx", "term"]).groupBy("query_id", "ctx", "chunk_id").agg(
        F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(norms, ["ctx", "chunk_id"]).join(qnorm, "query_id").select(
        "query_id", "chunk_id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


# ---- vectors -------------------------------------------------------------------------------------------------

def hashing_vectors(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Signed feature hashing: each word adds +1 or -1 to one dimension; the vector has length one."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    h = F.conv(F.substring(F.sha2("w", 256), 1, 8), 16, 10).cast("bigint")
    # added up by dimension in the task that reads the text: at most a row for each dimension of a text is sent
    added = words.select(key, h.alias("h")).groupBy(key, (F.col("h") % dimensions).alias("_d")).agg(
        F.sum(F.when(F.col("h") % 2 == 1, 1).otherwise(-1)).alias("_s"))
    sums = added.groupBy(key).agg(*[F.sum(F.when(F.col("_d") == i, F.col("_s")).otherwise(0)).cast("double").alias(f"_{i}")
                                    for i in range(dimensions)])
    norm = F.sqrt(sum((F.col(f"_{i}") * F.col(f"_{i}") for i in range(1, dimensions)), F.col("_0") * F.col("_0")))
    vector = F.array(*[F.coalesce(F.try_divide(F.col(f"_{i}"), F.col("_norm")), F.lit(0.0)) for i in range(dimensions)])
    return sums.withColumn("_norm", norm).select(key, vector.alias("vector"))


def _distinct(df: pd.DataFrame | dict[str, list], columns: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The distinct rows of some columns, and which of them each row is."""
    found: dict[tuple, int] = {}
    at = [found.setdefault(row, len(found)) for row in zip(*(df[c] for c in columns), strict=True)]
    return list(found), np.array(at, dtype=int)


def _may(askers: list[tuple], classes: list[tuple]) -> np.ndarray:
    """askers x classes: may this asker see chunks of this class."""
    def may(role, own, history, level, plant, status) -> bool:  # noqa: ANN001
        open_ = level == "all" or (level == "restricted" and role in ("leadership", "data_owner"))
        local = level == "plant" and (role == "leadership" or (role == "plant_user" and plant == own))
        return (open_ or local) and (status != "superseded" or bool(history))

    return np.array([[may(*a, *c) for c in classes] for a in askers], dtype=bool)


def _allowed(q: pd.DataFrame, pdf: pd.DataFrame) -> np.ndarray:
    """questions x chunks: may this asker see this chunk. Judged once for each access class and context."""
    (askers, row), (classes, column) = _distinct(q, CONTEXT), _distinct(pdf, CLASS)
    return _may(askers, classes)[row][:, column]


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest finite values of each row, ties to the earlier column. Found by partition: a row is not
    sorted as a whole."""
    kept = np.isfinite(scores)
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        kept &= scores >= least
        for i in np.nonzero(kept.sum(axis=1) > k)[0]:  # too many at the least value: the earlier ones
            equal = np.nonzero(kept[i] & (scores[i] == least[i]))[0]
            kept[i, equal[k - int((kept[i] & (scores[i] > least[i])).sum()):]] = False
    return np.nonzero(kept)


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of length one, or zero."""
    flat = vectors.combine_chunks()
    if flat.null_count:
        raise ValueError(f"rows without a vector: {flat.null_count}")
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _packed(rows: pa.Table) -> list[pa.Table]:
    """The block's rows but for the vectors, and these as rows of length one."""
    units = _unit(rows["vector"])
    return [rows.drop_columns(["vector"]), pa.table({"vector": pa.FixedSizeListArray.from_arrays(pa.array(units.ravel()), max(1, units.shape[1]))})]


def _packed_in_order(rows: pa.Table) -> list[pa.Table]:
    return _packed(rows.sort_by("chunk_id"))  # rows without an id last


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["vector"].combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _groups(q: pa.Table, docs: pa.Table, filtered: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of questions that see the same chunks, with these chunks' rows."""
    if not filtered:
        yield np.arange(len(q)), np.arange(len(docs))
        return
    (askers, row), (classes, column) = (_distinct({n: t[n].to_pylist() for n in names}, names) for t, names in (
        (q, CONTEXT), (docs, CLASS)))
    for a, seen in enumerate(_may(askers, classes)):
        yield np.nonzero(row == a)[0], np.nonzero(seen[column])[0]


def _nearest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of the k largest values of each row at nine decimals, ties to the earlier column.

    The k-th largest of the maxima of groups of columns is a floor under the k-th largest value: k columns reach it.
    """
    n = sims.shape[1]
    wide = min(64, n // (4 * k))
    if wide > 1:
        tops = sims[:, :n - n % wide].reshape(len(sims), -1, wide).max(axis=2)
        least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
    else:
        least = np.partition(sims, n - k, axis=1)[:, n - k] if n > k else np.full(len(sims), -np.inf)
    row, column = np.nonzero(sims >= (least - 2e-9)[:, None])  # with what rounding can lift to the k-th place
    found = np.round(sims[row, column], 9) + 0.0  # equal texts must tie exactly, whatever block they are multiplied in
    order = np.lexsort((column, -found, row))
    row, column, found = row[order], column[order], found[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept], found[kept]


def _by_blocks(chunks: DataFrame, questions: DataFrame, work, result: str, more: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """`work` on every block of questions, with the columns `more` has for them, and every block of chunks. Blocks are dealt out by hash, so a task's memory is set by
    the block sizes at any number of questions or chunks."""
    across = blocks.number(chunks.count(), CHUNK_BLOCK)
    down = blocks.spread_number(questions, questions.count(), QUESTION_BLOCK, across)
    asked = questions.select("query_id", *CONTEXT, "vector")
    left = blocks.packed(asked if more is None else asked.join(more, "query_id"), F.col("query_id"), down, _packed, ["_q", "_qv"])
    right = blocks.packed(chunks.select("chunk_id", *CLASS, "vector"), F.col("chunk_id"), across, _packed_in_order, ["_c", "_cv"])
    return blocks.crossed(left, right, (down, across), work, result)


def vector_topk(chunks: DataFrame, questions: DataFrame, k: int, filtered: bool = True) -> DataFrame:
    """Exact nearest chunks per question: query_id, chunk_id, score, rank (similarity, then id).

    A block of chunks sends on its k best per question of a block, so neither all pairs nor a whole question's list ever
    exists. `chunks` and `questions` carry vector.
    """
    def best(q: pa.Table, qv: pa.Table, docs: pa.Table, cv: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, units = _matrix(qv), _matrix(cv)
        names, ids = q["query_id"].combine_chunks(), docs["chunk_id"].combine_chunks()
        odd = not (np.isfinite(asked).all() and np.isfinite(units).all())
        for rows, columns in _groups(q, docs, filtered):
            mine = units if len(columns) == len(units) else units[columns]
            for low in range(0, len(rows) if len(columns) else 0, STRIP):
                some = rows[low: low + STRIP]
                sims = asked[some] @ mine.T
                if odd:
                    sims[~np.isfinite(sims)] = -np.inf
                row, column, score = _nearest(sims, k)
                row, column, score = (x[np.isfinite(score)] for x in (row, column, score))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(some[row])).cast(pa.string()), ids.take(pa.array(
                    columns[column])).cast(pa.string()), pa.array(score)], names=["query_id", "chunk_id", "score"])

    found = _by_blocks(chunks, questions, best, "query_id string, chunk_id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_ranks(chunks: DataFrame, questions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact rank of chosen (query_id, chunk_id) pairs, a bounded number per question, in the whole permitted pool.

    A rank is one plus the number of chunks that beat the pair, counted per block of chunks and added up.
    """
    mine = wanted.join(chunks.select("chunk_id", "vector"), "chunk_id").join(
        questions.select("query_id", F.col("vector").alias("_qv")), "query_id")
    dot = F.aggregate(F.zip_with("vector", "_qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    score = F.round(F.coalesce(F.try_divide(dot, length("vector") * length("_qv")), F.lit(0.0)), 9)
    asked = mine.groupBy("query_id").agg(F.collect_list("chunk_id").alias("_ids"), F.collect_list(score).alias("_scores"))

    def beaten(q: pa.Table, qv: pa.Table, docs: pa.Table, cv: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, units = _matrix(qv), _matrix(cv)
        ids, marks = q["_ids"].combine_chunks(), q["_scores"].combine_chunks().flatten().to_numpy()
        ends, names = np.append(0, np.cumsum(ids.value_lengths().to_numpy())), ids.flatten()
        all_ids, behind = np.array(docs["chunk_id"].to_pylist(), dtype=object), np.zeros(len(names), dtype=np.int64)
        for rows, columns in _groups(q, docs, True):
            mine, named = units[columns], all_ids[columns]
            named = named[[n is not None for n in named]]
            for low in range(0, len(rows), STRIP):
                some = rows[low: low + STRIP]
                sims = np.round(asked[some] @ mine.T, 9) + 0.0
                for i, s, rising in zip(some, sims, np.sort(sims, axis=1), strict=True):
                    c = marks[ends[i]:ends[i + 1]]
                    upto, above = np.searchsorted(rising, c, "left"), np.searchsorted(rising, c, "right")
                    behind[ends[i]:ends[i + 1]] = len(s) - above
                    for j in np.nonzero(above > upto)[0]:  # equal scores: the smaller ids are ahead
                        behind[ends[i] + j] += (s[:np.searchsorted(named, names[int(ends[i] + j)].as_py())] == c[j]).sum()
        asking = q["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(q)), np.diff(ends))))
        yield pa.RecordBatch.from_arrays([asking.cast(pa.string()), names.cast(pa.string()), pa.array(behind)],
                                         names=["query_id", "chunk_id", "ahead"])

    found = _by_blocks(chunks, questions, beaten, "query_id string, chunk_id string, ahead long", asked)
    return found.groupBy("query_id", "chunk_id").agg((F.sum("ahead") + 1).alias("rank"))


# ---- ranking and fusion --------------------------------------------------------------------------------------

def ranked(scores: DataFrame) -> DataFrame:
    """1-based rank per question by score, then id, of lists of any length.

    The scores are made once and sent once. A question's list is sorted in one task, on disk where it is long, and numbered as it
    is read; it is never held as a whole. A question without an id has no list.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.where("query_id is not null").withColumn("score", F.round("score", 9)).select(
        "query_id", "chunk_id", "score", F.row_number().over(order).cast("long").alias("rank"))


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best per question. Spark keeps k rows per question and partition before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k)


def fuse(lists: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists a chunk is in."""
    both = None
    for name, ranks in lists.items():
        part = ranks.select("query_id", "chunk_id", F.lit(name).alias("list"), "rank")
        both = part if both is None else both.unionByName(part)
    return both.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.map_from_entries(F.collect_list(F.struct("list", "rank"))).alias("ranks"))


def hybrid(chunks: DataFrame, questions: DataFrame, best, ranks, k: int = TOP_K) -> DataFrame:  # noqa: ANN001
    """The k best by BM25 and vectors fused, exactly. `best(n)` has the scores of the n best by BM25 and perhaps of more,
    `ranks(pairs)` the pairs' exact ranks in the list of all matches.

    Each list's first k chunks score at least 1/(60+k), and a chunk whose better rank is r at most 2/(60+r); so
    only chunks within rank 60+2k of either list can be among the k best. Those get their exact rank in the other.
    """
    depth = RRF_K + 2 * k
    near = vector_topk(chunks, questions, depth)
    candidates = materialise(top_k(best(depth), depth).select("query_id", "chunk_id").unionByName(
        near.select("query_id", "chunk_id")).distinct(), "candidates")
    return top_k(fuse({"bm25": ranks(candidates), "vector": vector_ranks(chunks, questions, candidates)}), k)


def access_gate(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Refuse where the single best non-superseded chunk of the whole index is one the asker may not see."""
    best = vector_topk(chunks.where("status <> 'superseded'"), questions, 1, filtered=False)
    j = best.join(chunks.select("chunk_id", *CLASS), "chunk_id").join(questions.select("query_id", *CONTEXT), "query_id")
    return j.select("query_id", "chunk_id", (~permits(
        F.col("access_level"), F.col("plant"), F.col("role"), F.col("asker_plant"))).alias("refuse"))


def floor_gate(best: DataFrame) -> DataFrame:
    """Refuse where even the best permitted similarity is below the floor (query_id, score of rank 1)."""
    return best.where("rank = 1").select("query_id", "score", (F.col("score") < SIMILARITY_FLOOR).alias("refuse"))


def missing_vectors(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose text has no stored vector (keyed by the text's hash)."""
    return chunks.join(store.select("text_sha256"), "text_sha256", "left_anti")


def status_note(status: Column, superseded_by: Column, effective: Column) -> Column:
    return F.when(status == "superseded", F.concat(
        F.lit("SUPERSEDED by "), superseded_by, F.lit(": kept for history only; not in force."))).when(
        status == "expired", F.concat(F.lit("EXPIRED: effective from "), effective, F.lit(
            " and no longer in force; it describes that past period only and must not be applied to later periods.")))


def require_vectors(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """The chunks that have a vector. The query fails when one without may be seen by any of the askers: a ranking that
    left it out would be incomplete. One nobody may see does no harm."""
    lost = chunks.where("vector is null").groupBy(*CLASS).agg(F.count(F.lit(1)).alias("_n"))
    hidden = contexts(questions).join(lost, visible()).agg(F.max("_n").alias("_lost"))
    told = F.assert_true(F.col("_lost").isNull(), F.concat(F.lit("permitted chunks without an embedding: "), F.col("_lost").cast(
        "string")))
    checked = chunks.where("vector is not null").crossJoin(F.broadcast(hidden))  # one row
    return checked.where(told.isNull()).drop("_lost")


def touches(text: Column, terms: Column) -> Column:
    """Whether a text holds any of an array of terms, whatever the case."""
    return F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def precedence(ranking: DataFrame, top: DataFrame, rules: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top k with the other side of declared precedences brought in, and notes on every chunk.

    `rules`: rule_no, winner, loser, topic, terms; a configuration table. `ranking`: query_id, chunk_id, doc_id, text, rank or
    any other order in `rank`, status_note, of all chunks of the rules' documents that the asker may see; `top`: the same of the
    k best. Rules are applied in order. When a chosen chunk of either document touches a rule's topic, the best touching chunk
    of each of the two that has none is brought in, for the lowest chosen one of neither; then chosen chunks that touch get
    the rule's note. Per question only the chosen ones and two chunks for each rule are held.
    """
    of_rule = lambda r: touches(F.col("text"), r["terms"])
    every = rules.agg(F.array_sort(F.collect_list(F.struct("rule_no", "winner", "loser", "topic", "terms"))).alias("_rules"))
    hit = F.struct("chunk_id", "doc_id", "rank", F.filter(F.array("status_note"), lambda n: n.isNotNull()).alias("notes"),
                   F.transform(F.filter("_rules", of_rule), lambda r: r["rule_no"]).alias("touches"))
    with_rules = lambda df: df.crossJoin(F.broadcast(every)).withColumn("_hit", hit)  # noqa: E731  one row
    chosen = with_rules(top).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "_hit"))).alias("_top"), F.first("_rules").alias("_rules"))
    mine = with_rules(ranking).withColumn("_rule", F.explode("_rules")).where(
        F.col("doc_id").isin(F.col("_rule.winner"), F.col("_rule.loser")) & F.array_contains("_hit.touches", F.col("_rule.rule_no")))
    extras = mine.groupBy("query_id", F.col("_rule.rule_no").alias("rule_no"), "doc_id").agg(
        F.min_by("_hit", F.struct("rank", "chunk_id")).alias("hit")).groupBy("query_id").agg(F.collect_list(
            F.struct("rule_no", "doc_id", "hit")).alias("_extras"))
    held = chosen.join(extras, "query_id", "left").select("query_id", F.transform("_top", lambda t: t["_hit"]).alias("_chosen"), F.coalesce(
        "_extras", F.array().cast(extras.schema["_extras"].dataType)).alias("_extras"), F.flatten(F.transform("_rules", lambda r: F.array(
            F.struct(r.alias("rule"), F.lit(0).alias("step"), r["winner"].alias("doc")),
            F.struct(r.alias("rule"), F.lit(1).alias("step"), r["loser"].alias("doc")),
            F.struct(r.alias("rule"), F.lit(2).alias("step"), F.lit("").alias("doc"))))).alias("_steps"))
    kind = held.schema["_chosen"].dataType.simpleString()

    def step(state: Column, s: Column) -> Column:
        rule, chosen_now = s["rule"], state["chosen"]
        side = lambda h: (h["doc_id"] == rule["winner"]) | (h["doc_id"] == rule["loser"])
        meant = lambda h: F.array_contains(h["touches"], rule["rule_no"])
        active = F.when(s["step"] == 0, F.exists(chosen_now, lambda h: side(h) & meant(h))).otherwise(state["active"])
        there = F.exists(chosen_now, lambda h: (h["doc_id"] == s["doc"]) & meant(h))
        extra = F.filter(F.col("_extras"), lambda e: (e["rule_no"] == rule["rule_no"]) & (e["doc_id"] == s["doc"]))
        others = F.filter(F.transform(chosen_now, lambda h, i: F.when(~side(h), i)), lambda i: i.isNotNull())
        last = F.coalesce(F.array_max(others), F.lit(-1))
        brought = F.concat(F.filter(chosen_now, lambda h, i: i != last), F.transform(extra, lambda e: e["hit"]))
        note = lambda h: F.when((h["doc_id"] == rule["winner"]) & meant(h), F.concat(
            F.lit("TAKES PRECEDENCE over "), rule["loser"], F.lit(" on "), rule["topic"], F.lit("."))).when(
            (h["doc_id"] == rule["loser"]) & meant(h), F.concat(
                F.lit("OVERRIDDEN by "), rule["winner"], F.lit(" on "), rule["topic"], F.lit(": where they disagree, "),
                rule["winner"], F.lit(" applies.")))
        noted = F.transform(chosen_now, lambda h: h.withField("notes", F.filter(
            F.array_append(h["notes"], note(h)), lambda n: n.isNotNull())))
        now = F.when(~active, chosen_now).when(s["step"] == 2, noted).when(~there & (F.size(extra) > 0), brought).otherwise(chosen_now)
        return F.struct(now.alias("chosen"), active.alias("active"))

    begin = F.struct(F.col("_chosen").cast(kind).alias("chosen"), F.lit(False).alias("active"))
    done = held.select("query_id", F.aggregate("_steps", begin, step)["chosen"].alias("_c"))
    return done.select("query_id", F.posexplode("_c").alias("position", "_h")).select(
        "query_id", (F.col("position") + 1).alias("position"), "_h.chunk_id", "_h.doc_id", "_h.rank", "_h.notes")


# ---- chunking ------------------------------------------------------------------------------------------------

_HEADING = r"^(#{1,6})\s+(.*)$"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def _filled(items: Column, budget: Column) -> Column:
    """An array of (text, words) put into bins in order, each of at most `budget` words unless one item is larger:
    an array of (texts, words)."""
    one = lambda x: F.struct(F.array(x["text"]).alias("texts"), x["words"].alias("words"))

    def add(bins: Column, x: Column) -> Column:
        last = F.try_element_at(bins, F.lit(-1))
        grown = F.struct(F.array_append(last["texts"], x["text"]).alias("texts"), (last["words"] + x["words"]).alias("words"))
        fits = (F.size(bins) > 0) & (last["words"] + x["words"] <= budget)
        return F.when(fits, F.array_append(F.slice(bins, F.lit(1), F.greatest(F.size(bins) - 1, F.lit(0))), grown)).otherwise(
            F.array_append(bins, one(x)))

    return F.aggregate(items, F.array().cast("array<struct<texts:array<string>,words:int>>"), add)


def chunk_documents(documents: DataFrame, budget: int = 350) -> DataFrame:
    """Documents (doc_id, title, body) to section chunks of at most `budget` words, tables kept whole or split
    under their header.

    Lines get running section and block numbers by windows over their row: rows that share a doc_id, or have none, are split
    each by itself. A section's path is folded from the headings above it, on heading lines only, and joined to its text.
    Blocks, split tables and chunks are bins filled in order of the text.
    """
    row = Window.partitionBy("row").orderBy("pos")
    each = documents.groupBy("doc_id", F.xxhash64("title", "body").alias("_h")).agg(
        F.any_value("title").alias("_doc_title"), F.any_value("body").alias("body"), F.count(F.lit(1)).cast("int").alias("_n"))
    each = each.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))  # equal rows stay as many
    lines = each.select("doc_id", F.xxhash64("doc_id", "_h", "_n").alias("row"), "_doc_title",
                        F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    depth = F.length(F.regexp_extract("line", _HEADING, 1))
    lines = lines.withColumn("depth", depth).withColumn("section_no", F.count_if(F.col("depth") > 0).over(row))
    headings = lines.where("depth > 0").select("row", "pos", "section_no", "depth", strip(
        F.regexp_extract("line", _HEADING, 2)).alias("name"))
    headings = headings.withColumns({
        "h1": F.last(F.when(F.col("depth") == 1, F.col("name")), ignorenulls=True).over(row),
        "above": F.collect_list(F.struct("depth", "name")).over(row)})
    path = F.aggregate("above", F.array().cast("array<string>"), lambda held, h: F.when(
        h["depth"] > 1, F.array_append(F.slice(held, F.lit(1), h["depth"] - 2), h["name"])).otherwise(
        F.array().cast("array<string>")))
    headings = headings.select("row", "section_no", "h1", F.array_join(path, " > ").alias("section"))
    part = Window.partitionBy("row", "section_no")
    in_order = part.orderBy("pos")
    full = strip(F.col("line")) != ""
    text = lines.where("depth = 0").withColumns({
        "full": full, "is_row": F.ltrim("line").startswith("|"),
        "first": F.min(F.when(full, F.col("pos"))).over(part), "last": F.max(F.when(full, F.col("pos"))).over(part)})
    text = text.withColumn("starts", F.coalesce(~F.lag("full").over(in_order) | (
        F.lag("is_row").over(in_order) != F.col("is_row")), F.lit(True))).withColumn(
        "block", F.count_if(F.col("full") & F.col("starts")).over(in_order)).where("full")
    trimmed = F.when(F.col("pos") == F.col("first"), F.ltrim("line")).otherwise(F.col("line"))
    trimmed = F.when(F.col("pos") == F.col("last"), F.rtrim(trimmed)).otherwise(trimmed)
    text = text.join(headings, ["row", "section_no"], "left").select(
        "doc_id", "row", "section_no", "block", "is_row", "pos", F.coalesce("h1", "_doc_title").alias("title"),
        F.coalesce("section", F.lit("")).alias("section"), trimmed.alias("text"), _words(F.col("line")).alias("words"))
    blocks = text.groupBy("doc_id", "row", "section_no", "title", "section", "block", "is_row").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "words"))).alias("l"), F.sum("words").cast("int").alias("words"))
    lead, rest = F.slice("l", 1, 2), F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0)))
    lead_words = F.aggregate(lead, F.lit(0), lambda n, x: n + x["words"])
    texts = lambda rows: F.transform(rows, lambda x: x["text"])
    under = lambda rows, words: F.struct(F.array_join(F.concat(texts(lead), rows), "\n").alias("text"),
                                         words.cast("int").alias("words"))
    split = F.when(F.size(rest) > 0, F.transform(_filled(rest, F.lit(budget) - lead_words), lambda b: under(
        b["texts"], b["words"] + lead_words))).otherwise(F.array(under(F.array().cast("array<string>"), lead_words)))
    whole = F.array(F.struct(F.array_join(texts(F.col("l")), "\n").alias("text"), F.col("words")))
    units = blocks.withColumn("units", F.when(F.col("is_row") & (F.col("words") > budget), split).otherwise(whole))
    sections = units.groupBy("doc_id", "row", "section_no", "title", "section").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "units"))), lambda b: b["units"])).alias("units"))
    chunks = sections.select("doc_id", "row", "section_no", "title", "section", F.posexplode(
        _filled(F.col("units"), F.lit(budget))).alias("bin", "chunk"))
    place = Window.partitionBy("doc_id").orderBy("row", "section_no", "bin")
    label = F.when(F.col("section") != "", F.concat_ws(" > ", "title", "section")).otherwise(F.col("title"))
    return chunks.select(
        F.concat("doc_id", F.lit("#"), F.row_number().over(place) - 1).alias("chunk_id"), "doc_id", "title", "section",
        F.concat(label, F.lit("\n\n"), F.array_join("chunk.texts", "\n\n")).alias("text"))


def drop_boilerplate(hits: DataFrame, gap: float = 0.03) -> DataFrame:
    """Drop a hit whose document type was already kept with a score less than `gap` away (query_id, doc_type,
    score, rank; k hits per question)."""
    rest = [c for c in hits.columns if c != "query_id"]
    row = F.struct("rank", *[c for c in rest if c != "rank"])

    def add(kept: Column, h: Column) -> Column:
        last = F.try_element_at(F.filter(kept, lambda x: x["doc_type"].eqNullSafe(h["doc_type"])), F.lit(-1))
        near = F.coalesce(F.abs(last["score"] - h["score"]) < gap, F.lit(False))
        return F.when(near, kept).otherwise(F.array_append(kept, h))

    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_h"))
    kind = listed.schema["_h"].dataType.simpleString()
    kept = listed.select("query_id", F.explode(F.aggregate("_h", F.array().cast(kind), add)).alias("_k"))
    return kept.select("query_id", "_k.*").select(*hits.columns)
