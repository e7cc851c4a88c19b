"""The inverted index against full lists, declared precedences against a plain walk, index upkeep, digests, vectors, close keys."""

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import lexical as lx
from tallyline.operators import policy, retrieval as rt
from tallyline.operators.index_store import IndexStore
from tallyline.plans import search
from tallyline.sources import knowledge

RULES = "rule_no int, winner string, loser string, topic string, terms array<string>"


def test_top_k_equals_the_full_list_from_fewer_postings(spark, sf):
    store = {}

    def keep(name, df):
        store[name] = df.persist()
        return store[name]

    c, q = search.chunks(spark, sf), search.questions(spark, sf)
    ix = lx.index(lx.counted(c), keep)
    full = {(r.query_id, r.chunk_id): round(r.score, 9) for r in rt.bm25(c, q).collect()}
    listed = {(r.query_id, r.chunk_id): round(r.score, 9) for r in lx.bm25(ix, q).collect()}
    assert listed.keys() == full.keys() and all(abs(listed[k] - full[k]) < 2e-9 for k in full)
    for k in (1, 6, 40):
        want = {(r.query_id, r.chunk_id, r["rank"]) for r in rt.top_k(rt.bm25(c, q), k).collect()}
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in lx.bm25_top(ix, q, k, keep).collect()} == want
    read = lx.candidates(ix, q, 6, keep)[0].count()
    assert read < 0.7 * len(full)  # of 200 chunks; the share falls as the corpus grows


def test_a_narrowed_index_keeps_all_statistics(spark, sf):
    c, q = search.chunks(spark, sf), search.questions(spark, sf).where("query_id < '2'")
    ix = lx.index(lx.counted(c), lambda name, df: df.persist())
    some = c.where("doc_type = 'fr'")
    ids = {r.chunk_id for r in some.select("chunk_id").collect()}
    want = {(r.query_id, r.chunk_id, r["rank"]) for r in rt.top_k(rt.bm25(c, q).join(some.select("chunk_id"), "chunk_id"), 3).collect()}
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in lx.bm25_top(lx.narrowed(ix, some), q, 3, lambda n, df: df.persist()).collect()}
    assert got == want and {g[1] for g in got} <= ids


def walk(hits, rules, k):
    """Declared precedences one after the other over one question's hits (chunk, doc, text, note), best first."""
    chosen = hits[:k]
    notes = {h[0]: [h[3]] if h[3] else [] for h in hits}
    for _, winner, loser, topic, terms in rules:
        meant = lambda h: any(t.lower() in h[2].lower() for t in terms)  # noqa: B023, E731
        if not any(meant(h) and h[1] in (winner, loser) for h in chosen):
            continue
        for doc in (winner, loser):
            if any(h[1] == doc and meant(h) for h in chosen):
                continue
            extra = [h for h in hits if h[1] == doc and meant(h)][:1]
            out = [h for h in chosen if h[1] not in (winner, loser)][-1:] if extra else []
            chosen = [h for h in chosen if h not in out] + extra
        for h in chosen:
            if meant(h) and h[1] == winner:
                notes[h[0]].append(f"TAKES PRECEDENCE over {loser} on {topic}.")
            if meant(h) and h[1] == loser:
                notes[h[0]].append(f"OVERRIDDEN by {winner} on {topic}: where they disagree, {winner} applies.")
    return [(h[0], notes[h[0]]) for h in chosen]


def test_precedences_in_order(spark):
    rng = random.Random(9)
    rules = [(1, "A", "B", "dates", ["due"]), (2, "B", "C", "units", ["KG", "pound"]), (3, "D", "A", "names", ["due", "kg"])]
    rows, want = [], {}
    for n in range(120):
        hits = [(f"q{n}c{i}", rng.choice("ABCDEFG"), " ".join(rng.sample(["Due", "kg", "pounds", "x", "y"], rng.randrange(3))),
                 rng.choice([None, None, "EXPIRED"])) for i in range(rng.randrange(1, 14))]
        want[f"q{n}"] = walk(hits, rules, 4)
        rows += [(f"q{n}", *h, i + 1) for i, h in enumerate(hits)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id string, text string, status_note string, rank int")
    out = rt.precedence(df.where("doc_id in ('A', 'B', 'C', 'D')"), df.where("rank <= 4"), spark.createDataFrame(rules, RULES), 4)
    got = {}
    for r in out.orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.notes))
    assert got == want
    assert any("OVERRIDDEN" in " ".join(n) and "TAKES" in " ".join(n) for w in want.values() for _, n in w)


def test_precedence_query_equals_a_plain_walk(spark, sf):
    c = {r.chunk_id: r for r in search.chunks(spark, sf).collect()}
    q = search.questions(spark, sf)
    full = rt.ranked(rt.bm25(search.chunks(spark, sf), q)).orderBy("query_id", "rank").collect()
    note = {"superseded": "SUPERSEDED by a later version: kept for history only; not in force.",
            "expired": "EXPIRED: effective from an earlier date and no longer in force; it describes that past period only and must "
                       "not be applied to later periods.", "current": None}
    hits = {}
    for r in full:
        x = c[r.chunk_id]
        hits.setdefault(r.query_id, []).append((r.chunk_id, x.doc_id, x.text, note[x.status]))
    want = {(i, p + 1, h, " ".join(n)) for i, found in hits.items() for p, (h, n) in enumerate(walk(found, search.RULES, rt.TOP_K))}
    got = {tuple(r) for r in search.precedence(spark, sf).select("query_id", "position", "chunk_id", "notes").collect()}
    assert got == want


def test_a_permitted_chunk_without_a_vector_is_refused(spark):
    chunks = [("c1", "all", None, "current", [1.0, 0.0]), ("c2", "restricted", None, "current", [0.0, 1.0]),
              ("c3", "plant", "PLT-01", "current", [1.0, 1.0])]
    schema = "chunk_id string, access_level string, plant string, status string, vector array<double>"
    asked = spark.createDataFrame([("q", "plant_user", "PLT-02", False, [1.0, 0.0])],
                                  "query_id string, role string, asker_plant string, history boolean, vector array<double>")

    def run(lost):
        rows = [(*r[:4], None if r[0] == lost else r[4]) for r in chunks]
        df = spark.createDataFrame(rows, schema)
        return {r.chunk_id for r in rt.vector_topk(rt.require_vectors(df, asked), asked, 5).collect()}

    assert run(None) == run("c2") == run("c3") == {"c1"}  # neither may be seen by this asker
    with pytest.raises(Exception, match="permitted chunks without an embedding: 1"):
        run("c1")


def test_syncs_equal_a_fresh_build(spark, tmp_path):
    schema = "k string, v string"

    def table(rows):
        return spark.createDataFrame(sorted(rows.items()), schema)

    def content(store, version=None):
        return {r.k: r.v for r in store.read(version).collect()}

    store = IndexStore(spark, str(tmp_path / "ix"), schema, "k", parts=32)
    assert content(store) == {}
    first = {f"k{i}": f"v{i}" for i in range(400)}
    one = store.sync(table(first))
    second = {k: v for k, v in first.items() if k not in ("k5", "k6")} | {"k7": "changed", "new": "x"}
    before = store.manifest()
    two = store.sync(table(second))
    assert (one.inserted, one.updated, one.deleted) == (400, 0, 0) and (two.inserted, two.updated, two.deleted) == (1, 1, 2)
    assert content(store) == second and content(store, one.version) == first  # a pinned reader sees what it saw
    kept = [p for p, e in store.manifest().items() if before.get(p) == e]
    assert two.parts <= 4 and len(kept) >= 28 and all(os.path.isdir(tmp_path / "ix" / before[p][0] / f"_part={p}") for p in kept)
    again = store.sync(table(second))
    assert (again.version, again.parts) == (two.version, 0)
    fresh = IndexStore(spark, str(tmp_path / "fresh"), schema, "k", parts=32)
    fresh.sync(table(second))
    assert content(fresh) == content(store)
    assert store.sync(table({}).where("false")).deleted == 399 and content(store) == {}
    assert store.sync(table(first)).inserted == 400 and content(store) == first


def test_corpus_digest_and_stale_places(spark):
    rows = [(f"d{i}", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, text_sha256 string")
    root = knowledge.corpus_digest(df).first()
    assert root.chunks == 3000 and knowledge.corpus_digest(df.repartition(7)).first() == root
    changed = df.withColumn("text_sha256", F.when(F.col("path") == "d7", "other").otherwise(F.col("text_sha256")))
    assert knowledge.corpus_digest(changed).first().corpus_sha256 != root.corpus_sha256
    held = knowledge.buckets(df)
    assert knowledge.stale_buckets(held, df).count() == 0 and 1 <= knowledge.stale_buckets(held, changed).count() <= 2
    assert knowledge.stale_buckets(held, df.where("path <> 'd9'")).count() == 1
    assert knowledge.corpus_digest(df.limit(0)).first().chunks == 0


def test_close_keys_are_complete_and_few(spark):
    rng = random.Random(2)

    def measured(n):
        keys = [f"C{i:06d}" for i in range(1, n + 1)]
        values = [f"C{rng.randrange(1, n):06d}" for _ in range(50)]
        values = [v[:p] + rng.choice("Z7") + v[p + rng.randrange(2):] for v in values for p in [rng.randrange(1, 7)]]
        pairs = policy.close_pairs(spark.createDataFrame([(v,) for v in set(values)], "u string"),
                                   spark.createDataFrame([(k,) for k in keys], "key string"))
        return pairs.count() / len(set(values))

    few, many = measured(2000), measured(20_000)
    assert many < 60 and many < 2.5 * few + 10  # follows the text, not the number of keys
    letters = "abcde"
    keys = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([4, 9, 15, 22, 31]))) for _ in range(150)})
    near = [k[:p] + rng.choice(letters) + k[p + 1:] for k in keys for p in [rng.randrange(len(k))]] + [k[1:] + "a" for k in keys]
    got = {(r.u, r.key) for r in policy.close_pairs(spark.createDataFrame([(v,) for v in set(near)], "u string"),
                                                    spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    for v in set(near):
        for k in keys:
            if difflib.SequenceMatcher(None, k, v).ratio() >= 0.85:
                assert (v, k) in got


def test_full_lists_need_no_forward_index_and_a_narrowed_one_few_blocks(spark, sf, monkeypatch):
    store = {}

    def keep(name, df):
        store[name] = df.persist()
        return store[name]

    c, q = search.chunks(spark, sf), search.questions(spark, sf).where("query_id < '2'")
    ix = lx.index(lx.counted(c), keep)
    classes = {tuple(r)[:3]: (r["_n"], r["_l"]) for r in ix.classes.collect()}
    texts = c.select(*rt.CLASS, F.size(rt.tokens(F.col("text"))).alias("l")).groupBy(*rt.CLASS).agg(F.count("l"), F.sum("l"))
    assert classes == {tuple(r)[:3]: tuple(r)[3:] for r in texts.collect()}
    monkeypatch.setattr(lx, "CHUNK_BLOCK", 16)
    some = c.where("doc_id % 50 = 3").select("chunk_id")
    part = lx.narrowed(ix, some)
    assert part.scored.count() < 16 < sum(n for n, _ in classes.values())  # one block, as only its own chunks are dealt out
    pairs = lambda df: {(r.query_id, r.chunk_id, round(r.score, 8)) for r in df.collect()}
    assert pairs(lx.bm25(part, q)) == pairs(lx.bm25(ix, q).join(some, "chunk_id", "left_semi"))
    assert "lexical_forward" not in store
    assert {r.chunk_id for r in ix.forward.collect()} == {r.chunk_id for r in c.collect()} and "lexical_forward" in store
