"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, and components.

SuperMinHash gives every shingle a random permutation of the signature's places. At rank j of its permutation a shingle
offers the value j + r, r random in [0, 1), to the place the permutation names; the place keeps the smallest offer. Each
shingle thus meets every place once, at ranks that differ, which lowers the variance against independent hashes; and a
document is done as soon as all its places hold a value below the next rank, after two or three ranks for long texts.

1. Documents with equal sets are one class, by a 128-bit fingerprint of the whole set; its smallest doc_id stands for it.
2. Signatures are cut into bands; classes that share a band are candidates. ROWS of a band are chosen so that a pair at
   the wanted similarity shares none with a probability under MISS.
3. In each of TURNS turns every class is compared, on full sets, with one leader: of the leaders of its bands the one it
   shares most bands with. Pairs that are already in one component need no comparison. First the class of a band
   leads whose bands have most members in all, which a family lies around; then a member of the band's largest component,
   drawn anew for each band and turn. The members of a frequent leader
   are dealt to parts of PART, each with a copy of its set. Classes that still share a band across components form families;
   in each family the members outside its largest component are compared with all others, block by block, in tasks that hold
   two blocks of at most about LOAD shingles and send on a forest of the confirmed links. So no link is lost to the choice
   of leaders, no pairs of a group are written out, and a large group of copies costs a comparison a member and turn.
4. Components follow from the confirmed links.

Defined results: a text without words, or NULL, has an empty set and no links; one with fewer words than a shingle has
its whole sequence as its one shingle. A row without doc_id has no component (NULL) and is kept. Rows with one doc_id are
one node with the links of each of them, and share its component. An empty table gives an empty table. Of other columns
only those of `keep_one` come through, unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import components, forest
from tallyline.llm.frames import lookup, stored
from tallyline.llm.words import LOWER, Hasher, Words, blocks, mix, window_hashes

PLACES = 128
MISS = 1e-7
TURNS, PART = 2, 2048
LOAD, ROW_LOAD, COLUMNS = 1 << 17, 256, 2048  # a row weighs ROW_LOAD beside its shingles
_WORD = Hasher(LOWER, seed=61)
_ROW = np.uint64(0x9E3779B97F4A7C15)


def rows_per_band(similarity: float) -> int:
    """The most rows a band may have for a pair at this similarity to be missed with a probability under MISS."""
    fit = [r for r in range(1, 17) if (1 - similarity**r) ** (PLACES // r) <= MISS]
    return fit[-1] if fit else 1


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text of a block, in order of row."""
    h = words.hashes(_WORD)
    row, at = words.windows(size)
    value = window_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    for n in range(1, size):  # whole sequences of short texts
        short = np.flatnonzero(words.counts == n)
        if len(short):
            row = np.append(row, short)
            value = np.append(value, mix(window_hashes(h, n)[words.first[short]] + np.uint64(n)))
    key = mix(value + row.astype(np.uint64) * _ROW)
    pick = np.unique(key, return_index=True)[1]
    pick = pick[np.argsort(row[pick], kind="stable")]
    return row[pick], value[pick]


def signatures(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """SuperMinHash signatures (n_rows, PLACES): rank in the upper 8 bits, the random part in the lower 24."""
    sig = np.full(n_rows * PLACES, 2**32 - 1, np.uint32)
    order = np.tile(np.arange(PLACES, dtype=np.uint8), (len(row), 1))
    live = np.arange(len(row))
    for rank in range(PLACES):
        if not len(live):
            break
        random = mix(value[live] + np.uint64((rank + 1) * 0xD1342543DE82EF95 % 2**64))
        # Fisher-Yates: the place at `rank` is drawn from those not drawn before
        drawn = rank + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES - rank)) >> np.uint64(32)).astype(np.int64)
        place = order[live, drawn]
        order[live, drawn] = order[live, rank]
        offer = np.uint32(rank << 24) | (random >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(sig, row[live] * PLACES + place, offer)
        done = sig.reshape(n_rows, PLACES).max(1) >> 24 <= rank
        live = live[~done[row[live]]]
    return sig.reshape(n_rows, PLACES)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of `rows` places; the band's number is part of it."""
    n = sig.shape[1] // rows
    cut = sig[:, : n * rows].reshape(len(sig), n, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), cut.shape[:2])
    for i in range(rows):
        key = mix(key ^ cut[:, :, i]) * np.uint64(0xE7037ED1A0B428DB)
    return mix(key)


def _sums(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))[ends])


def sketch(text: Column, size: int, rows: int) -> Column:
    """Size and fingerprint of a text's shingle set, and its band keys (none for an empty set)."""
    @F.arrow_udf("struct<n:bigint,f1:bigint,f2:bigint,bands:array<bigint>>")
    def sketch_of(texts: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, offsets in blocks(texts):
            words = Words(data, offsets)
            row, value = shingles(words, size)
            ends = np.searchsorted(row, np.arange(len(offsets)))
            keys = bands(signatures(row, value, len(offsets) - 1), rows)
            keys = keys[np.diff(ends) > 0]
            parts.append((np.diff(ends), _sums(mix(value), ends), _sums(mix(value ^ _ROW), ends), keys.ravel(), keys.shape[1]))
        width = PLACES // rows
        n, f1, f2, keys = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((n > 0) * width)), pa.int32()),
                                         pa.array(keys.view(np.int64)))
        return pa.StructArray.from_arrays(
            [pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists],
            ["n", "f1", "f2", "bands"])

    return sketch_of(text)


def shingle_set(text: Column, size: int) -> Column:
    """The full shingle set of a text, as hashes."""
    @F.arrow_udf("array<bigint>")
    def set_of(texts: pa.Array) -> pa.Array:
        ends, values, base = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], 0
        for _, _, data, offsets in blocks(texts):
            row, value = shingles(Words(data, offsets), size)
            ends.append(np.searchsorted(row, np.arange(1, len(offsets))) + base)
            values.append(value)
            base += len(value)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()),
                                        pa.array(np.concatenate(values).view(np.int64)))

    return set_of(text)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; a leads and may come very often."""
    pairs = stored(pairs, "pairs")
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = lookup(pairs, often, "a").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int"))
    left = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    right = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")).join(often, "a").withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return dealt.drop("n").join(left, "b").join(right, ["a", "part"]).where(
        100 * common >= percent * union).select("a", "b")


def _compare(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A forest of the confirmed links between two blocks of sets, as links between the components they are in."""
        sides = []
        for t in (left, right):
            items = t["items"].combine_chunks()
            sides.append((t["root"].to_numpy(), items.value_lengths().to_numpy().astype(np.int64),
                          items.flatten().to_numpy()))
        (root_a, n_a, x), (root_b, n_b, y) = sides
        common = np.intersect1d(x, y)
        shared = np.zeros((len(root_a), len(root_b)), np.float32)
        for low in range(0, len(common), COLUMNS):
            part = common[low: low + COLUMNS]
            cells = []
            for n, values in ((n_a, x), (n_b, y)):
                at = np.minimum(np.searchsorted(part, values), len(part) - 1)
                hit = part[at] == values
                m = np.zeros((len(n), len(part)), np.float32)
                m[np.repeat(np.arange(len(n)), n)[hit], at[hit]] = 1
                cells.append(m)
            shared += cells[0] @ cells[1].T
        union = n_a[:, None] + n_b[None, :] - shared
        hits = (100 * shared >= percent * union) & (root_a[:, None] != root_b[None, :])
        return pa.table(dict(zip("ab", map(pa.array, forest(hits, root_a, root_b)), strict=True)))
    return run


def _family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (band, rep, root, n) of bands that hold several components, found block by block."""
    lead = members.groupBy("band").agg(F.min("rep").alias("b"))
    family = components(members.join(lead, "band").select(F.col("rep").alias("a"), "b"), "families")
    each = members.select("rep", "root", (F.col("n") + ROW_LOAD).alias("load")).distinct().join(family.select(
        F.col("node").alias("rep"), F.col("root").alias("family")), "rep", "left").withColumn(
        "family", F.coalesce("family", "rep"))
    sizes = each.groupBy("family", "root").agg(F.sum("load").alias("n"))
    major = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"),
                                        F.sum("n").alias("n_all"))
    blocks_of = lambda n: F.ceil(n / LOAD).cast("int")
    placed = each.join(major, "family").select(
        "family", "rep", "root", blocks_of(F.col("n_all") - F.col("n_major")).alias("minors"),
        blocks_of(F.col("n_major")).alias("majors"), (F.col("root") == F.col("major")).alias("is_major"))
    draw = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), n).cast("int")
    placed = stored(placed.withColumn("block", F.when(F.col("is_major"), F.col("minors") + draw(F.col("majors")))
                                      .otherwise(draw(F.col("minors")))), "family_blocks").join(sets, "rep")
    # block pairs (i, j) with i among the minor blocks and j not before i
    left = placed.where(~F.col("is_major")).withColumn("i", F.col("block")).withColumn(
        "j", F.explode(F.sequence("block", F.col("minors") + F.col("majors") - 1)))
    right = placed.withColumn("j", F.col("block")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.least("block", F.col("minors") - 1))))
    key, columns = ["family", "i", "j"], ["root", "items"]
    right = right.select(*(F.col(c).alias(c) for c in key + columns))  # columns of its own, though one source
    return left.select(*key, *columns).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _compare(percent), "a bigint, b bigint")


def links(documents: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row with its class's representative, and the components of linked representatives."""
    sketches = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), sketch(
        F.col("text"), size, rows_per_band(percent / 100)).alias("s")).select("doc_id", "s.*"), "sketches")
    whole = sketches.where("n > 0 and doc_id is not null")
    classes = stored(whole.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
                     "classes")
    keyed = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(keyed.join(shared, "band"), "band_members")
    central = members.groupBy("rep").agg(F.sum("size").alias("central"))
    members = stored(members.drop("size").join(central, "rep"), "central_members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    # rows that share a doc_id have a set each
    sets = stored(texts.select("doc_id", shingle_set(F.col("text"), size).alias("items")).groupBy("doc_id").agg(
        F.collect_set("items").alias("own")).select(F.col("doc_id").alias("rep"), F.explode("own").alias("items")), "sets")

    def open_bands(found: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """Members of the bands that hold several components, and the links that say which."""
        here, so_far = members.withColumn("root", F.col("rep")), None
        if found is not None:
            roots = components(found)
            so_far = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            here = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        mixed = here.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        return stored(here.join(mixed.select("band"), "band"), "open_members"), so_far

    found = None
    for turn in range(TURNS):
        here, so_far = open_bands(found)
        # the one that shares most bands with most leads, then others
        first = F.struct(F.xxhash64("band", "rep", F.lit(turn))) if turn else F.struct(-F.col("central"), "rep")
        # the leader is of the band's largest component, so only members outside that have to be compared
        lead = here.groupBy("band", "root").agg(
            F.count(F.lit(1)).alias("size"), F.min_by(F.struct("rep", "n", "root"), first).alias("l")).groupBy("band").agg(
            F.max_by("l", F.struct("size", -F.col("root"))).alias("l")).select(
            "band", F.col("l.rep").alias("a"), F.col("l.n").alias("n_a"), F.col("l.root").alias("root_a"))
        # sets whose sizes differ too much cannot reach the similarity
        pairs = here.join(lead, "band").where((F.col("root") != F.col("root_a")) & (
            100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))).groupBy(F.col("rep").alias("b"), "a").agg(
            F.count(F.lit(1)).alias("bands")).groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a"))
        new = stored(_confirmed(pairs.select("a", "b"), sets, percent), "links")
        found = new if so_far is None else so_far.unionByName(new)
    here, so_far = open_bands(found)
    found = so_far.unionByName(_family_links(here.select("band", "rep", "root", "n"), sets, percent))
    # rows with one doc_id and different sets tie their classes together, and copies belong to their class
    twice = whole.join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).where("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return sketches, components(found.unionByName(twice))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sketches, roots = links(documents, size, percent)
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return (sketches.select("doc_id", F.col("n").alias("n_shingles"))
            .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", root.alias("component_id"),
                    F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept")))


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each component, its smallest doc_id, with all their columns."""
    _, roots = links(documents, size, percent)
    return documents.join(roots.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
