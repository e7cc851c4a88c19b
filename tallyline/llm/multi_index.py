"""Near-duplicate embeddings among rows of one label, by an inverted multi-index.

1. Equal vectors of a label are one class with a count, so copies cost nothing further on.
2. Unit vectors are cut into halves with a codebook each, fitted by k-means on at most SAMPLE of them; a pair of centroids,
   one of each codebook, is a cell, and every class lies in the cell of its nearest centroids.
3. The classes of a cell are dealt into blocks. In a block all pairs are multiplied, and classes within half the angle of
   the threshold of a leader form a ball with it: any two of a ball are linked without a look. A family of near copies that
   holds a third of all rows thus goes on as a few balls. Elsewhere most balls are single classes.
4. Balls visit cells by the multi-sequence traversal: both halves' centroids in order of a lower bound of the distance to
   their cells, and pairs of them in order of the sum, until the sum passes `stop`. `stop` is the sum within which, of pairs
   drawn at the threshold itself from the sample, the target share meets from either side; nearer pairs meet more often.
   With a recall of 1 it is the bound that no linked pair can pass.
5. Where a ball meets the balls of a cell, in blocks of both, the angle of the leaders decides for singles, exactly, and
   for balls that lie wholly within or beyond the threshold. Balls for which it decides nothing are compared by members.
   Only counts and forests of links leave a task, never pairs.
6. Components follow from the forests.

Defined results: a vector that is NULL, empty, zero or holds NULL, NaN or an infinity, a NULL label, and a row without an
id link with nothing. Only vectors of one width are compared. Rows that share an id are entries of their own: each has the
links of its vector, and component_id is the smallest id among the rows it reaches. An empty table gives an empty table.
No other column is read.

Bounds: codebooks have at most CENTROIDS entries, as many as give CELL classes a cell in the largest label; beyond
CENTROIDS^2 * CELL classes in one label cells grow. Members of a family spread just about the threshold are compared with each
other block by block, in time that grows with the square of that family.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import components, forest, roots
from tallyline.llm.frames import lookup, stored

SAMPLE, SAMPLE_CELLS = 20_000, 1 << 22  # at most so many vectors, and so many entries
CENTROIDS, CELL, BLOCK = 256, 64, 1024
RECALL, TRIALS = 0.999, 8000
SLACK = 1e-7  # of angles, for rounding; what lies closer is compared by members


# ---- codebooks -------------------------------------------------------------------------------------------------

def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k centroids; one that loses all its vectors stays where it is."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class Half:
    """The codebook of one half."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.gaps = centres, np.sqrt(_squares(centres, centres))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and to every centroid's cell a lower bound of the distance: to the plane
        half way between it and the nearest."""
        d = _squares(x, self.centres)
        near = d.argmin(1)
        gap = self.gaps[near]
        over = d - np.take_along_axis(d, near[:, None], 1)
        return near, np.divide(over, 2 * gap, out=np.zeros_like(d), where=gap > 0)


class MultiIndex:
    """Codebooks for the vectors of one width, and how far a search goes."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float = RECALL):
        self.cut = sample.shape[1] // 2
        unit = _units(sample)
        self.halves = [Half(kmeans(part, k)) for part in self._parts(unit)]
        self.stop = 2 - 2 * cosine + 1e-9 if recall >= 1 else self._stop(unit, cosine, recall)

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut:]

    def _cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        (a, p), (b, q) = (h.bounds(part) for h, part in zip(self.halves, self._parts(x), strict=True))
        return a * len(self.halves[1].centres) + b, [p, q]

    def _stop(self, unit: np.ndarray, cosine: float, recall: float) -> float:
        rng = np.random.default_rng(9)
        x = unit[rng.integers(0, len(unit), min(TRIALS, 4 * len(unit)))]
        y = rng.standard_normal(x.shape)
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        y = cosine * x + np.sqrt(1 - cosine * cosine) * y
        width = len(self.halves[1].centres)
        (at_x, of_x), (at_y, of_y) = self._cells(x), self._cells(y)
        rows = np.arange(len(x))
        far = [p[rows, at // width] ** 2 + q[rows, at % width] ** 2 for (p, q), at in ((of_x, at_y), (of_y, at_x))]
        return float(np.quantile(np.minimum(*far), recall)) + 1e-12

    def cells(self, x: np.ndarray) -> np.ndarray:
        return self._cells(x)[0]

    def visits(self, x: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """The cells of the traversal from each row, in its order; `reach` is how far a ball's members lie around it."""
        _, (p, q) = self._cells(x)
        p, q = (np.maximum(h - reach[:, None], 0) ** 2 for h in (p, q))
        first, second = np.argsort(p, 1, kind="stable"), np.argsort(q, 1, kind="stable")
        p, q = np.take_along_axis(p, first, 1), np.take_along_axis(q, second, 1)
        out = []
        for r in range(len(x)):
            # along the first sequence, how far into the second the sum stays within the stop
            depth = np.searchsorted(q[r], self.stop - p[r], "right")
            n = int(np.count_nonzero(depth))
            i = np.repeat(np.arange(n), depth[:n])
            j = np.arange(len(i)) - np.repeat(np.cumsum(depth[:n]) - depth[:n], depth[:n])
            order = np.argsort(p[r][i] + q[r][j], kind="stable")
            out.append(first[r][i[order]] * q.shape[1] + second[r][j[order]])
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that keep their squares within range; angles stay as they are, to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cell(v: Column, width: int, index: MultiIndex) -> Column:
    @F.arrow_udf("int")
    def cell_of(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), -1, np.int32)
        fit = np.flatnonzero(vectors.value_lengths().to_numpy() == width)
        for low in range(0, len(fit), 2048):
            at = fit[low: low + 2048]
            out[at] = index.cells(_units(_matrix(vectors.take(pa.array(at)))))
        return pa.array(out)

    return cell_of(v)


def _visits(v: Column, radius: Column, cell: Column, width: int, index: MultiIndex) -> Column:
    """The cells a ball goes to, its own first."""
    @F.arrow_udf("array<int>")
    def cells_of(vectors: pa.Array, radii: pa.Array, own: pa.Array) -> pa.Array:
        per: list[np.ndarray] = [np.zeros(0, np.int32)] * len(vectors)
        fit = np.flatnonzero(vectors.value_lengths().to_numpy() == width)
        home, angle = own.to_numpy(), radii.to_numpy()
        for low in range(0, len(fit), 2048):
            at = fit[low: low + 2048]
            reach = 2 * np.sin(np.minimum(angle[at], np.pi) / 2)
            for r, to in zip(at.tolist(), index.visits(_units(_matrix(vectors.take(pa.array(at)))), reach), strict=True):
                per[r] = np.append(home[r], to[to != home[r]]).astype(np.int32)
        ends = np.append(0, np.cumsum([len(p) for p in per])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(per) if per else np.zeros(0, np.int32)))

    return cells_of(v, radius, cell)


# ---- blocks ----------------------------------------------------------------------------------------------------

def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    x, y = _scaled(x), _scaled(y)
    return (x @ y.T) / (norm(x)[:, None] * norm(y)[None, :])


_BLOCKS = "id bigint, n bigint, label string, width int, cell int, block int, ball bigint, links bigint, up bigint, " \
          "v array<double>, radius double, weight bigint, members bigint"


def _balls(cosine: float):
    half = np.cos(np.arccos(cosine) / 2)

    def run(table: pa.Table) -> pa.Table:
        """A block's links, and its balls: the leader's row carries vector, radius, weight and number of members."""
        table = table.sort_by("id")
        ids, n = table["id"].to_numpy(), table["n"].to_numpy()
        near = _cosines(x := _matrix(table["v"]), x)
        hits = near >= cosine
        np.fill_diagonal(hits, False)
        links = hits @ n + n - 1
        up, _ = roots(hits, ids, ids)
        ball, radius = np.full(len(ids), -1), np.zeros(len(ids))
        weight, members = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for i in range(len(ids)):
            if ball[i] < 0:
                own = (ball < 0) & (near[i] >= half) & hits[i]
                own[i] = True
                ball[own] = i
                members[i], weight[i] = own.sum(), n[own].sum()
                if members[i] > 1:
                    own[i] = False
                    radius[i] = np.arccos(np.clip(near[i][own].min(), -1, 1)) + SLACK
        leads = ball == np.arange(len(ids))
        vectors = table["v"].combine_chunks().to_numpy(zero_copy_only=False)
        return pa.table([
            table["id"], table["n"], table["label"], table["width"], table["cell"], table["block"], pa.array(ids[ball]),
            pa.array(links), pa.array(up), pa.array([v if k else None for v, k in zip(vectors, leads.tolist(), strict=True)],
                                                    pa.list_(pa.float64())),
            pa.array(radius), pa.array(weight), pa.array(members)],
            names=[c.split()[0] for c in _BLOCKS.split(", ")])
    return run


_FOUND = "kind int, a bigint, b bigint"
_ADD, _LINK, _OPEN = 0, 1, 2  # b more links for ball a; a link of nodes; balls that have to be compared by members


def _rows(*parts: tuple[int, np.ndarray, np.ndarray]) -> pa.Table:
    kinds = np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in parts])
    a, b = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in (1, 2))
    return pa.table({"kind": pa.array(kinds), "a": pa.array(a), "b": pa.array(b)})


def _meet(cosine: float):
    limit = np.arccos(cosine)

    def run(visitors: pa.Table, here: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not len(visitors) or not len(here):
            return _rows((_ADD, none, none))
        col = lambda t, c: t[c].to_numpy()
        near = _cosines(_matrix(visitors["v"]), _matrix(here["v"]))
        (id_a, cell_a, block_a, r_a, w_a), (id_b, cell_b, block_b, r_b, w_b) = (
            [col(t, c) for c in ("id", "cell", "block", "radius", "weight")] for t in (visitors, here))
        reach = r_a[:, None] + r_b[None, :]
        angle = np.arccos(np.clip(near, -1, 1))
        single = reach == 0
        sure = np.where(single, near >= cosine, angle + reach <= limit - SLACK)
        unsure = ~single & ~sure & (angle - reach <= limit + SLACK)
        # pairs of one cell and block are done; pairs of one cell meet twice; others meet twice if both visit
        same = cell_a[:, None] == cell_b[None, :]
        fresh = np.where(same, (id_a[:, None] < id_b[None, :]) & (block_a[:, None] != block_b[None, :]),
                         cell_a[:, None] < cell_b[None, :])
        back = np.argwhere((sure | unsure) & (cell_a[:, None] > cell_b[None, :]))
        if len(back):
            goes = here["visits"].combine_chunks()
            lists = {j: set(goes[j].as_py()) for j in np.unique(back[:, 1]).tolist()}
            for i, j in back.tolist():
                fresh[i, j] = int(cell_a[i]) not in lists[j]
        sure &= fresh
        unsure &= fresh
        add_a, add_b = sure @ w_b, w_a @ sure
        i, j = np.nonzero(unsure)
        return _rows((_ADD, id_a[add_a > 0], add_a[add_a > 0]), (_ADD, id_b[add_b > 0], add_b[add_b > 0]),
                     (_LINK, *forest(sure, id_a, id_b)), (_OPEN, id_a[i], id_b[j]))
    return run


def _by_members(cosine: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not len(left) or not len(right):
            return _rows((_ADD, none, none))
        hits = _cosines(_matrix(left["v"]), _matrix(right["v"])) >= cosine
        (a, n_a), (b, n_b) = ([t[c].to_numpy() for c in ("id", "n")] for t in (left, right))
        add_a, add_b = hits @ n_b, n_a @ hits
        return _rows((_ADD, a[add_a > 0], add_a[add_a > 0]), (_ADD, b[add_b > 0], add_b[add_b > 0]),
                     (_LINK, *forest(hits, a, b)))
    return run


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _share(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), n).cast("int")


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _meetings(balls: DataFrame, cosine: float) -> DataFrame:
    """What is found where balls visit the balls of a cell, in blocks of visitors and of those there."""
    place = ["label", "width", "at"]
    visitors = balls.withColumn("at", F.explode("visits")).drop("visits", "members")
    here = balls.withColumn("at", F.col("cell")).drop("members")
    count = lambda df, name: df.groupBy(*place).agg(_blocks(F.count(F.lit(1))).alias(name))
    sizes = count(visitors.select(*place), "n_visitors").join(count(here.select(*place), "n_here"), place)
    left = visitors.join(sizes, place).withColumn("i", _share("id", F.col("n_visitors"))).withColumn(
        "j", _every(F.col("n_here")))
    right = here.join(sizes, place).withColumn("j", _share("id", F.col("n_here"))).withColumn(
        "i", _every(F.col("n_visitors")))
    key = [*place, "i", "j"]
    columns = ["id", "cell", "block", "radius", "weight", "v"]
    right = right.select(*(F.col(c).alias(c) for c in [*key, *columns, "visits"]))  # columns of its own, though one source
    return left.select(*key, *columns).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(cosine), _FOUND)


def _compared(open_pairs: DataFrame, members: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """The links between members of balls whose leaders decided nothing: for each second ball, its members against those
    of all its first ones, in blocks."""
    pairs = open_pairs.join(sizes.select(F.col("ball").alias("a"), F.col("members").alias("n_a")), "a")
    parts = pairs.groupBy("b").agg(_blocks(F.sum("n_a")).alias("parts"))
    left = (pairs.select("a", "b").join(members.withColumnRenamed("ball", "a"), "a").join(parts, "b")
            .withColumn("part", _share("id", F.col("parts"))).select("b", "part", "id", "n", "v"))
    right = (members.withColumnRenamed("ball", "b").join(parts, "b").withColumn("part", _every(F.col("parts")))
             .select(*(F.col(c).alias(c) for c in ("b", "part", "id", "n", "v"))))
    return left.groupBy("b", "part").cogroup(right.groupBy("b", "part")).applyInArrow(_by_members(cosine), _FOUND)


# ---- the whole -------------------------------------------------------------------------------------------------

def indexes(classes: DataFrame, cosine: float, recall: float) -> dict[int, MultiIndex]:
    """An index for each width, fitted on the classes with the smallest hashes."""
    sizes = classes.groupBy("width", "label").count().groupBy("width").agg(F.max("count").alias("n")).collect()
    out = {}
    for r in sizes:
        limit = max(1, min(SAMPLE, SAMPLE_CELLS // r["width"]))
        rows = classes.where(F.col("width") == r["width"]).orderBy(F.xxhash64("v", F.lit(5)), "id").limit(limit).select("v")
        sample = _matrix(rows.toArrow()["v"])
        k = min(CENTROIDS, len(sample), max(1, int(np.ceil(np.sqrt(r["n"] / CELL)))))
        out[r["width"]] = MultiIndex(sample, k, cosine, recall)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    wide = F.transform(F.col(embedding), lambda e: e.cast("double") + F.lit(0.0))  # no negative zeros
    fit = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.forall(
        wide, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(wide, lambda e: e != 0)
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                           wide.alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"))
    rows = every.where("fit").drop("fit")
    mark = F.xxhash64("label", "v"), F.xxhash64("v", "label", F.lit(7))
    classes = stored(rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select(
        F.monotonically_increasing_id().alias("id"), "rep", "n", "label", F.size("v").alias("width"),
        F.struct(*mark).alias("mark"), "v"), "vector_classes")

    built = indexes(classes, cosine, recall)
    pick = lambda make, none: F.coalesce(*[F.when(F.col("width") == w, make(w, i)) for w, i in built.items()], none)
    placed = stored(classes.select("id", "n", "label", "width", pick(
        lambda w, i: _cell(F.col("v"), w, i), F.lit(0)).alias("cell"), "v"), "vector_cells")
    place = ["label", "width", "cell"]
    sizes = placed.groupBy(*place).agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    blocks = placed.join(sizes, place).withColumn("block", _share("id", F.col("blocks"))).drop("blocks")
    members = stored(blocks.groupBy(*place, "block").applyInArrow(_balls(cosine), _BLOCKS), "vector_blocks")
    balls = stored(members.where("v is not null").select("id", *place, "block", "v", "radius", "weight", "members", pick(
        lambda w, i: _visits(F.col("v"), F.col("radius"), F.col("cell"), w, i), F.array(F.col("cell"))).alias("visits")), "balls")
    found = stored(_meetings(balls, cosine), "met")
    adds = members.select(F.col("id"), F.col("links").alias("b"))
    by_ball = found.where(F.col("kind") == _ADD).groupBy(F.col("a").alias("ball")).agg(F.sum("b").alias("b"))
    adds = adds.unionByName(members.select("id", "ball").join(by_ball, "ball").select("id", "b"))
    links = members.select(F.col("id").alias("a"), F.col("up").alias("b")).where("a <> b").unionByName(
        found.where(F.col("kind") == _LINK).select("a", "b"))
    open_pairs = found.where(F.col("kind") == _OPEN).select("a", "b")
    if not open_pairs.isEmpty():
        whole = members.select("ball", "id", "n").join(classes.select("id", "v"), "id")
        more = stored(_compared(open_pairs, whole, members.where("members > 0").select("ball", "members"), cosine), "compared")
        adds = adds.unionByName(more.where(F.col("kind") == _ADD).select(F.col("a").alias("id"), "b"))
        links = links.unionByName(more.where(F.col("kind") == _LINK).select("a", "b"))

    tree = components(links).withColumnsRenamed({"node": "id"})
    rooted = classes.select("id", "rep", "n", "mark").join(tree, "id", "left").withColumn("root", F.coalesce("root", "id"))
    totals = stored(rooted.join(adds.groupBy("id").agg(F.sum("b").alias("n_links")), "id").select(
        "root", "rep", "n", "mark", "n_links"), "vector_links")
    lows = totals.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    of_class = lookup(totals, lows, "root", "classes").select("mark", "n", "n_links", "component_id")
    linked = lookup(rows.select("vec_id", F.struct(*mark).alias("mark")), of_class, "mark").select(
        "vec_id", "n_links", "component_id")
    alone = every.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
