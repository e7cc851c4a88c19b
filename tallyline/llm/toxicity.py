"""Toxicity of whole texts: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are densities: of lexicon words, of lexicon words near a second person, of capitals, of punctuation
and of obfuscated spellings. The lexicon has two parts, a short list of insults in four languages and units (words and
word beginnings) learned from labelled texts: those that a toxic text has far oftener than a clean one. The labelled
sample has three parts: units are learned from the first, trees from the second, the calibration from the third, so no
step is fitted to what an earlier one has seen. Labels are read nowhere else, and no column but the text is a feature.

The sample is bounded by SAMPLE_ROWS (those with the smallest hash of doc_id); lexicon and trees are a few kilobytes. All
texts are scored in one pass, whole, block by block.

Defined results: a NULL or empty text has only zero features and gets the score the model gives to those. Rows with a
NULL label or doc_id are no examples; a doc_id labelled more than once is toxic if any label says so. Without examples of
both labels there are no trees, and every score is the share of toxic examples (0 without any). Repeated rows get equal
scores. Columns of the input beside doc_id and text are not read; `drop_toxic` passes them through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import fresh_name
from tallyline.llm.words import AS_IS, Hasher, Words, blocks, mix

SAMPLE_ROWS = 20_000
MAX_UNITS = 600
THRESHOLD = 0.3
#: Lengths of learned word beginnings, in characters; 0 is the whole word.
UNIT_LENGTHS = (0, 3, 4, 5, 6, 7)
MIN_UNIT_TEXTS, MIN_UNIT_Z, MIN_UNIT_ODDS = 3, 3.5, 1.5
# Common insults and swear words, and words for the person addressed.
INSULTS = """
idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage pathetic worthless disgusting clown fool
imbecile jerk creep freak filth filthy vermin pig swine bastard bitch asshole shit shitty bullshit fuck fucking fucker
cunt dick whore slut retard retarded degenerate parasite coward ugly hate kill die nazi
idiotin dumm dummkopf blöd blödmann trottel depp arschloch scheiße scheisse drecksau schwein hurensohn fotze wichser
abschaum versager missgeburt penner schlampe ekelhaft
connard connasse salaud salope pute putain merde abruti crétin imbécile débile ordure enculé bouffon dégueulasse minable
estúpido estúpida imbécil gilipollas cabrón puta puto mierda pendejo basura asqueroso asquerosa maldito inútil zorra
payaso escoria
""".split()
SECOND_PERSON = """
you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú
ti tus usted ustedes vosotros vuestro
""".split()
NEAR = 3

_LEET = AS_IS.copy()
_LEET[65:91] += 32
for _from, _to in zip(b"0134579@$", b"oieastgas", strict=True):
    _LEET[_from] = _to
_LOWER = AS_IS.copy()
_LOWER[65:91] += 32
_CORE = np.zeros(256, bool)
_CORE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_CORE[128:] = True
_LETTER = _CORE.copy()
_LETTER[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&@^~_=+<>|\\/")] = True
_HASHER = Hasher(_LOWER, seed=21)

FEATURES = ("log_words", "insults", "log_insults", "learned", "log_learned", "learned_share", "top_learned", "person",
            "near_person", "near_share", "capitals", "shouted", "marks", "double_marks", "signs", "hidden", "mixed",
            "drawn_out", "non_ascii", "word_length")


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(_HASHER.spans(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends))


_INSULTS, _PERSONS = _hash_words(INSULTS), _hash_words(SECOND_PERSON)


class Table:
    """Weights of a few hashes, looked up in bulk; a bitmap answers for most words."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.float32)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(at):
            spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[spot] == hashes[at]
            out[at[hit]] = self.weights[spot[hit]]
        return out


class Forms:
    """The words of a block as spans without outer punctuation, and hashes of their forms."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets)
        core = np.append(0, np.cumsum(_CORE[data]))
        spots = np.flatnonzero(_CORE[data])
        a, b = core[w.starts], core[w.ends]
        full = b > a
        padded = np.append(spots, 0)
        self.starts = np.where(full, padded[np.minimum(a, len(spots))], w.starts)
        self.ends = np.where(full, padded[b - 1] + 1, w.starts)
        heads = (data & 0xC0) != 0x80
        self.places = np.append(np.flatnonzero(heads), len(data))
        chars = np.append(0, np.cumsum(heads))
        self.first_char, self.last_char = chars[self.starts], chars[self.ends]

    def plain(self, length: int = 0) -> np.ndarray:
        """Hashes of whole words, or of their first `length` characters (0 where a word is not longer)."""
        data = self.words.data
        if not length:
            h = _HASHER.spans(data, self.starts, self.ends)
            return np.where(self.ends > self.starts, h, np.uint64(0))
        long = np.flatnonzero(self.last_char - self.first_char > length)
        out = np.zeros(len(self.starts), np.uint64)
        out[long] = mix(_HASHER.spans(data, self.starts[long], self.places[self.first_char[long] + length])
                        + np.uint64(length))
        return out

    def unmasked(self) -> tuple[np.ndarray, np.ndarray]:
        """Words with a sign or digit between letters, and the hashes of what they spell."""
        data = self.words.data
        odd = np.append(0, np.cumsum(~_LETTER[data]))
        masked = np.flatnonzero(odd[self.ends] > odd[self.starts])
        if not len(masked):
            return masked, np.zeros(0, np.uint64)
        text = _LEET[data]
        keep = _LETTER[text]
        place = np.append(0, np.cumsum(keep))
        return masked, _HASHER.spans(text[keep], place[self.starts[masked]], place[self.ends[masked]])


def features(forms: Forms, lexicon: dict[int, Table]) -> np.ndarray:
    """FEATURES of every text of a block."""
    w, data = forms.words, forms.words.data
    rows, owner = len(w.counts), forms.words.owners()
    n = np.maximum(w.counts, 1)
    per = lambda x: np.bincount(owner, x, rows)
    total = lambda table: np.diff(np.append(0, np.cumsum(table))[w.offsets])
    size = np.maximum(np.diff(w.offsets), 1)

    whole = forms.plain()
    insult = np.isin(whole, _INSULTS)
    masked, spelled = forms.unmasked()
    hidden = np.zeros(len(w), bool)
    hidden[masked[np.isin(spelled, _INSULTS)]] = True
    hidden &= ~insult
    insult |= hidden
    weight = np.zeros(len(w), np.float32)
    for length, table in lexicon.items():
        np.maximum(weight, table(whole if not length else forms.plain(length)), out=weight)
    top = np.zeros(rows, np.float32)
    on = np.flatnonzero(weight)
    np.maximum.at(top, owner[on], weight[on])

    person = np.isin(whole, _PERSONS)
    # a person within NEAR words of the same text, on either side
    seen = np.append(0, np.cumsum(person))
    at = np.arange(len(w))
    low = np.maximum(at - NEAR, w.first[:-1][owner])
    high = np.minimum(at + NEAR + 1, w.first[1:][owner])
    bad = insult | (weight > 0)
    near = bad & (seen[high] > seen[low])

    letters = np.maximum(total(_LETTER[data]), 1)
    capital = np.append(0, np.cumsum(_UPPER[data]))
    span = forms.ends - forms.starts  # without outer punctuation
    shouted = (span > 2) & (capital[forms.ends] - capital[forms.starts] == span)
    twice = np.zeros(len(data), bool)
    twice[1:] = _MARK[data[1:]] & _MARK[data[:-1]]
    drawn = np.zeros(len(data), bool)
    drawn[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & _LETTER[data[2:]] & (data[2:] < 128)
    insults, learned, bads = per(insult), per(weight), per(bad)
    return np.stack([
        np.log1p(w.counts), insults / n, np.log1p(insults), learned / n, np.log1p(learned), per(weight > 0) / n, top,
        per(person) / n, per(near) / n, per(near) / np.maximum(bads, 1), total(_UPPER[data]) / letters, per(shouted) / n,
        total(_MARK[data]) / n, total(twice) / n, total(_SIGN[data]) / size, per(hidden) / n,
        np.bincount(owner[masked], minlength=rows) / n, total(drawn) / n, total(data >= 128) / size,
        per(w.ends - w.starts) / n], 1).astype(np.float32)


@dataclass
class Model:
    """A lexicon of learned units, trees over binned features, and the calibration."""

    base: float = 0.0
    lexicon: dict[int, Table] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.edges)
        out = np.zeros(len(x))
        for feature, cut, leaf in self.trees:
            out += leaf[_leaf(binned, feature, cut)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.base)
        raw = self.raw(x)
        logistic = 1 / (1 + np.exp(-raw))
        if self.knots is None:
            return logistic
        # a small share of the uncalibrated score keeps the order inside flat parts
        return 0.99 * np.interp(raw, *self.knots) + 0.01 * logistic


DEPTH, TREES, RATE, BINS, MIN_LEAF = 3, 80, 0.15, 32, 8


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)], 1).astype(np.int64)


def _leaf(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row in a complete tree whose inner nodes are numbered by level."""
    node = np.zeros(len(binned), np.int64)
    at = np.arange(len(binned))
    for _ in range(DEPTH):
        node = 2 * node + 1 + (binned[at, feature[node]] > cut[node])
    return node - (2**DEPTH - 1)


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Boosted trees for the logistic loss, on histograms of quantile bins, with second-order leaf values."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    binned = _binned(x, edges)
    width = BINS + 1
    flat = binned + np.arange(x.shape[1]) * width
    prior = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    raw = np.full(len(y), prior)
    trees = []
    for turn in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature = np.zeros(2**DEPTH - 1, np.int64)
        cut = np.full(2**DEPTH - 1, width)  # all rows to the left unless a split gains
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            cells = ((node - first)[:, None] * (x.shape[1] * width) + flat).ravel()
            hist = [np.bincount(cells, np.repeat(v, x.shape[1]), many * x.shape[1] * width).reshape(many, -1, width).cumsum(2)
                    for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (gt, ht, nt) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < MIN_LEAF) | (nt - nl < MIN_LEAF)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                if gain.reshape(many, -1)[k, best[k]] > 1e-3:
                    feature[first + k], cut[first + k] = best[k] // width, best[k] % width
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        trees.append((feature, cut, value + (prior if turn == 0 else 0.0)))
        raw += value[leaf]
    return edges, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of labels to scores by pooling adjacent violators: knots of scores and values."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, label in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([label, 1.0, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at, n, s = (np.array([p[i] for p in pools]) for i in range(3))
    # pulled a little towards the middle, as a pool of few rows is never certain
    return s / n, (at + 0.1) / (n + 0.2)


def _unit_counts(batches):
    """(length, hash, toxic texts, clean texts) of every unit of a batch of labelled texts."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for row, end, data, offsets in blocks(batch.column("text")):
            forms = Forms(data, offsets)
            owner = forms.words.owners()
            for length in UNIT_LENGTHS:
                h = forms.plain(length)
                pick = np.unique(mix(h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
                pick = pick[h[pick] != 0]
                keys, inverse = np.unique(h[pick], return_inverse=True)
                bad = toxic[row:end][owner[pick]]
                counts = np.bincount(inverse, bad, len(keys)).astype(np.int64)
                both = np.bincount(inverse, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), length, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts),
                     pa.array(both - counts)], ["length", "hash", "toxic", "clean"])


def learn_units(examples: DataFrame) -> dict[int, Table]:
    """The units of labelled texts that toxic ones have far oftener: at most MAX_UNITS, by their log odds."""
    counts = examples.select("text", "toxic").mapInArrow(_unit_counts, "length int, hash bigint, toxic bigint, clean bigint")
    counts = counts.groupBy("length", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = examples.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, good = float(totals[0] or 0), float(totals[1] - (totals[0] or 0))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = (counts.where(F.col("toxic") >= MIN_UNIT_TEXTS).withColumns({"odds": odds, "z": z})
           .where((F.col("z") >= MIN_UNIT_Z) & (F.col("odds") >= MIN_UNIT_ODDS))
           .orderBy(F.desc("z"), "length", "hash").limit(MAX_UNITS).collect())
    out = {}
    for length in UNIT_LENGTHS:
        own = [r for r in top if r["length"] == length]
        if own:
            out[length] = Table(np.array([r["hash"] for r in own], np.int64).view(np.uint64),
                                np.array([r["odds"] for r in own], np.float32))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_column(text: Column, lexicon: dict[int, Table]) -> Column:
    @F.arrow_udf("array<float>")
    def features_of(texts: pa.Array) -> pa.Array:
        parts = [features(Forms(d, o), lexicon) for _, _, d, o in blocks(texts)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)
        ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))

    return features_of(text)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled texts that are not held out."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id"))))
    place = F.xxhash64("doc_id", F.lit(17))
    sample = known.orderBy(place, "doc_id").limit(SAMPLE_ROWS).withColumn("part", F.pmod(place, F.lit(10)))
    # at most SAMPLE_ROWS rows of three numbers
    examples = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "part")
    lexicon = learn_units(examples.where("part < 4"))
    rows = examples.where("part >= 4").select("toxic", "part", _feature_column(F.col("text"), lexicon).alias("x")).toArrow()
    y = rows["toxic"].to_numpy().astype(np.float64)
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES)) if len(y) else None
    if not 0 < y.sum() < len(y):
        return Model(base=float(y.mean()) if len(y) else 0.0)
    # in an order of their own, so that how Spark dealt the rows out does not show
    order = np.lexsort((y, *x.T))
    x, y, part = x[order], y[order], rows["part"].to_numpy()[order]
    trained = part < 8
    if not 0 < y[trained].sum() < trained.sum():
        trained[:] = True
    model = Model(float(y.mean()), lexicon)
    model.edges, model.trees = fit_trees(x[trained], y[trained])
    rest = ~trained
    if 0 < y[rest].sum() < rest.sum():
        model.knots = isotonic(model.raw(x[rest]), y[rest])
    return model


def score(text: Column, model: Model) -> Column:
    """The score of a text, from 0 to 1."""
    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        parts = [model.score(features(Forms(d, o), model.lexicon)) for _, _, d, o in blocks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score_of.asNondeterministic()(text)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(documents, labels)
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score")
                            ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows below the threshold, with all their columns as they were."""
    s = fresh_name(documents, "_score")
    return documents.withColumn(s, score(F.col("text"), fit(documents, labels))).where(F.col(s) < THRESHOLD).drop(s)
