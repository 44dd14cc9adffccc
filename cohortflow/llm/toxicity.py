"""Toxicity by gradient-boosted trees over dense features.

Features: densities of a seed lexicon and of learned lexicons (whole words and
sequences of four and of six letters within words, hashed and weighted by
their log odds in labelled rows), lexicon words near second-person pronouns, capitals,
punctuation and obfuscation rates.  The labelled rows (a bounded sample) are
dealt by hash into three parts: one teaches the lexicons, one the trees, one
the isotonic calibration, so that no step judges rows that it has learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import arrow_schema, map_texts, record_batch, sample_filter
from cohortflow.llm.features import DENSE, Batch, dense
from cohortflow.llm.pieces import LETTER
from cohortflow.sources.cube_store import materialize

#: common insults, and second-person pronouns, of the languages at hand
SEED = ("idiot idiots stupid moron morons loser losers trash scum clown pathetic worthless disgusting dumb jerk "
        "imbecile idiota estupido basura imbecil asqueroso inutil payaso stupide imbecile ordure minable "
        "degoutant debile abruti dumm dummkopf trottel abschaum widerlich wertlos versager").split()
SECOND_PERSON = ("you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
                 "usted ustedes vosotros tus ti").split()
NEAR = 5
GRAMS = (4, 6)

FEATURES = ("seed", "seed_count", "word_lexicon", "word_top", "word_count", "near_you", "you",
            *[f"{name}_{n}" for n in GRAMS for name in ("gram_lexicon", "gram_top", "gram_count")], *DENSE)


@dataclass(frozen=True)
class ToxicityParams:
    """``labelled``: bound of the labelled rows that are learned from.
    ``bits``: buckets of each lexicon are 2 ** bits.  ``support``: toxic
    documents that a lexicon entry needs.  ``least``: its lowest log odds.
    ``threshold``: score from which a document counts as toxic."""

    labelled: int = 24_000
    bits: int = 18
    support: int = 4
    least: float = 2.0
    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    threshold: float = 0.3


def _hash_words(words) -> np.ndarray:
    b = Batch.of(list(words))
    return np.sort(b.h)


_SEED, _YOU = _hash_words(SEED), _hash_words(SECOND_PERSON)


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def letter_runs(b: Batch, bits: int):
    """Of the lower-cased letter runs: hash and text; and (bucket, text) of the
    runs themselves and of all their letter sequences, a pair per kind."""
    low = b.lower()
    starts, ends = tb.runs(b.kinds() == LETTER, b.offsets)
    h = tb.run_hashes(low, starts, ends)
    of = tb.owner(starts, b.offsets)
    shift = np.uint64(64 - bits)
    kinds = [((h >> shift).astype(np.int64), of)]
    for n in GRAMS:
        size = np.maximum(0, ends - starts - n + 1)
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        kinds.append(((tb.run_hashes(low, at, at + n) >> shift).astype(np.int64), np.repeat(of, size)))
    return h, of, kinds


@dataclass(frozen=True)
class Lexicons:
    """Weight per bucket, 0 if not an entry: of words, then of each of GRAMS."""

    tables: tuple


def rates(b: Batch, lexicons: Lexicons, bits: int) -> np.ndarray:
    """A row of FEATURES per text; zeros for an empty text."""
    h, of, kinds = letter_runs(b, bits)
    n = b.n
    words = np.maximum(1, np.bincount(of, minlength=n))
    seed, you = _member(h, _SEED), _member(h, _YOU)

    def found(table, bucket, text):
        weight = table[bucket]
        hit, top = weight > 0, np.zeros(n)
        np.maximum.at(top, text[hit], weight[hit])
        return hit, np.bincount(text[hit], weights=weight[hit], minlength=n) / words, top, np.bincount(
            text[hit], minlength=n)

    (hit, density, top, hits), *grams = [found(t, *k) for t, k in zip(lexicons.tables, kinds)]
    # lexicon words within NEAR words of a second-person pronoun of the same text
    places = np.flatnonzero(you)
    bad = np.flatnonzero(seed | hit)
    close = np.zeros(len(bad), dtype=bool)
    if len(places) and len(bad):
        for other in (np.searchsorted(places, bad) - 1, np.searchsorted(places, bad)):
            k = np.clip(other, 0, len(places) - 1)
            close |= (np.abs(places[k] - bad) <= NEAR) & (of[places[k]] == of[bad])
    count = lambda f, o: np.bincount(o[f], minlength=n)
    cols = [count(seed, of) / words, count(seed, of), density, top, hits,
            np.bincount(of[bad[close]], minlength=n) / words, count(you, of) / words]
    for _, gram_density, gram_top, gram_hits in grams:
        cols += [gram_density, gram_top, gram_hits / words]
    return np.column_stack([*[np.asarray(c, dtype=np.float64) for c in cols], dense(b)])


def learn_lexicons(rows: DataFrame, p: ToxicityParams) -> Lexicons:
    """Entries and log odds from labelled rows (text, label): documents of
    either label that have a bucket, summed over all tasks."""
    schema = "kind int, bucket int, toxic long, clean long"
    target = arrow_schema(rows.sparkSession, schema)
    size = 1 << p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 + len(GRAMS), 2, size), dtype=np.int32)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for lo, hi in tb.steps(texts):
                n += np.bincount(labels[lo:hi], minlength=2)
                for k, (bucket, text) in enumerate(letter_runs(Batch.of(texts[lo:hi]), p.bits)[2]):
                    once = np.unique(text * size + bucket)
                    for y in (0, 1):
                        chosen = once[labels[lo:hi][once // size] == y] % size
                        seen[k, y] += np.bincount(chosen, minlength=size)
        if n.sum():
            yield record_batch({"kind": [-1], "bucket": [0], "toxic": [n[1]], "clean": [n[0]]}, target)
            for k in range(len(seen)):
                at = np.flatnonzero(seen[k, 0] | seen[k, 1])
                yield record_batch({"kind": np.full(len(at), k, np.int32), "bucket": at.astype(np.int32),
                                    "toxic": seen[k, 1][at], "clean": seen[k, 0][at]}, target)

    found = (rows.select("text", "label").mapInArrow(run, schema).groupBy("kind", "bucket")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where(f"kind = -1 or toxic >= {p.support}").toPandas())
    whole = found[found["kind"] == -1]
    toxic, clean = (int(whole[c].sum()) for c in ("toxic", "clean"))
    tables = []
    for k in range(1 + len(GRAMS)):
        f = found[found["kind"] == k]
        w = np.log((f["toxic"] + 0.5) / (toxic + 1)) - np.log((f["clean"] + 0.5) / (clean + 1))
        table = np.zeros(size, dtype=np.float64)
        table[f["bucket"].to_numpy(dtype=np.int64)] = np.where(w >= p.least, w, 0.0)
        tables.append(table)
    return Lexicons(tuple(tables))


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray     # per inner node, breadth first; -1: no split
    cut: np.ndarray
    value: np.ndarray       # per leaf

    def apply(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while node.size and node[0] < len(self.feature):
            f = self.feature[node]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node])
            node = 2 * node + 1 + right
        return self.value[node - len(self.feature)]


def _grow(x, bins, cuts, grad, hess, depth: int, ridge: float = 1.0) -> Tree:
    """One tree by histograms of gradient sums."""
    inner = 2 ** depth - 1
    feature, cut = np.full(inner, -1), np.zeros(inner)
    node = np.zeros(len(x), dtype=np.int64)
    width = max(len(c) for c in cuts) + 1
    for i in range(inner):
        rows = np.flatnonzero(node == i)
        best = 1e-6
        g, h = grad[rows].sum(), hess[rows].sum()
        for f in range(x.shape[1]) if len(rows) > 20 else ():
            gl = np.cumsum(np.bincount(bins[rows, f], weights=grad[rows], minlength=width))[:-1]
            hl = np.cumsum(np.bincount(bins[rows, f], weights=hess[rows], minlength=width))[:-1]
            ok = (hl > 1.0) & (h - hl > 1.0)
            gain = np.where(ok, gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge), 0)
            k = int(gain[:len(cuts[f])].argmax()) if len(cuts[f]) else -1
            if k >= 0 and gain[k] > best:
                best, feature[i], cut[i] = gain[k], f, cuts[f][k]
        right = (x[rows, feature[i]] > cut[i]) if feature[i] >= 0 else np.zeros(len(rows), bool)
        node[rows] = 2 * i + 1 + right
    leaf = node - inner
    g = np.bincount(leaf, weights=grad, minlength=inner + 1)
    h = np.bincount(leaf, weights=hess, minlength=inner + 1)
    return Tree(feature, cut, -g / (h + ridge))


def fit_trees(x: np.ndarray, y: np.ndarray, p: ToxicityParams) -> tuple[float, list[Tree]]:
    """Base margin and trees of a boosted logistic model."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return float(np.log(share / (1 - share))), []
    base = float(np.log(y.mean() / (1 - y.mean())))
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 40))) for c in x.T]
    cuts = [np.unique(np.append(c, [0.0])) if (col == 0).any() else c for c, col in zip(cuts, x.T)]
    bins = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])
    margin, trees = np.full(len(y), base), []
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(x, bins, cuts, q - y, q * (1 - q), p.depth)
        margin += p.rate * tree.apply(x)
        trees.append(tree)
    return base, trees


def margins(x: np.ndarray, base: float, trees: list[Tree], rate: float) -> np.ndarray:
    return base + rate * sum((t.apply(x) for t in trees), np.zeros(len(x)))


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit (pool adjacent violators), with
    half an observation of either label in every pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []                       # sum, size, low, high
    for s, v in zip(score[order], y[order]):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and (pools[-2][0] + .05) / (pools[-2][1] + .1) >= (pools[-1][0] + .05) / (pools[-1][1] + .1):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    if not pools:
        return np.array([0.0]), np.array([0.5])
    knots = np.array([k for q in pools for k in (q[2], q[3])])
    level = np.maximum.accumulate(np.array([(q[0] + .05) / (q[1] + .1) for q in pools for _ in (0, 1)]))
    return knots, level


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    lexicons: Lexicons
    base: float
    trees: list
    knots: np.ndarray
    levels: np.ndarray

    def scores(self, texts: list) -> np.ndarray:
        """Calibrated scores of texts, between 0 and 1."""
        x = rates(Batch.of(texts), self.lexicons, self.params.bits)
        m = margins(x, self.base, self.trees, self.params.rate)
        # the margin's own curve breaks ties within a calibrated level
        return np.clip(0.98 * np.interp(m, self.knots, self.levels) + 0.02 / (1 + np.exp(-m)), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> ToxicityModel:
    """A model from at most about ``params.labelled`` rows of ``labels``
    (doc_id, toxic; nulls are left out, repeated ids count once) and their
    texts in ``docs`` (doc_id, text)."""
    p = params or ToxicityParams()
    chosen = sample_filter(
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")), F.col("doc_id"), p.labelled)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(20))), "labelled")
    lexicons = learn_lexicons(rows.where("part < 8"), p)
    held = docs.sparkSession.sparkContext.broadcast(lexicons)

    def step(batch, texts):
        return {"doc_id": batch.column(0), "label": batch.column(2), "part": batch.column(3),
                "x": list(rates(Batch.of(texts), held.value, p.bits))}

    got = map_texts(rows.where("part >= 8").select("doc_id", "text", "label", "part"), step,
                    "doc_id long, label int, part long, x array<double>").orderBy("doc_id", "x").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    y, part = got["label"].to_numpy(dtype=float), got["part"].to_numpy()
    learn = part < 15
    base, trees = fit_trees(x[learn], y[learn], p)
    knots, levels = fit_isotonic(margins(x[~learn], base, trees, p.rate), y[~learn])
    return ToxicityModel(p, lexicons, base, trees, knots, levels)


def score_documents(docs: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """The ``columns`` of every row of ``docs`` with its score (by its text
    alone; null counts as empty) and predicted (0 or 1).  Repeated rows stay;
    other columns are ignored; no rows give no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    threshold = model.params.threshold

    def step(batch, texts):
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        s = held.value.scores(texts)
        return cols | {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    inner = docs.select(*columns) if "text" in columns else docs.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)
    return map_texts(inner, step, f"{schema}, score double, predicted int")
