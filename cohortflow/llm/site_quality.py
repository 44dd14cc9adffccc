"""Quality classifier with site evidence, by hierarchical empirical Bayes.

A logistic model over text rates gives every document a probability.  Hosts
and paths gather these by grouped sums; a host's mean is shrunk toward the
global one, a path's toward its host's, with as many pseudo-documents as the
spread between sites (method of moments) warrants.  A document's posterior
log odds are its own plus the shift that its path's posterior has against the
global prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import map_texts, sample_filter
from cohortflow.llm.features import DENSE, Batch, dense
from cohortflow.sources.cube_store import materialize


@dataclass(frozen=True)
class SiteParams:
    """``labelled``: bound of the labelled rows that the document model is fit
    on.  ``site_weight``: share of the site's shift that enters the posterior.
    ``threshold``: lowest posterior that is kept.  ``broadcast_sites``: up to
    so many paths the site table is broadcast, beyond it is joined by shuffle
    with salted keys (``salts`` per path)."""

    labelled: int = 20_000
    site_weight: float = 0.5
    threshold: float = 0.35
    broadcast_sites: int = 100_000
    salts: int = 32


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray         # the last is the intercept

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.column_stack([z, z ** 2 - 1])
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> Logistic:
    """Newton's method on standardised rates and their squares."""
    if len(y) == 0:
        x, y = np.zeros((2, x.shape[1])), np.array([0.0, 1.0])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.column_stack([z, z ** 2 - 1, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(y) * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (q - y) + penalty @ w
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


def labelled_rates(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Rates and labels of at most about ``bound`` labelled documents."""
    chosen = sample_filter(labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
                           .select("doc_id", F.col(target).alias("label")).dropDuplicates(["doc_id"]),
                           F.col("doc_id"), bound)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def step(batch, texts):
        return {"doc_id": batch.column(0), "label": batch.column(2), "x": list(dense(Batch.of(texts)))}

    rows = map_texts(texts.select("doc_id", "text", F.col("label").cast("double").alias("label")), step,
                     "doc_id long, label double, x array<double>").orderBy("doc_id", "x").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(DENSE))
    return x, rows["label"].to_numpy(dtype=float)


def with_logits(docs: DataFrame, model: Logistic, columns: list[str]) -> DataFrame:
    """The ``columns`` of ``docs`` and each document's ``logit``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)

    def step(batch, texts):
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        return cols | {"logit": model.logits(dense(Batch.of(texts)))}

    inner = docs.select(*columns) if "text" in columns else docs.select(*columns, "text")
    return map_texts(inner, step, f"{schema}, logit double")


def _shrunk(total: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (total + prior * strength) / (n + strength)


def _strength(mean: Column, spread: Column, n: Column) -> Column:
    """Pseudo-documents for site means of this spread (variance, weighted by
    documents) at a mean of ``n`` documents: mean (1 - mean) / excess - 1."""
    noise = mean * (1 - mean) / F.greatest(n, F.lit(1.0))
    excess = F.greatest(spread - noise, mean * (1 - mean) * 1e-3, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / excess - 1, F.lit(1.0)), F.lit(1e4))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, n, host_posterior, path_posterior, prior from ``scored``
    (host, path, logit).  Sums by path first (partial sums before the
    shuffle), then by host and globally over the sums only."""
    paths = materialize(scored.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum(1 / (1 + F.exp(-F.col("logit")))).alias("total")), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"),
                                      F.sum(F.col("total") * F.col("total") / F.col("n")).alias("squares"),
                                      F.count("*").alias("k"))
    whole = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_total").alias("all_total"),
                      F.sum(F.col("host_total") * F.col("host_total") / F.col("host_n")).alias("host_squares"),
                      F.sum("squares").alias("path_squares"), F.count("*").alias("hosts"), F.sum("k").alias("paths"))
    r = whole.first()                                    # one row of sums
    if not r["all_n"]:
        return paths.select("host", "path", "n", *[F.lit(0.5).alias(c) for c in (
            "host_posterior", "path_posterior", "prior")])
    prior = r["all_total"] / r["all_n"]
    c = lambda v: F.lit(float(v))
    host_strength = _strength(c(prior), c(r["host_squares"] / r["all_n"] - prior ** 2), c(r["all_n"] / r["hosts"]))
    path_strength = _strength(c(prior), c((r["path_squares"] - r["host_squares"]) / r["all_n"]),
                              c(r["all_n"] / r["paths"]))
    # sums by host joined back: a host with very many paths is no single task
    return (paths.join(hosts.select("host", "host_n", "host_total"), "host")
            .withColumn("host_posterior", _shrunk(F.col("host_total"), F.col("host_n"), c(prior), host_strength))
            .withColumn("path_posterior", _shrunk(F.col("total"), F.col("n"), F.col("host_posterior"), path_strength))
            .select("host", "path", "n", "host_posterior", "path_posterior", c(prior).alias("prior")))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, columns: list[str],
             params: SiteParams | None = None) -> DataFrame:
    """The ``columns`` of every row of ``docs`` with evidence (the document's
    own log odds), host_posterior, path_posterior, score (0 to 1) and kept.

    ``docs`` has doc_id and text; ``labels`` doc_id and quality (0 or 1;
    nulls are left out); ``host`` and ``path`` are expressions over ``docs``.
    Null hosts and paths count as one empty name each; null and empty texts
    have all rates 0; repeated rows stay and count; labels of unknown
    documents do nothing; with no labels every evidence is the same; no rows
    give no rows.  Clashing columns of ``docs`` outside ``columns`` have no
    effect."""
    p = params or SiteParams()
    x, y = labelled_rates(docs, labels, "quality", p.labelled)
    model = fit_logistic(x, y)
    named = docs.withColumn("_host", F.coalesce(host.cast("string"), F.lit(""))).withColumn(
        "_path", F.coalesce(path.cast("string"), F.lit("")))
    # every text is scored once; what follows reads the scored rows
    scored = materialize(with_logits(named, model, [*columns, "_host", "_path"]), "scored")
    sites = site_posteriors(scored.select(
        F.col("_host").alias("host"), F.col("_path").alias("path"), "logit")).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "host_posterior", "path_posterior", "prior")
    sites = materialize(sites, "sites")
    if sites.count() <= p.broadcast_sites:
        met = scored.join(F.broadcast(sites), ["_host", "_path"])
    else:
        salted = scored.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(p.salts)))
        met = salted.join(sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1)).cast(
            "array<bigint>"))), ["_host", "_path", "_salt"])
    odds = F.col("logit") + p.site_weight * (_logit(F.col("path_posterior")) - _logit(F.col("prior")))
    score = 1 / (1 + F.exp(-odds))
    return met.select(*columns, F.col("logit").alias("evidence"), "host_posterior", "path_posterior",
                      score.alias("score"), (score >= p.threshold).alias("kept"))
