import re
from collections import Counter

import numpy as np

from cohortflow.llm import importance as I
from cohortflow.llm import site_quality as Q
from cohortflow.llm import toxicity as T
from pyspark.sql import functions as F

W = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = W.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    again = {j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(again), failed


def test_rules_and_ratio(documents, labels, texts):
    good = labels.where("quality = 1")
    rows = {r.doc_id: r for r in I.quality_rules(documents, good).collect()}
    assert len(rows) == len(texts)
    for d, r in rows.items():
        assert tuple(r)[1:7] == base(texts[d])
        assert r.kept == (not r.base_failed and r.score >= I.ImportanceParams().threshold)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(quality[d], r.kept) for d, r in rows.items() if d in quality and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.97
    assert np.mean([k for q, k in judged if q == 0] or [0]) < 0.2


def test_ratio_by_hand(documents, labels, texts):
    """Scores equal a plain count over hashed n-grams."""
    p = I.ImportanceParams(bits=6)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    grams = {}
    for d, t in texts.items():
        bucket, _ = I.hashed_ngrams(I.Batch.of([t]), p.bits)
        grams[d] = bucket.tolist()
        raw.update(grams[d])
        if d in good:
            target.update(grams[d])
    def ratio(b):
        lo, hi = (0, 64) if b < 64 else (64, 128)
        share = [(1 - p.smoothing) * c[b] / sum(c[x] for x in range(lo, hi)) + p.smoothing / 64 for c in (target, raw)]
        return np.log(share[0] / share[1])
    for r in I.quality_rules(documents, labels.where("quality = 1"), p).collect():
        want = np.mean([ratio(b) for b in grams[r.doc_id]]) if grams[r.doc_id] else 0.0
        assert abs(r.score - want) < 1e-9


def test_every_trusted_row_is_counted(spark):
    """Over 50,000 trusted ids, some twice, null or unknown; rows without an
    id or with a repeated one: counts are those of plain sums."""
    p = I.ImportanceParams(bits=4)
    rows = [*range(51_000), 0, 1, 2]
    docs = spark.createDataFrame([(None if i % 10_000 == 7 else i, f"w{i % 97}") for i in rows], "doc_id long, text string")
    good = [i for i in range(51_500) if i % 1000] + [1, 1, -1, None]
    kept = [i for i in rows if i % 1000 and i % 10_000 != 7]
    assert len(set(kept)) > 50_000
    grams = [np.bincount(I.hashed_ngrams(I.Batch.of([f"w{k}"]), p.bits)[0], minlength=32) for k in range(97)]
    want = [sum(n * grams[k] for k, n in Counter(i % 97 for i in of).items()) for of in (rows, kept)]
    got = I.corpus_counts(docs, spark.createDataFrame([(i,) for i in good], "doc_id int"), p)
    assert (got == np.array(want)).all()


def test_trusted_rows_without_a_filter(spark, monkeypatch):
    """Ids too many for a filter: the join alone gives the same rows."""
    docs = spark.createDataFrame([(i % 5 or None, str(i)) for i in range(20)], "doc_id long, text string")
    good = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "doc_id long")
    want = sorted((i % 5, str(i)) for i in range(20) if i % 5 in (1, 3))
    assert sorted(map(tuple, I.trusted_rows(docs, good).collect())) == want
    assert I.trusted_rows(docs, good.where("doc_id = 9")).count() == 0
    monkeypatch.setattr(I.BloomShape, "of", lambda n: None)
    assert sorted(map(tuple, I.trusted_rows(docs, good).collect())) == want


def test_edges(spark, edge, none, labels):
    no_labels = labels.where("1 = 0")
    rows = I.quality_rules(edge, no_labels).collect()
    assert len(rows) == edge.count() and all(r.score == 0 for r in rows)
    assert I.quality_rules(none, labels).count() == 0
    for ls in (labels, no_labels):
        judged = Q.classify(edge, ls, F.col("source"), F.col("lang"), ["doc_id"]).collect()
        assert len(judged) == edge.count() and all(0 <= r.score <= 1 for r in judged)
        model = T.train(edge, ls)
        scored = T.score_documents(edge, model, ["doc_id", "text"]).collect()
        assert len(scored) == edge.count() and all(0 <= r.score <= 1 for r in scored)
    assert Q.classify(none, labels, F.col("source"), F.col("lang"), ["doc_id"]).count() == 0
    assert T.score_documents(none, T.train(none, labels), ["doc_id"]).count() == 0


def test_classifier_and_sites(documents, labels):
    p = Q.SiteParams()
    got = {r.doc_id: r for r in Q.classify(documents, labels, F.col("source"), F.col("lang"), ["doc_id"], p).collect()}
    assert len(got) == documents.count()
    salted = {r.doc_id: r for r in Q.classify(documents, labels, F.col("source"), F.col("lang"), ["doc_id"],
                                              Q.SiteParams(broadcast_sites=0)).collect()}
    assert all(abs(salted[d].score - r.score) < 1e-9 for d, r in got.items())
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([got[d].kept == (q == 1) for d, q in quality.items()]) > 0.95
    # posteriors by plain sums
    site = {r.doc_id: (r.source, r.lang) for r in documents.collect()}
    prob = {d: 1 / (1 + np.exp(-r.evidence)) for d, r in got.items()}
    prior = np.mean(list(prob.values()))
    means = {}
    for d, s in site.items():
        means.setdefault(s[0], []).append(prob[d])
    for d, r in got.items():
        host = np.mean(means[site[d][0]])
        lo, hi = sorted((host, prior))
        assert lo - 1e-9 <= r.host_posterior <= hi + 1e-9


def test_sparse_sites_shrink_more(spark):
    rows = [("a", "x", 4.0)] * 200 + [("b", "y", -4.0)] * 200 + [("c", "z", -4.0)] * 2
    got = {r.host: r for r in Q.site_posteriors(spark.createDataFrame(rows, "host string, path string, logit double")).collect()}
    assert got["c"].host_posterior > got["b"].host_posterior
    assert got["a"].path_posterior > got["a"].prior > got["b"].path_posterior


def test_trees_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    p = T.ToxicityParams()
    base_margin, trees = T.fit_trees(x[:2000], y[:2000], p)
    m = T.margins(x[2000:], base_margin, trees, p.rate)
    assert ((m > 0) == (y[2000:] > 0)).mean() > 0.95
    knots, level = T.fit_isotonic(m, y[2000:])
    assert (np.diff(knots) >= 0).all() and (np.diff(level) >= 0).all() and 0 <= level[0] and level[-1] <= 1


def test_toxicity_on_labelled_rows(spark, documents):
    rows = [(i, (f"plain words number {i} about the weather and a long walk " * 4)
             + ("you absolute zorgblat " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(df, df.where("doc_id < 600").select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in T.score_documents(df, model, ["doc_id"]).collect()}
    assert np.mean([got[i] == y for i, _, y in rows if i >= 600]) > 0.97
