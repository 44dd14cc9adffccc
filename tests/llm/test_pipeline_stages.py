"""Every stage of the pipeline against a plain version that takes one document
(or all pairs) at a time, and on edge rows."""

import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from cohortflow.llm import secrets, site_quality, toxicity
from cohortflow.llm.queries import held_out

SF001 = "/root/testdata/sf0.001"
COLUMNS = P.COLUMNS
STAGE = dict(P.STAGES)
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(edge):
    """Edge rows with the columns of documents in another order, and more."""
    return edge.select("text", "doc_id", "bucket", "source", "lang", "n_chars", "node", "score")


def rows(df):
    return sorted((str(tuple(r)) for r in df.select(*COLUMNS).collect()))


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_keep_one(docs):
    """One row per group of linked rows: the smallest doc_id (null ones last)."""
    sets = [shingles(r.text) for r in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i) if sets[i] else ("empty", i), []).append(docs[i])
    return groups


def test_near_copies(spark, documents, odd):
    for df in (documents, odd):
        groups = plain_keep_one(df.select(*COLUMNS).collect())
        kept = STAGE["n-gram Jaccard join"](spark, df, SF001)
        assert kept.columns == COLUMNS
        got = Counter(str(tuple(r)) for r in kept.collect())
        assert sum(got.values()) == len(groups)
        for group in groups.values():
            ids = [r.doc_id for r in group if r.doc_id is not None]
            least = [r for r in group if r.doc_id == (min(ids) if ids else None)]
            assert any(got[str(tuple(r))] for r in least)


def test_secrets_are_replaced(spark, documents, odd):
    scanner = secrets.Scanner(secrets.SecretParams())
    for df in (documents, odd):
        want = []
        for r in df.select(*COLUMNS).collect():
            text = r.text
            if text is not None:
                base, added = scanner.scan([text])[0]
                hidden = set()
                firsts, end = set(), -1
                for s, e, _ in sorted(base + added):
                    if s >= end:
                        firsts.add(s)
                    hidden.update(range(s, e))
                    end = max(end, e)
                text = "".join(("[secret]" if i in firsts else "") + ("" if i in hidden else c)
                               for i, c in enumerate(text))
            want.append(str((r.doc_id, text, r.lang, r.source, None if text is None else len(text))))
        done = STAGE["secret scans"](spark, df, SF001)
        assert done.columns == COLUMNS and rows(done) == sorted(want)


def plain_tree(tree, x):
    """The value of the leaf that one row reaches."""
    inner, i = len(tree.feature), 0
    while i < inner:
        f = tree.feature[i]
        i = 2 * i + 1 + (1 if f >= 0 and x[f] > tree.cut[i] else 0)
    return tree.value[i - inner]


def plain_level(m, knots, levels):
    if m <= knots[0]:
        return levels[0]
    for a, b, u, v in zip(knots[:-1], knots[1:], levels[:-1], levels[1:]):
        if m <= b:
            return u if b == a else u + (v - u) * (m - a) / (b - a)
    return levels[-1]


def test_toxic_documents_go(spark, documents, odd, labels):
    import math
    for df in (documents, odd):
        model = toxicity.train(df, labels.where(~held_out()))
        kept = Counter(rows(STAGE["toxicity"](spark, df, SF001)))
        want = Counter()
        for r in df.select(*COLUMNS).collect():
            x = toxicity.rates(toxicity.Batch.of([r.text or ""]), model.lexicons, model.params.bits)[0]
            m = model.base + model.params.rate * sum(plain_tree(t, x) for t in model.trees)
            score = 0.98 * plain_level(m, model.knots, model.levels) + 0.02 / (1 + math.exp(-m))
            if min(1.0, max(0.0, score)) < model.params.threshold:
                want[str(tuple(r))] += 1
        assert kept == want


def test_seed_words_are_counted(labels):
    """The densities over the fixed words by plain counting."""
    words = sorted(toxicity.SEED)[:3]
    text = f"Some words {words[0]} and YOU {words[1].upper()}, {words[0]}! more"
    lex = toxicity.Lexicons(tuple([__import__("numpy").zeros(1 << 10)] * (1 + len(toxicity.GRAMS))))
    x = toxicity.rates(toxicity.Batch.of([text]), lex, 10)[0]
    runs = re.findall("[a-z]+", text.lower())
    bad = [i for i, w in enumerate(runs) if w in toxicity.SEED]
    you = [i for i, w in enumerate(runs) if w in toxicity.SECOND_PERSON]
    near = [i for i in bad if any(abs(i - j) <= toxicity.NEAR for j in you)]
    assert x[0] == len(bad) / len(runs) and x[1] == len(bad)
    assert x[5] == len(near) / len(runs) and x[6] == len(you) / len(runs)


def plain_posteriors(docs, p):
    """docs: (host, path, logit).  Scores by plain sums, as the module's text says."""
    import math
    prob = [1 / (1 + math.exp(-x)) for _, _, x in docs]
    n = len(docs)
    prior = sum(prob) / n
    hosts, paths = {}, {}
    for (h, q, _), v in zip(docs, prob):
        hosts.setdefault(h, []).append(v)
        paths.setdefault((h, q), []).append(v)
    square = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups.values())

    def strength(spread, size):
        noise = prior * (1 - prior) / max(size, 1.0)
        excess = max(spread - noise, prior * (1 - prior) * 1e-3, 1e-9)
        return min(max(prior * (1 - prior) / excess - 1, 1.0), 1e4)

    hs = strength(square(hosts) / n - prior ** 2, n / len(hosts))
    ps = strength((square(paths) - square(hosts)) / n, n / len(paths))
    logit = lambda v: math.log(min(max(v, 1e-4), 1 - 1e-4) / (1 - min(max(v, 1e-4), 1 - 1e-4)))
    out = []
    for h, q, x in docs:
        host = (sum(hosts[h]) + prior * hs) / (len(hosts[h]) + hs)
        path = (sum(paths[h, q]) + host * ps) / (len(paths[h, q]) + ps)
        out.append(1 / (1 + math.exp(-(x + p.site_weight * (logit(path) - logit(prior))))))
    return out


def test_documents_of_low_quality_go(spark, documents, odd, labels):
    p = site_quality.SiteParams()
    for df in (documents, odd):
        x, y = site_quality.labelled_rates(df, labels, "quality", p.labelled)
        model = site_quality.fit_logistic(x, y)
        docs = df.select(*COLUMNS).collect()
        logits = [float(model.logits(site_quality.dense(site_quality.Batch.of([r.text or ""])))[0]) for r in docs]
        scores = plain_posteriors([(r.source or "", r.lang or "", z) for r, z in zip(docs, logits)], p)
        want = Counter(str(tuple(r)) for r, s in zip(docs, scores) if s >= p.threshold)
        assert all(abs(s - p.threshold) > 1e-7 for s in scores)
        assert Counter(rows(STAGE["quality classifier"](spark, df, SF001))) == want


def test_packing_holds_every_token(spark, documents, odd):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (documents, odd):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
            for at in range(0, len(ids), 4096):
                piece = ids[at:at + 4096]
                want[r.doc_id, at, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece)), tuple(piece)] += 1
        done = STAGE["packing"](spark, df, SF001).collect()
        assert Counter((r.doc_id, r.start, r.ids_crc32, tuple(r.ids)) for r in done) == want
        ends = {}
        for r in done:
            ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
        for spans in ends.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= 4096
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("name", list(STAGE))
def test_no_documents(spark, none, name):
    assert STAGE[name](spark, none.select(*COLUMNS), SF001).count() == 0
