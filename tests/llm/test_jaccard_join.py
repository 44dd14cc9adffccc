import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortflow.llm import jaccard_join as J

W = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=4):
    w = W.findall((text or "").translate(LOW))
    if len(w) >= words:
        return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1))
    return frozenset([tuple(w)] if w else [])


def plain(rows, words=4, percent=85):
    """Component of every row by comparing all pairs that share a shingle."""
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in held[g])
        for j, k in met.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
        for g in s:
            held[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def got(df, params=None):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                  for r in J.jaccard_components(df, params).collect())


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got(documents) == plain(rows)


def test_edges(edge, none):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert got(edge) == plain(rows)
    assert got(none) == []


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(f"y{rng.randrange(500)}" for _ in range(40))) for i in range(40)]
    return rows


@pytest.mark.parametrize("bound", [1024, 40])
def test_a_large_group_of_near_copies(spark, bound):
    """The second bound forces the slices of large regions."""
    rows = near_copies(160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = J.JaccardParams(region_nodes=bound, cell_nodes=12)
    assert got(df, p) == plain(rows)


def test_id_lookup_by_shuffle(spark):
    rows = near_copies(30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, J.JaccardParams(broadcast_ids=0)) == plain(rows)


def test_voronoi_cells_lose_no_link():
    rng = random.Random(8)
    sets = []
    for g in range(12):
        base = [rng.randrange(1 << 40) for _ in range(60)]
        for _ in range(15):
            s = set(base)
            for x in rng.sample(base, rng.randrange(0, 9)):
                s.discard(x)
                s.add(rng.randrange(1 << 40))
            sets.append(np.array(sorted(s), dtype=np.uint64))
    parts = J._Parts(len(sets))
    J.voronoi_join(sets, list(range(len(sets))), J.JaccardParams(cell_nodes=8), parts)
    want = J._Parts(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.link(i, j)
    roots = lambda p: [min(j for j in range(len(sets)) if p.find(j) == p.find(i)) for i in range(len(sets))]
    assert roots(parts) == roots(want)


def test_keep_one(spark):
    rows = near_copies(30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for _, _, c in plain(rows, 5, 80)}
    kept = J.keep_one(df, J.JaccardParams(words=5, percent=80))
    assert {str(r.doc_id) for r in kept.collect()} == want


def plain_links(rows, words=4, percent=85):
    """Every row's number of links by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    n = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= percent * (len(a) + len(sets[j]) - k):
                n[i] += 1
                n[j] += 1
    return sorted((str(d), len(s), k) for (d, _), s, k in zip(rows, sets, n))


def got_links(df, params=None):
    out = J.jaccard_components(df, params, count_links=True).collect()
    assert all(r.n_links == 0 for r in out if r.n_shingles == 0)
    return sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in out), sorted(
        (str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out)


@pytest.mark.parametrize("bound", [1024, 40])
def test_every_link_is_counted_once(spark, bound):
    """Near copies in one group and in chains, with copies of some of them,
    in many regions; the second bound forces slices."""
    rows = near_copies(160)
    rows += [(1000 + i, rows[i % 7][1]) for i in range(20)] + [(None, rows[3][1]), (5, rows[5][1]), (1, rows[90][1])]
    words = [f"z{i}" for i in range(200)]
    rows += [(2000 + i, " ".join(words[i:i + 90])) for i in range(0, 110)] + [(3000, None), (3001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, parts = got_links(df, J.JaccardParams(region_nodes=bound, cell_nodes=12))
    assert links == plain_links(rows)
    assert parts == plain(rows)


def test_links_of_documents_and_edges(documents, edge, none):
    for df in (documents, edge):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert got_links(df)[0] == plain_links(rows)
    assert got_links(none) == ([], [])


@pytest.mark.parametrize("by_broadcast", [500_000, 0])
def test_keep_one_row_of_repeated_rows_reused_ids_and_null_ids(spark, by_broadcast):
    base = near_copies(12)
    a, b = [" ".join(f"{k}{i}" for i in range(60)) for k in "ab"]
    rows = base + [base[0]] * 3 + [base[2]] * 2           # repeated rows, of the first and of another
    rows += [(20, a), (5, a), (5, base[7][1]), (5, b), (6, b)]      # ids with different texts
    rows += [(None, base[1][1])] * 2 + [(None, "no id " + b)] * 3 + [(None, "c " * 40)] * 4
    rows += [(None, "C  " * 40), (7, "d e f g h"), (7, "D e f g h"), (8, None), (8, None), (None, "")]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, node int")
    sets = [shingles(t, 5) for _, t in rows]
    up = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            k = len(s & sets[j])
            if s and sets[j] and 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                old, new = up[i], up[j]
                up = [new if u == old else u for u in up]
    of = defaultdict(set)
    for i, u in enumerate(up):
        of[rows[i]].add(u)
    kept = [(r.doc_id, r.text) for r in J.keep_one(
        df, J.JaccardParams(words=5, percent=80, broadcast_ids=by_broadcast)).select("doc_id", "text").collect()]
    empty = [r for r, s in zip(rows, sets) if not s]
    assert sorted((r for r in kept if r in empty), key=str) == sorted(empty, key=str)
    kept = [r for r in kept if r not in empty]
    groups = [min(of[r]) for r in kept]
    assert sorted(groups) == sorted({u for u, s in zip(up, sets) if s})      # one row for each group
    for (d, _), u in zip(kept, groups):
        ids = [rows[i][0] for i in range(len(rows)) if up[i] == u and rows[i][0] is not None]
        assert d == (min(ids) if ids else None)


def test_copies_are_one_entry(spark):
    """A text that is a third of all rows enters no region more than once."""
    from cohortflow.llm import jaccard_join as J
    rows = [(i, "one two three four five six seven eight nine ten " * 3) for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(600)]
    rows += [(5000, "one two three four five six seven eight nine ten " * 3 + "eleven")]
    p = J.JaccardParams()
    keyed = J.document_keys(spark.createDataFrame(rows, "doc_id long, text string"), p).cache()
    nodes = J.distinct_nodes(keyed)
    hot = nodes.orderBy("copies", ascending=False).first()
    assert nodes.count() == 602 and (hot.copies, hot.doc_id) == (300, 0)
    assert J.region_members(nodes).count() == 2
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string"), p, count_links=True).collect()}
    assert got[7] == (0, 300) and got[5000] == (0, 300) and got[1003] == (1003, 0)
