from collections import Counter
from hashlib import blake2b, sha256

import pytest

from cohortflow.llm import merkle as M


def digest(data):
    return blake2b(data, digest_size=16).digest()


def plain_tree(text):
    """(root, sections of paragraphs of leaves' texts), without arrays."""
    lines = [x.encode() for x in __import__("re").findall(r"[^\n]*\n|[^\n]+", text)]
    sections, held = [], []
    for line in lines:
        held.append(line)
        if digest(line)[0] % M.SECTION_PARAGRAPHS == 0:
            sections.append(held)
            held = []
    if held:
        sections.append(held)
    root = digest(b"".join(digest(b"".join(digest(x) for x in s)) for s in sections))
    return root, sections


def leaf_codes(line):
    """Codes of one paragraph on its own."""
    codes, _, _ = M.leaf_codes([line.decode()])
    return codes.tolist()


def plain_likeness(a, b):
    """By counting, from the texts: leaves below paragraphs that both have are
    in common, of the others those of equal code."""
    (ra, sa), (rb, sb) = plain_tree(a), plain_tree(b)
    if ra == rb:
        return 1.0
    key = lambda s: tuple(s)
    x, y = Counter(map(key, sa)), Counter(map(key, sb))
    pa = Counter(p for s in (x - y).elements() for p in s)
    pb = Counter(p for s in (y - x).elements() for p in s)
    count = lambda s: sum(len(leaf_codes(p)) for sec in s for p in sec)
    total = count(sa) + count(sb)
    la = Counter(c for p in (pa - pb).elements() for c in leaf_codes(p))
    lb = Counter(c for p in (pb - pa).elements() for c in leaf_codes(p))
    common = total - sum(la.values()) - sum(lb.values()) + 2 * sum((la & lb).values())
    return min(common / total, 1 - 1 / (total + 1))


def check(df):
    rows = sorted(((d, t or "") for d, t in df.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = sorted(map(tuple, M.document_fingerprints(df).collect()), key=str)
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        e = t[:len(t) - k] + following[:k]
        want.append((d, len(t), sha256(e.encode()).hexdigest(), plain_tree(t)[0].hex(), plain_tree(e)[0].hex(),
                     plain_likeness(t, e), plain_likeness(t, following)))
    roots = [(*r[:3], r[3].partition(":")[0], r[4].partition(":")[0], *r[5:]) for r in got]
    for a, b in zip(sorted(roots, key=str), sorted(want, key=str)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-12)
    assert len(roots) == len(want)


def test_documents(documents):
    check(documents)


def test_edges(edge, none):
    check(edge)
    check(edge.where("doc_id = 0"))
    assert M.document_fingerprints(none).count() == 0


def test_many_buckets(spark, monkeypatch):
    rows = [(i * 3, f"text {i} " * (i % 7)) for i in range(90)]
    from cohortflow.llm import ordering
    monkeypatch.setattr(ordering.bucketed, "__defaults__", ("doc_id", 10))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_different_texts_have_different_fingerprints():
    """Also where short codes of single leaves are the same."""
    words = [f"word{i}" for i in range(400_000)]
    assert len({f for lo in range(0, len(words), 50_000) for f in M.fingerprints(words[lo:lo + 50_000])}) == 400_000
    a, b = M.fingerprints(["word1749", "word1847"])
    assert a != b and M.likeness(a, b) < 1.0 and M.locate_edits(a, b) == [(0, 0, 0)]
    x, y = M.fingerprints(["one line\nother line\nlast\n" * 3, "other line\none line\nlast\n" * 3])
    assert x != y and M.likeness(x, y) < 1.0


def test_fingerprints_can_be_read_back(texts):
    for t in list(texts.values())[:50]:
        tree, = M.trees([t])
        again = M.Tree.parse(str(tree))
        assert str(again) == str(tree) and again.leaves == tree.leaves and M.tree_likeness(again, tree) == 1.0
        assert [n for n, _ in again.sections] == [n for n, _ in tree.sections]


def test_equal_texts_and_edits(texts):
    a = next(t for t in texts.values() if t.count("\n") > 12)
    lines = a.split("\n")
    changed = "\n".join([*lines[:5], lines[5] + " inserted words", *lines[6:]])
    x, y, z = M.fingerprints([a, changed, a])
    assert x == z and M.locate_edits(x, z) == [] and M.likeness(x, z) == 1.0
    spots = M.locate_edits(x, y)
    assert 1 <= len(spots) <= 4 and 0.8 < M.likeness(x, y) < 1
    spaces = M.fingerprints([a + " ", a.replace(" ", "  ", 1)])
    assert spaces[0] != x and spaces[1] != x
    p, q = M.fingerprints(["", "a"])
    assert p != q and M.likeness(p, q) == 0.0
