import random
import re
from hashlib import sha256

import numpy as np
import pytest

from cohortflow.llm import fill_middle as M

MORE = [(21, "<P> holds a marker"), (22, "holds <M"), (23, "<S"), (24, "<<S"), (25, "M>x<S>"), (26, "P>" * 50),
        (27, "é中\U0001f600" * 40), (28, "\n\n a\n\nb \n"), (29, "   "), (30, "\n"),
        *((100 + i, "<S" * 3 + "<P" * (i % 5) + ">M>" + "中" * (i % 7)) for i in range(80))]


def units(text, unit):
    """The units of a text as strings."""
    if unit == "code_point":
        return list(text)
    if unit == "line":
        return text.splitlines(keepends=True) if not re.search("[\r\x0b\x0c\x1c-\x1e\x85  ]", text) \
            else re.findall(r"[^\n]*\n|[^\n]+$", text)
    found = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    lead = re.match(r"[\x20\x09-\x0D]*", text).group()
    return [lead + found[0], *found[1:]] if found else [text] if text else []


def plain_version(doc_id, text, p):
    text = text or ""
    h = sha256(f"{p.salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    u = units(text, p.unit)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    assert prefix + middle + suffix == text
    if not text or any(m in text for m in M.MARKERS) or h3 % 100 >= p.plain_from:
        return doc_id, len(u), "plain", None, None, text
    if h4 % 100 < p.spm_below:
        return doc_id, len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
def test_equals_the_plain_version(spark, edge, documents, none, unit):
    p = M.MiddleParams(unit=unit)
    more = spark.createDataFrame(MORE, "doc_id long, text string")
    for df in (edge, more, documents):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        done = M.restore(M.transform(df, p))
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect()]
        assert sorted(got, key=str) == sorted((plain_version(d, t, p) for d, t in rows), key=str)
        assert sorted((r.doc_id, r.text) for r in done.where("doc_id is not null").collect()) == sorted(
            (d, t or "") for d, t in rows if d is not None)
    assert M.transform(none, p).count() == 0


def test_all_forms_occur_and_other_shares(documents):
    forms = {r.form: r.n for r in M.transform(documents).groupBy("form").agg({"*": "count"}).toDF("form", "n").collect()}
    assert set(forms) == {"plain", "psm", "spm"} and forms["psm"] > forms["spm"] > 0
    all_spm = M.transform(documents, M.MiddleParams(plain_from=100, spm_below=100)).select("form").distinct().collect()
    assert {r.form for r in all_spm} <= {"spm", "plain"}


def test_digests(edge):
    for r in M.digests(edge).collect():
        assert len(r.output_sha256) == 64
    want = sorted(sha256((r.text or "").encode()).hexdigest() for r in edge.select("text").collect())
    assert sorted(r.restored_sha256 for r in M.digests(edge).collect()) == want


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 128, 1000):
        s = rng.integers(0, 6, n).astype(np.uint8)
        w = M.WaveletMatrix(s)
        at = np.arange(n + 1)
        for c in range(8):
            assert (w.rank(c, at) == np.concatenate([[0], np.cumsum(s == c)])).all()


def test_every_boundary_is_located():
    rng = random.Random(8)
    for unit in M.MARKS:
        for _ in range(60):
            texts = ["".join(rng.choice("ab \n\té中") for _ in range(rng.randint(0, 12))) for _ in range(5)]
            data = np.frombuffer("".join(texts).encode(), np.uint8)
            offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
            marks = M.Boundaries(data, offsets, unit)
            own = [units(t, unit) for t in texts]
            assert marks.units.tolist() == [len(u) for u in own]
            for k in range(14):
                got = marks.locate(np.full(len(texts), k)) - offsets[:-1]
                assert got.tolist() == [len("".join(u[:k]).encode()) for u in own]


def test_sql_equals_the_operator(documents):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.execute(M.digests_sql()).fetchall()) == sorted(map(tuple, M.digests(documents).collect()))
