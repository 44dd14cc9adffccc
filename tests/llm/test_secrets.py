import math
import random
import re
import time
from collections import Counter
from hashlib import sha256

from cohortflow.llm import secrets as S

A = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in A.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_base_findings_of_documents(documents, texts):
    rows = S.scan_documents(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_windows_equal_counts_from_scratch():
    rng = random.Random(5)
    for _ in range(50):
        s = "".join(rng.choice("abcdef0123") for _ in range(rng.randint(0, 70)))
        want = []
        for i in range(len(s) - 19):
            c = Counter(s[i:i + 20])
            want.append(-sum(n / 20 * math.log2(n / 20) for n in c.values()))
        got = S.window_entropies(s, 20)
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_added_and_suppressed_spans():
    scan = S.Scanner(S.SecretParams())
    random_key = "aB3xK9mQ2pL7vR4tY8wZ1nC6"
    (_, added), = scan.scan([f"key {random_key} end"])
    assert any(s <= 4 and e >= 24 for s, e, _ in added)
    for harmless in ("internationalisationcommittees", "123456789012345678901234567890",
                     "123e4567-e89b-12d3-a456-426614174000", "2024-01-01T00:00:00.000000Z",
                     "some/path/of/words/file2.txt", "a1a1a1a1a1a1a1a1a1a1a1a1a1a1"):
        assert scan.scan([harmless])[0][1] == [], harmless
    known = S.Scanner(S.SecretParams(known=frozenset([random_key])))
    assert known.scan([random_key])[0][1] == []


def test_edges_and_redaction(edge, none):
    rows = S.scan_documents(edge).collect()
    assert len(rows) == edge.count()
    assert all(r.spans == "" and r.n_hex == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert S.scan_documents(none).count() == 0
    done = S.redact(edge)
    assert done.columns == edge.columns and done.count() == edge.count()
    row = done.where("doc_id = 11").first()
    assert "9233a8" not in row.text and "AKIA" not in row.text and "[secret]" in row.text
    assert row.n_chars == len(row.text)
    assert done.where("doc_id = 1").first().text is None
    assert S.redact(none).count() == 0


def brute_added(text, p):
    """Entropy spans from the counts of every single window."""
    out = []
    for run in re.finditer(r"[A-Za-z0-9+/_.=-]{%d,}" % p.shortest, text):
        blocked = lambda s: s in p.known or any(re.fullmatch(a, s) for a in p.allowed)
        if blocked(run.group()):
            continue
        kept = []
        for c in p.classes:
            new = []
            for m in re.finditer(f"[{c.chars}]{{{c.window},}}", run.group()):
                s = m.group()
                if s.isalpha() or not any(x.isalpha() for x in s) or blocked(s):
                    continue
                hit = [i for i in range(len(s) - c.window + 1) if -sum(
                    n / c.window * math.log2(n / c.window) for n in Counter(s[i:i + c.window]).values()) >= c.bits - 1e-9]
                spans = []
                for i in hit:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + c.window
                    else:
                        spans.append([i, i + c.window])
                new += [(run.start() + m.start() + a, run.start() + m.start() + b, c.kind) for a, b in spans]
            kept += [x for x in new if not any(a <= x[0] and x[1] <= b for a, b, _ in kept)]
        out += kept
    return sorted(out, key=lambda x: (x[0], S.KINDS.index(x[2])))


def test_entropy_spans_equal_a_brute_force(texts):
    rng = random.Random(9)
    alphabet = "abcdef0123456789" * 3 + "ghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-.  "
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    made += ["AbCdEfGhIjKlMnOpQrStUvWx+/AbQzRt", "a" * 50, "ab+" * 30]
    p = S.SecretParams()
    scanner = S.Scanner(p)
    for t in [*made, *texts.values()]:
        t = t or ""
        assert scanner.scan([t])[0][1] == brute_added(t, p)
    assert scanner.scan(["AbCdEfGhIjKlMnOpQrStUvWx+/AbQzRt"])[0][1]


def test_a_long_run_takes_little_time():
    rng = random.Random(2)
    s = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    start = time.process_time()
    spans = S.Scanner(S.SecretParams()).scan([s])[0][1]
    assert spans and time.process_time() - start < 10
    short = s[:5000]
    assert S._long_sums(short, 20).tolist() == S.window_sums(short[:4000], 20) + S.window_sums(short[3981:], 20)
