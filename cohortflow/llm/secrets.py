"""Secret scans of whole texts.

Three patterns give the base findings.  The entropy scan adds spans: within
long runs of token characters, and for each character class apart, a window
slides over the run; its Shannon entropy follows from counts that change by
one character in and one out per step.  Windows at or above the class's
threshold that touch or overlap merge into spans; a span within one of a
narrower class is left out.  Stretches of one class that are letters only or
have no letter are no candidates.  Allow-listed candidates are suppressed: shapes
that are no secrets (words, numbers, identifiers in plain letters, UUIDs,
dates, versions, paths of words) and strings that the caller names.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import map_texts

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                    for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: shapes of candidates that are no secrets
ALLOWED = (
    r"[A-Za-z]+",                                             # words and camel case
    r"[0-9]+",                                                # numbers
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9.:Z+-]*)?",       # dates
    r"v?[0-9]+(?:\.[0-9]+)+(?:[-+][0-9A-Za-z.-]+)?",          # versions
    r"[/.=_-]*(?:[A-Za-z]+[0-9]{0,4}[/.=_-]+)+(?:[A-Za-z]*[0-9]{0,4})?[/.=_-]*",  # words joined by marks
    r"(.{1,8}?)\1+",                                          # one thing repeated
)


@dataclass(frozen=True)
class EntropyClass:
    """A window of ``window`` characters of ``chars`` counts as random from
    ``bits`` per character on."""

    kind: str
    chars: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", "0-9a-fA-F", 24, 3.0),
    EntropyClass("entropy_alnum", "0-9A-Za-z", 20, 3.7),
    EntropyClass("entropy_base64", "0-9A-Za-z+/_=-", 20, 3.9),
)


@dataclass(frozen=True)
class SecretParams:
    classes: tuple[EntropyClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    known: frozenset = field(default_factory=frozenset)       # strings that are public
    shortest: int = 20


#: entropies are sums of whole numbers of this fraction of a bit, so that they
#: do not depend on the order in which counts change
_UNIT = 1 << 40
#: runs from this length on are counted with numpy, by character
_LONG = 4096


@functools.cache
def _class_values(window: int) -> list[int]:
    """c log2 c for every count, in units."""
    return [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(window + 1)]


def window_sums(s: str, window: int) -> list[int]:
    """sum(c log2 c), in units, over the character counts of every window of
    ``s``: kept up to date as one count grows and one shrinks."""
    if len(s) < window:
        return []
    if len(s) >= _LONG:
        return _long_sums(s, window).tolist()
    value = _class_values(window)
    counts: dict[str, int] = {}
    total = 0
    for ch in s[:window]:
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += value[c + 1] - value[c]
    out = [total]
    for i in range(window, len(s)):
        new, old = s[i], s[i - window]
        if new != old:
            c = counts.get(new, 0)
            counts[new] = c + 1
            total += value[c + 1] - value[c]
            c = counts[old]
            counts[old] = c - 1
            total += value[c - 1] - value[c]
        out.append(total)
    return out


def _long_sums(s: str, window: int) -> np.ndarray:
    """The same for a long run: a character at a time, its count in every
    window from a running count."""
    value = np.array(_class_values(window), dtype=np.int64)
    cp = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    out = np.zeros(len(cp) - window + 1, dtype=np.int64)
    for c in np.unique(cp):
        seen = np.concatenate([[0], np.cumsum(cp == c, dtype=np.int32)])
        out += value[seen[window:] - seen[:-window]]
    return out


def window_entropies(s: str, window: int) -> list[float]:
    """Entropy in bits of every window of ``s``: log2(w) - sum(c log2 c) / w."""
    return [math.log2(window) - x / _UNIT / window for x in window_sums(s, window)]


def random_stretches(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Windows of ``s`` with an entropy of ``bits`` or more, those that touch
    or overlap as one stretch."""
    limit = math.floor((math.log2(window) - bits) * window * _UNIT)
    out: list[list[int]] = []
    for i, total in enumerate(window_sums(s, window)):
        if total <= limit:
            if out and i <= out[-1][1]:
                out[-1][1] = i + window
            else:
                out.append([i, i + window])
    return [(a, b) for a, b in out]


class Scanner:
    """Compiled parameters."""

    def __init__(self, p: SecretParams):
        self.p = p
        self.runs = [(c, re.compile(f"[{c.chars}]{{{c.window},}}")) for c in p.classes]
        self.allowed = [re.compile(a) for a in p.allowed]

    def suppressed(self, s: str) -> bool:
        return s in self.p.known or any(a.fullmatch(s) for a in self.allowed)

    def entropy_spans(self, s: str, at: int) -> list[tuple[int, int, str]]:
        """Spans of a candidate run that begins at ``at``."""
        if self.suppressed(s):
            return []
        kept: list[tuple[int, int, str]] = []
        for c, pattern in self.runs:
            # of the narrower classes' spans by start, the farthest end so far
            kept.sort()
            begins = [a for a, _, _ in kept]
            reach = list(itertools.accumulate((b for _, b, _ in kept), max))
            for m in pattern.finditer(s):
                part = m.group()
                if part.isalpha() or not any(x.isalpha() for x in part) or self.suppressed(part):
                    continue
                for lo, hi in random_stretches(part, c.window, c.bits):
                    lo, hi = at + m.start() + lo, at + m.start() + hi
                    k = bisect.bisect_right(begins, lo)
                    if not k or reach[k - 1] < hi:      # a wider class repeats nothing that a narrower one found
                        kept.append((lo, hi, c.kind))
        return kept

    def scan(self, texts: list) -> list[tuple[list, list]]:
        """(base spans, added spans) of every text, as (start, end, kind)."""
        texts = [t or "" for t in texts]
        found = [([], []) for _ in texts]
        for i, t in enumerate(texts):
            low = t.lower()
            if any(h in low for h in _HINTS):
                found[i][0].extend((m.start(), m.end(), "assign") for m in ASSIGN.finditer(t)
                                   if len(m.group(1)) >= 12)
            if "AKIA" in t:
                found[i][0].extend((m.start(), m.end(), "access") for m in ACCESS.finditer(t)
                                   if m.end() - m.start() >= 18)
        cp, offsets = tb.code_points(texts)
        code = _CLASS[np.minimum(cp, 127)]
        starts, ends = tb.runs((code & 1) > 0, offsets)
        long = ends - starts >= 16
        for s, e, i in zip(starts[long].tolist(), ends[long].tolist(), tb.owner(starts[long], offsets).tolist()):
            found[i][0].append((s - int(offsets[i]), e - int(offsets[i]), "hex"))
        starts, ends = tb.runs((code & 2) > 0, offsets)
        long = ends - starts >= self.p.shortest
        for s, e, i in zip(starts[long].tolist(), ends[long].tolist(), tb.owner(starts[long], offsets).tolist()):
            lo = int(offsets[i])
            found[i][1].extend(self.entropy_spans(texts[i][s - lo:e - lo], s - lo))
        order = {k: n for n, k in enumerate(KINDS)}
        for base, added in found:
            base.sort(key=lambda x: (x[0], order[x[2]]))
            added.sort(key=lambda x: (x[0], order[x[2]]))
        return found


def _class_table() -> np.ndarray:
    """Bits by code point (127 stands for all above): 1 lower-case hex, 2 token
    character."""
    t = np.zeros(128, dtype=np.uint8)
    for c in range(127):
        ch = chr(c)
        t[c] = (ch in "0123456789abcdef") | 2 * (ch.isascii() and ch.isalnum() or ch in "+/_.=-")
    return t


_CLASS = _class_table()


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_documents(docs: DataFrame, params: SecretParams | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every
    whole text of ``docs`` (doc_id, text; other columns are ignored).  Null
    texts are empty and have no spans; repeated rows stay; no rows give no
    rows.  Positions count code points, ends are exclusive."""
    p = params or SecretParams()

    def step(batch, texts):
        scanner = Scanner(p)
        out = {"doc_id": batch.column(0), "n_assign": [], "n_access": [], "n_hex": [],
               "base_sha256": [], "spans": [], "n_added": []}
        order = {k: n for n, k in enumerate(KINDS)}
        for base, added in scanner.scan(texts):
            kinds = [k for _, _, k in base]
            for k in ("assign", "access", "hex"):
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + added, key=lambda x: (x[0], order[x[2]]))))
            out["n_added"].append(len(added))
        return out

    return map_texts(docs.select("doc_id", "text"), step,
                     "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                     "spans string, n_added long")


def redact(docs: DataFrame, mark: str = "[secret]", params: SecretParams | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark`` (overlapping
    spans by one) and ``n_chars``, where there is one, counted anew; all other
    columns and all rows as they are.  Null texts stay null."""
    p = params or SecretParams()

    def step(batch, texts):
        scanner = Scanner(p)
        changed = []
        for t, (base, added) in zip(texts, scanner.scan(texts)):
            if t is None or not (base or added):
                changed.append(t)
                continue
            out, at = [], 0
            for s, e, _ in sorted(base + added):
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            changed.append("".join([*out, t[at:]]))
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        return cols | {"text": changed}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    done = map_texts(docs, step, schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else done
