"""Per-text counts and rates that the quality and toxicity operators share."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd

from cohortflow.llm import textbatch as tb
from cohortflow.llm.pieces import LETTER, NUMBER, OTHER, SPACE, UNKNOWN, _tables

SYMBOLS = "#*$%&|<>"


@functools.cache
def _tables_of_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Class (unassigned code points count as other) and lower case of every
    code point below U+3000 (in lower case that takes one code point)."""
    kind, lower = _tables()
    kind = kind.copy()
    kind[kind == UNKNOWN] = OTHER
    lower = lower.copy()
    for c in range(0x300, 0x3000):
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return kind, lower


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, how many of its code points have the flag."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def keyed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made different for every text of the batch."""
    return tb.mix64(h ^ tb.mix64((text + 1).astype(np.uint64)))


@dataclass
class Batch:
    """A batch's code points and words, from which counts are taken."""

    cp: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    h: np.ndarray
    bounds: np.ndarray      # per-text offsets into the words

    @classmethod
    def of(cls, texts: list) -> Batch:
        cp, offsets = tb.code_points(texts)
        starts, ends, h = tb.words(cp, offsets)
        return cls(cp, offsets, starts, ends, h, tb.per_text(starts, offsets))

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def word_chars(self) -> np.ndarray:
        return sums(tb.is_word_char(self.cp), self.offsets)

    def n_symbols(self) -> np.ndarray:
        return sums(np.isin(self.cp, [ord(c) for c in SYMBOLS]), self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every line that has a word."""
        n = len(self.cp)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        feed = np.flatnonzero(self.cp == 10)
        cut[feed + 1] = True
        begin = np.flatnonzero(cut[:n])
        end = np.append(begin[1:], n)
        stop = end - ((end > begin) & (self.cp[np.maximum(end, 1) - 1] == 10))
        words = np.searchsorted(self.starts, stop) > np.searchsorted(self.starts, begin)
        begin, stop = begin[words], stop[words]
        return tb.owner(begin, self.offsets), tb.run_hashes(self.cp, begin, stop)

    def n_dup_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word that equal an earlier line, and lines with a word."""
        text, h = self.lines()
        which, _ = pd.factorize(keyed(h, text))
        first = np.zeros(len(which), dtype=bool)
        if len(which):
            first[np.unique(which, return_index=True)[1]] = True
        return np.bincount(text[~first], minlength=self.n), np.bincount(text, minlength=self.n)

    def n_repeat_words(self, window: int = 3) -> np.ndarray:
        """Words in windows that the text has twice or more."""
        g, first = tb.grams(self.h, self.bounds, window)
        of = np.searchsorted(self.bounds, first, side="right") - 1
        which, distinct = pd.factorize(keyed(g, of))
        again = np.bincount(which, minlength=len(distinct))[which] > 1
        hit = np.zeros(len(self.h) + window, dtype=bool)
        for k in range(window):
            hit[first[again] + k] = True
        return sums(hit[:len(self.h)], self.bounds)

    def kinds(self) -> np.ndarray:
        return _tables_of_kinds()[0][self.cp]

    def lower(self) -> np.ndarray:
        return _tables_of_kinds()[1][self.cp]


def tokens(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and marks apart: start, end and hash of every run of one class
    (letters, digits, other characters)."""
    kind = b.kinds()
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[b.offsets[b.offsets < n]] = True
    at = np.append(np.flatnonzero(fresh), n)
    inner = kind[at[:-1]] != SPACE
    starts, ends = at[:-1][inner], at[1:][inner]
    return starts, ends, tb.run_hashes(b.cp, starts, ends)


DENSE = ("log_words", "word_length", "upper", "digits", "symbols", "marks", "loud", "pipes", "spaces",
         "dup_lines", "repeats", "distinct", "mixed", "rich", "feeds")


def dense(b: Batch) -> np.ndarray:
    """A row of the DENSE rates per text, all finite; zeros for an empty text."""
    chars = np.maximum(1, np.diff(b.offsets))
    n_words = b.n_words()
    words = np.maximum(1, n_words)
    kind, low = b.kinds(), b.lower()
    upper = (low != b.cp)
    letter = kind == LETTER
    dup, lines = b.n_dup_lines()
    of = np.searchsorted(b.bounds, np.arange(len(b.h)), side="right") - 1
    _, distinct = np.unique(keyed(b.h, of), return_index=True)
    cum = lambda f: np.concatenate([[0], np.cumsum(f)])
    letters, others = cum(letter), cum((kind == NUMBER) | np.isin(b.cp, [ord(c) for c in "@$*!+_"]))
    # letters on both sides of a digit or a mark: first and last are letters, something between is not
    inside = (letters[b.ends] - letters[b.starts] >= 2) & (others[b.ends] > others[b.starts])
    if len(b.h):
        inside &= letter[b.starts] & letter[b.ends - 1]
    mixed = np.bincount(of[inside], minlength=b.n)
    cols = (np.log1p(n_words), b.word_chars() / words, sums(upper, b.offsets) / np.maximum(1, sums(letter, b.offsets)),
            sums(kind == NUMBER, b.offsets) / chars, b.n_symbols() / chars, sums(kind == OTHER, b.offsets) / chars,
            sums(np.isin(b.cp, [33, 63]), b.offsets) / words, sums(b.cp == 124, b.offsets) / words,
            sums(kind == SPACE, b.offsets) / chars, dup / np.maximum(1, lines), b.n_repeat_words() / words,
            np.bincount(of[distinct], minlength=b.n) / words, mixed / words, sums(b.cp > 126, b.offsets) / chars,
            sums(b.cp == 10, b.offsets) / words)
    return np.column_stack([np.asarray(c, dtype=np.float64) for c in cols])
