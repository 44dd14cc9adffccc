"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts as one state that reads any base symbol.  Every merge
(a, b) adds a gadget: tokens ``a`` now lead to a copy of their state in which
``b`` cannot follow, and wherever ``a`` could be read, the new token ``ab``
can, leading to the state that ``b`` led to at that time.  After all merges
the automaton accepts, for every string, exactly the sequence of tokens that
merging in order produces: encoding is reading the string along its arcs, and
decoding emits the arc labels.

The table of arcs is compiled in full.  A token is numbered in an order in
which the tokens derived from it (those that begin with it in their merges)
follow it, the last made first.  A state that lost ``b`` at merge k lost with
it what was derived from ``b`` since: one interval of these numbers.  So a
state's absent arcs are a few disjoint intervals, and all states' interval
ends in one sorted array are the table: a key of (state, token) is absent if an
odd number of ends lies at or below it.

The run needs no search: every prefix of a string has exactly one path, so
every position gets its state once, from whichever position reaches it.
"""

from __future__ import annotations

import functools
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortflow.llm.common import map_texts
from cohortflow.llm.pieces import PieceCache, TokenizerFile, gather, tokenizer_file


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is
    printable Latin-1, else the next of the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeAutomaton:
    """Compiled merges of one tokenizer file.

    Symbols are bytes, and 256 + byte for the last one of a piece."""

    def __init__(self, file: TokenizerFile):
        vocab = file.vocab
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in file.merges()]
        spelling: list[tuple[int, ...]] = [()] * file.size
        for byte, name in enumerate(byte_symbols()):
            for symbol, token in ((byte, vocab.get(name)), (256 + byte, vocab.get(name + file.suffix))):
                if token is not None:
                    spelling[token] = (symbol,)
        self.size = file.size
        self._compile_arcs(merges, spelling)
        self.width = np.array([len(x) for x in spelling], dtype=np.int64)
        self._compile_spellings(spelling)

    def _compile_arcs(self, merges: list[tuple[int, int, int]], spelling: list[tuple[int, ...]]) -> None:
        # gadgets: the state copied, the token lost, the merge that made it
        origin, lost, made = [0], [0], [0]
        target = [0] * self.size               # state after a token
        head = [-1] * self.size                # first part of a merged token
        born = [-1] * self.size

        def apart(state, token):
            """Whether no text has ``token`` at ``state`` by now."""
            until, k = {}, len(merges)
            while token >= 0:
                until[token] = k
                token, k = head[token], born[token]
            while state and made[state] > until.get(lost[state], -1):
                state = origin[state]
            return state > 0

        applied = []
        for a, b, ab in merges:
            if not spelling[a] or not spelling[b] or apart(target[a], b):
                continue                       # this pair never comes up, its token is never read
            if spelling[ab]:
                raise ValueError("two merges make the same token")
            k = len(applied)
            applied.append((a, b, ab))
            spelling[ab] = spelling[a] + spelling[b]
            born[ab] = k
            after_b = target[b]                # for (a, a): the state before this gadget
            origin.append(target[a])
            lost.append(b)
            made.append(k)
            target[a] = len(made) - 1
            target[ab] = after_b
            head[ab] = a
        self.target = np.array(target, dtype=np.int64)
        self._number(head, applied)
        origin, lost, made = np.array(origin), np.array(lost), np.array(made)
        # every loss of every state that a token leads to, along the states it was copied from
        state = np.unique(self.target)
        at, found = state, []
        while len(at := at[(keep := at > 0)]):
            state = state[keep]
            found.append((state, lost[at], made[at]))
            at = origin[at]
        state, token, k = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((3, 0), np.int64)
        first, last = self.order[token], self._derived_until(token, k)
        self.stride = self.size + 1
        by = np.lexsort((-last, first, state))
        first, last = (state * self.stride + first)[by], (state * self.stride + last)[by]
        reach = np.maximum.accumulate(last)
        outer = np.ones(len(first), dtype=bool)
        outer[1:] = first[1:] >= reach[:-1]    # intervals nest or lie apart
        self.ends = np.stack([first[outer], last[outer]], axis=1).ravel()

    def _number(self, head: list[int], merges: list[tuple[int, int, int]]) -> None:
        """Each token's number, and the children of every token (tokens made
        from it as first part), the last made first."""
        span = [1] * self.size                 # the token and all derived from it
        for _, _, ab in reversed(merges):
            span[head[ab]] += span[ab]
        order, free, at = [0] * self.size, [0] * self.size, 0
        for t in range(self.size):
            if head[t] < 0:
                order[t], free[t] = at, at + span[t]
                at += span[t]
        for _, _, ab in merges:                # the first made takes the last place
            free[head[ab]] -= span[ab]
            order[ab], free[ab] = free[head[ab]], free[head[ab]] + span[ab]
        self.order = np.array(order, dtype=np.int64)
        self.until = self.order + np.array(span)
        child = np.array([ab for _, _, ab in merges], dtype=np.int64)[::-1]
        self.merges = len(merges)
        key = np.array([a for a, _, _ in merges], dtype=np.int64)[::-1] * self.merges + np.arange(self.merges)
        by = np.argsort(key)
        self.child_key, self.child = key[by], child[by]

    def _derived_until(self, token: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where the numbers of the tokens end that were derived from
        ``token`` at merge ``k`` or later."""
        if not len(token):
            return token
        at = np.searchsorted(self.child_key, token * self.merges + (self.merges - 1 - k), side="right")
        older = np.minimum(at, self.merges - 1)
        own = (at < self.merges) & (self.child_key[older] // self.merges == token)
        return np.where(own, self.order[self.child[older]], self.until[token])

    def _compile_spellings(self, spelling: list[tuple[int, ...]]) -> None:
        """A trie of the tokens' symbols: the sorted keys (node, symbol) are
        its edges, the edge at i leads to node i + 1."""
        flat = np.array([x for s in spelling for x in s], dtype=np.int64)
        start = np.cumsum(self.width) - self.width
        token = np.flatnonzero(self.width)
        node, edges, nodes, ending = np.zeros(len(token), np.int64), [], 1, []
        depth = 0
        while len(token):
            level, which = np.unique(node * 512 + flat[start[token] + depth], return_inverse=True)
            node = nodes + which
            edges.append(level)
            nodes += len(level)
            depth += 1
            done = self.width[token] == depth
            ending.append((node[done], token[done]))
            node, token = node[~done], token[~done]
        self.edges = np.concatenate([*edges, [np.iinfo(np.int64).max]])
        self.token_at = np.full(nodes, -1, dtype=np.int64)
        for n, t in ending:
            self.token_at[n] = t

    def reads(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the automaton has an arc for each token at its state."""
        return np.searchsorted(self.ends, state * self.stride + self.order[token], side="right") % 2 == 0

    def _matches(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens in order of the position where the text has them, offset of
        every position's tokens).  Symbols of a piece's end stop a token."""
        at = np.arange(len(symbols))
        node, starts, tokens, depth = np.zeros(len(symbols), np.int64), [], [], 0
        while len(at):
            key = node * 512 + symbols[at + depth]
            edge = np.searchsorted(self.edges, key)
            on = self.edges[edge] == key
            at, node = at[on], edge[on] + 1
            token = self.token_at[node]
            starts.append(at[token >= 0])
            tokens.append(token[token >= 0])
            depth += 1
            inside = at + depth < len(symbols)
            at, node = at[inside], node[inside]
        starts, tokens = np.concatenate(starts), np.concatenate(tokens)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(starts, minlength=len(symbols)))])
        return tokens[np.argsort(starts, kind="stable")], offsets

    def encode(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids in a row, ids per piece) of pieces whose symbols stand
        in a row.  Positions that have got their state hand it on together."""
        stop = np.cumsum(sizes)
        if not len(symbols):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        matched, offsets = self._matches(symbols)
        into = np.full(len(symbols), -1, dtype=np.int64)       # the token that ends before position + 1
        at = (stop - sizes)[sizes > 0]
        state = np.zeros(len(at), dtype=np.int64)
        while len(at):
            many = offsets[at + 1] - offsets[at]
            token = gather(matched, offsets[at], many)
            at, state = np.repeat(at, many), np.repeat(state, many)
            on = self.reads(state, token)
            token = token[on]
            end = at[on] + self.width[token]
            into[end - 1] = token
            going = symbols[end - 1] < 256                     # not yet at the piece's end
            at, state = end[going], self.target[token[going]]
        if (into < 0).any():
            raise ValueError("the automaton does not read these pieces")
        path = np.zeros(len(symbols), dtype=bool)
        first, at = stop - sizes, stop
        while (back := at > first).any():
            first, at = first[back], at[back]
            path[at - 1] = True
            at = at - self.width[into[at - 1]]
        count = np.concatenate([[0], np.cumsum(path)])
        return into[path].astype(np.uint32), count[stop] - count[stop - sizes]

    def decode(self, ids: list[int], names: list[str]) -> list[str]:
        """The labels of the arcs."""
        return [names[i] for i in ids]


def piece_symbols(chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in a row, symbols per piece) of pieces whose code points stand in a row."""
    data = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    symbols = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    stop = np.concatenate([[0], np.cumsum(width)])[np.cumsum(sizes)]
    symbols[stop[sizes > 0] - 1] += 256
    return symbols, np.diff(stop, prepend=0)


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(tokenizer_file(path))


@functools.lru_cache(maxsize=2)
def automaton_cache(path: str) -> PieceCache:
    made = automaton(path)

    def run(_, chars, sizes):
        return made.encode(*piece_symbols(chars, sizes))

    return PieceCache(tokenizer_file(path), run)


class _Labels:
    """Per piece of a cache: its ids as text, and its arc labels."""

    def __init__(self, cache: PieceCache):
        self.cache, self.generation = cache, None

    def upto_date(self) -> tuple[list[str], list[str]]:
        cache, names = self.cache, self.cache.file.names
        if self.generation != cache.generation:
            self.generation, self.ids, self.labels = cache.generation, [], []
        for at, size in cache.entry[:2, len(self.ids):cache.count].T.tolist():
            ids = cache.ids[at:at + size].tolist()
            self.ids.append(" ".join(map(str, ids)))
            self.labels.append(" ".join([names[i] for i in ids]))
        return self.ids, self.labels


@functools.lru_cache(maxsize=2)
def _labels(path: str) -> _Labels:
    return _Labels(automaton_cache(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of token ids) of every whole text of ``docs``
    (doc_id, text; other columns are ignored).  A null or empty text, or one
    of white space only, has no ids.  Rows are neither merged nor dropped."""
    def step(batch, texts):
        ids, bounds = automaton_cache(path).tokens(texts)
        return {"doc_id": batch.column(0),
                "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))}

    return map_texts(docs.select("doc_id", "text"), step, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the arc labels of ``ids``, joined by single spaces as the
    tokenizer file's (absent) decoder has it; null ids give an empty text."""
    schema = "doc_id long, text string"

    def run(batches):
        names = tokenizer_file(path).names
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([" ".join([names[i] for i in x or []])
                                        for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text: what
    ``encode`` and ``decode`` give, without moving either."""
    def step(batch, texts):
        cache = automaton_cache(path)
        codes, bounds = cache.codes(texts)
        ids, labels = _labels(path).upto_date()
        sizes = np.concatenate([[0], np.cumsum(cache.entry[1, codes])])[bounds]
        out = {"doc_id": batch.column(0), "n_tokens": np.diff(sizes), "ids_sha256": [], "decoded_sha256": []}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            c = codes[a:b].tolist()
            out["ids_sha256"].append(sha256(" ".join([ids[k] for k in c]).encode()).hexdigest())
            out["decoded_sha256"].append(sha256(" ".join([labels[k] for k in c]).encode(
                "utf-8", "surrogatepass")).hexdigest())
        return out

    return map_texts(docs.select("doc_id", "text"), step,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
