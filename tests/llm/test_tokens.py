import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortflow.llm import bpe_automaton as B
from cohortflow.llm import direct_codes as D
from cohortflow.llm import packing as K
from cohortflow.llm import pieces as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strange(n=3000, seed=2):
    rng = random.Random(seed)
    alphabet = list("ab sS'tTmMdDrReEvVlL!?.,-_1 2\n\t\u0085") + [
        "<|endoftext|>", "\u0130", "\u00df", "\u03a3", "\u03c2", "\u01fa", "e\u0301", "\u4e2d", "\uff71", "\u00b2", "\u00bd",
        "\U0001f600", "\u0663", "\u1e9e", "\uac00", "\u200b", "\u180e", "\ufeff", "\ua7cb", "\U000105c0"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        "x'll've'd'S'RE!'s''s 's'", "\U0010ffff <|endoftext|>\U0010ffff", "<|startoftext|><|endoftext|>"]


def test_both_encoders_equal_the_library(library, texts):
    cases = strange() + list(texts.values())
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    for cache in (P.library_cache(PATH), B.automaton_cache(PATH)):
        ids, at = cache.tokens(cases)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_cache_is_emptied_and_stays_right(library):
    cache = P.PieceCache(P.tokenizer_file(PATH), P.library_encode, bound=50)
    for lo in range(0, 600, 60):
        part = strange()[lo:lo + 60]
        ids, at = cache.tokens(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            e.ids for e in library.encode_batch(part, add_special_tokens=False)]


class Small:
    """A made-up tokenizer file: byte symbols and a few merges over them."""

    def __init__(self, merges):
        self.suffix = "</w>"
        names = [n + s for s in ("", self.suffix) for n in B.byte_symbols()]
        names += [a + b for a, b in merges]
        self.vocab, self.size, self._merges = {n: i for i, n in enumerate(names)}, len(names), merges

    def merges(self):
        return self._merges


def merged(piece, file):
    """The ids of a piece by applying the merges in order, each from the left."""
    parts = [B.byte_symbols()[c] for c in piece.encode()]
    parts[-1] += file.suffix
    for a, b in file.merges():
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i:i + 2] = [a + b]
            i += 1
    return [file.vocab[x] for x in parts]


def encoded(automaton, pieces):
    chars = np.array([ord(c) for x in pieces for c in x], dtype=np.uint32)
    ids, sizes = automaton.encode(*B.piece_symbols(chars, np.array([len(x) for x in pieces], dtype=np.int64)))
    ends = np.cumsum(sizes)
    return [ids[b - n:b].tolist() for b, n in zip(ends, sizes)]


def test_compiled_arcs_read_what_merging_gives():
    """Random merge lists, such as (a, a) and tokens derived several times, on every string of up to 7 symbols."""
    rng = random.Random(8)
    pieces = ["".join("ab"[i >> k & 1] for k in range(n)) for n in range(1, 8) for i in range(1 << n)]
    for _ in range(40):
        known, merges = ["a", "b", "a</w>", "b</w>"], []
        for _ in range(rng.randint(0, 12)):
            a, b = rng.choice([x for x in known if not x.endswith("</w>")]), rng.choice(known)
            if a + b not in known:
                known.append(a + b)
                merges.append((a, b))
        file = Small(merges)
        assert encoded(B.MergeAutomaton(file), pieces) == [merged(x, file) for x in pieces], merges


def test_arcs_lead_to_pairs_that_merging_keeps():
    """An arc for a token pair is there if merging the pair's string gives the pair."""
    automaton, file = B.automaton(PATH), P.tokenizer_file(PATH)
    rng = random.Random(3)
    inner = [i for n, i in file.vocab.items() if not n.endswith(file.suffix) and n.isascii() and n.isalpha()]
    ending = [i for n, i in file.vocab.items() if n.endswith(file.suffix) and n[:-4].isascii() and n[:-4].isalpha()]
    pairs = [(rng.choice(inner), rng.choice(ending)) for _ in range(4000)]
    texts = [file.names[a] + file.names[b][:-4] for a, b in pairs]
    want = [file.library.encode(t, add_special_tokens=False).ids == [a, b] for t, (a, b) in zip(texts, pairs)]
    left, right = (np.array(x) for x in zip(*pairs))
    got = automaton.reads(np.zeros(len(left), np.int64), left) & automaton.reads(automaton.target[left], right)
    lower = np.array([t == t.lower() for t in texts])
    assert (got[lower] == np.array(want)[lower]).all() and got[lower].any() and not got[lower].all()


def test_one_very_long_piece(library):
    rng = random.Random(5)
    for piece in ("a" * 5000, "the" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20000)), "\u4e2d" * 2000):
        ids, _ = B.automaton_cache(PATH).tokens([piece, None, ""])
        assert ids.tolist() == library.encode(piece, add_special_tokens=False).ids


def test_digests_and_round_trip(edge, none, library):
    rows = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                   for r in B.encode_digests(edge, PATH).collect()), key=str)
    want = []
    for d, t in [tuple(r) for r in edge.select("doc_id", "text").collect()]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == sorted(want, key=str)
    assert B.encode_digests(none, PATH).count() == 0
    texts = sorted(r.text for r in B.decode(B.encode(edge, PATH), PATH).collect())
    assert texts == sorted(library.decode(library.encode(r.text or "", add_special_tokens=False).ids,
                                          skip_special_tokens=False) for r in edge.select("text").collect())


def test_direct_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 511, 512, 513, 5000):
        ids = rng.choice([3, 900, 1023, 1024, 49407, 65535, 65536, 1 << 27], n).astype(np.uint32)
        codes = D.DirectCodes.encode(ids)
        codes = D.DirectCodes(codes.n, codes.levels, codes.bitmaps, [d.tobytes() for d in codes.directories])
        assert (codes.slice(0, n) == ids).all()
        for i in rng.integers(0, n, 40) if n else ():
            assert codes.get(int(i)) == ids[i]
            j = int(rng.integers(i, n))
            assert (codes.slice(int(i), j) == ids[i:j]).all()
    for width in (2, 6, 8, 10, 16):
        v = rng.integers(0, 1 << width, 37).astype(np.uint64)
        assert (D.unpack(D.pack(v, width), width, 5, 31) == v[5:31]).all()


def expected(df, library):
    rows = sorted(((d, t or "") for d, t in df.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [(d, np.array(library.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")) for d, t in rows]


def test_token_files(spark, edge, documents, none, library, tmp_path):
    for k, df in enumerate((edge, documents)):
        path = str(tmp_path / str(k))
        bases = D.write_tokens(df, path, PATH)
        at, want = 0, []
        for d, ids in expected(df, library):
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(tuple, D.read_documents(spark, path, bases).collect()), key=str) == sorted(want, key=str)
    first = expected(documents, library)[0][1]
    assert D.read_tokens(spark, path, 0, 0, [0, 5, len(first) - 1]) == first[[0, 5, -1]].tolist()
    assert D.read_documents(spark, str(tmp_path / "n"), D.write_tokens(none, str(tmp_path / "n"), PATH)).count() == 0


def test_shortest_pack_first():
    rng = random.Random(4)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(0, 20))}
        packs = K.shortest_pack_first(histogram, 64)
        assert all(sum(p.lengths) <= 64 for p in packs)
        placed = {}
        for p in packs:
            for n in p.lengths:
                placed[n] = placed.get(n, 0) + p.count
        assert placed == histogram


def test_packing_leaves_little_padding():
    assert sum(p.count for p in K.shortest_pack_first({100: 1000})) == 25
    rng = random.Random(6)
    for hot in (1, 7, 100, 900):
        histogram = {rng.randint(1, 4096): rng.randint(1, 9) for _ in range(400)}
        histogram[hot] = 3000               # more than half of all pieces
        packs = K.shortest_pack_first(histogram)
        placed = {}
        for p in packs:
            for n in p.lengths:
                placed[n] = placed.get(n, 0) + p.count
        assert placed == histogram and all(sum(p.lengths) <= 4096 for p in packs)
        tokens = sum(n * k for n, k in histogram.items())
        assert sum(p.count for p in packs) <= 1.1 * tokens / 4096 + 1


def test_packing(edge, documents, none, library):
    for df in (edge, documents):
        held = {}
        for d, ids in expected(df, library):
            held.setdefault(d, []).append(ids)
        rows = K.pack_documents(df, PATH).collect()
        by_sequence = {}
        for r in rows:
            assert any(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                       and len(ids) == r.doc_tokens for ids in held[r.doc_id])
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096
        assert sum(r.length for r in rows) == sum(len(i) for x in held.values() for i in x)
    assert K.pack_documents(none, PATH).count() == 0


def test_pieces_that_share_a_hash_keep_their_ids(library, monkeypatch):
    from cohortflow.llm import textbatch as tb
    monkeypatch.setattr(tb, "run_hashes", lambda cp, s, e: ((e - s) % 3).astype(np.uint64))
    cache = P.PieceCache(P.tokenizer_file(PATH), P.library_encode)
    for part in (["one two six ten seven"], ["cat dog seven ten <|endoftext|> one"], ["a bb ccc dddd", "one"]):
        ids, at = cache.tokens(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_packed_ids_are_the_documents(spark, edge, library):
    """With ids, the pieces of a document in order are its tokens."""
    held = {}
    for d, ids in expected(edge, library):
        held.setdefault(d, []).append(ids.tolist())
    rows = K.pack_documents(edge, PATH, size=64, with_ids=True).collect()
    assert all(len(r.ids) == r.length <= 64 for r in rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (d, n), pieces in by_doc.items():
        texts = [x for x in held[d] if len(x) == n]
        if len(texts) == 1:
            assert [i for r in sorted(pieces, key=lambda r: r.start) for i in r.ids] == texts[0]
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == len(rows)
