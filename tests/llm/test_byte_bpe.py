import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken

from cohortflow.llm import byte_bpe as B
from cohortflow.llm import textbatch as tb

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(path),
                             special_tokens={})


def strange(n=4000, seed=3):
    rng = random.Random(seed)
    alphabet = list("ab  sS''tTmdrevl!?.,-_12\n\t\r\u0085 　▁") + [
        "<|endoftext|>", "İ", "ß", "é", "中", "²", "½", "\U0001f600", "٣",
        "\u0000", "​", "﻿", "՘", "࢏", "\U00011de0", "\U0001246f", "\U0010ffff"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        "x'll've'd'S'RE!'s''s 's'", "'s's'reed 're", "  ", " \n x", "a  b", "'", "''", "'l", " '", "x" * 200_000]


@pytest.mark.parametrize("path", [PATH, MULTI])
def test_ids_equal_the_library(path, texts):
    cases = strange() + [None] + list(texts.values())
    own, bpe = library(path), B.byte_bpe(path)
    for lo in range(0, len(cases), 500):
        part = cases[lo:lo + 500]
        ids, at = bpe.ids(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [own.encode_ordinary(t or "") for t in part]


def test_every_entry_is_its_own_token():
    bpe = B.byte_bpe(PATH)
    words = sorted(bpe.ranks, key=bpe.ranks.get)
    assert len(bpe.entries) < len(words)
    made = bpe.model.encode([B.mapped(w) for w in words], num_threads=1)
    assert all(ids == [i] or words[i] in bpe.entries for i, ids in enumerate(made))


def test_gaps_in_the_ranks_are_refused():
    with pytest.raises(ValueError):
        B.model_proto({b"a": 0, b"b": 2})


def test_cache_is_emptied_and_stays_right():
    bpe, own = B.ByteBpe(B.read_ranks(PATH), bound=40), library(PATH)
    for lo in range(0, 600, 60):
        part = strange()[lo:lo + 60]
        ids, at = bpe.ids(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [own.encode_ordinary(t) for t in part]


def test_pieces_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(tb, "run_hashes", lambda cp, s, e: (e - s).astype("uint64") % 2)
    ids, at = B.byte_bpe(PATH).ids(["one two three four five six", "six one"])
    own = library(PATH)
    assert ids.tolist() == own.encode_ordinary("one two three four five six") + own.encode_ordinary("six one")


def test_digests_and_round_trip(edge, none):
    own = library(PATH)
    want = []
    for d, t in [tuple(r) for r in edge.select("doc_id", "text").collect()]:
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in B.encode_digests(edge, PATH).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert B.encode_digests(none, PATH).count() == 0
    back = sorted((bytes(r.data).decode() for r in B.decode(B.encode(edge, PATH), PATH).collect()))
    assert back == sorted(r.text or "" for r in edge.select("text").collect())
    assert B.decode(B.encode(none, PATH), PATH).count() == 0
