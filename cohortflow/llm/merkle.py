"""Document fingerprints: a Merkle tree over sections and paragraphs.

A paragraph is a line; its node is a 128-bit digest of its own bytes.  Sections
are runs of paragraphs, ended by a paragraph whose digest says so, so that their
ends move with the content; a section's node is the digest of its paragraphs'
nodes, the root that of the sections' nodes.  Equal roots therefore mean equal
texts (but for a collision of 128-bit BLAKE2b).

The fingerprint is a string: the root, then by section and paragraph the nodes,
and below each paragraph short codes of its leaves.  Leaves are runs of words
ended by a word whose hash says so; their codes serve to place an edit within a
paragraph and never to call texts equal.  Comparing goes down the tree: equal
sections and paragraphs are not entered, only differing branches are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import arrow_schema, record_batch
from cohortflow.llm.ordering import bucketed, sorted_buckets

LEAF_WORDS = 8              # mean words of a leaf
SECTION_PARAGRAPHS = 4      # mean paragraphs of a section
NODE_HEX = 32
LEAF_HEX = 8

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _node(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def paragraphs(text: str) -> list[bytes]:
    """The lines of a text, each with the line feed that ends it."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def leaf_codes(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: every leaf's 32-bit code, the index of the first leaf of
    every paragraph, and per-text offsets into the paragraphs.  Leaves cover
    every code point, white space included."""
    cp, offsets = tb.code_points(texts)
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    _, ends, h = tb.words(cp, offsets)
    line = np.zeros(n + 1, dtype=bool)
    line[offsets] = True
    line[np.flatnonzero(cp == 10) + 1] = True
    cut = line.copy()
    cut[ends[h % np.uint64(LEAF_WORDS) == 0]] = True
    bounds = np.flatnonzero(cut[:n])
    leaves = tb.run_hashes(cp, bounds, np.append(bounds[1:], n))
    starts = np.flatnonzero(line[:n])
    return ((leaves >> np.uint64(32)).astype(np.uint32), np.append(np.searchsorted(bounds, starts), len(bounds)),
            np.searchsorted(starts, offsets))


@dataclass(frozen=True)
class Tree:
    """One text's nodes: sections of (paragraph node, leaf codes)."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, np.ndarray]]]]

    @property
    def leaves(self) -> int:
        return sum(len(codes) for _, s in self.sections for _, codes in s)

    def __str__(self) -> str:
        return self.root.hex() + ":" + "/".join(
            ".".join(node.hex() + codes.astype(">u4").tobytes().hex() for node, codes in s)
            for _, s in self.sections)

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        root, _, body = fingerprint.partition(":")
        sections = []
        for section in body.split("/") if body else []:
            held = [(bytes.fromhex(x[:NODE_HEX]), np.frombuffer(bytes.fromhex(x[NODE_HEX:]), ">u4"))
                    for x in section.split(".")]
            sections.append((_node(b"".join(node for node, _ in held)), held))
        return cls(bytes.fromhex(root), sections)


def trees(texts: list) -> list[Tree]:
    """The tree of every text (null: empty)."""
    texts = [t or "" for t in texts]
    codes, first, at = leaf_codes(texts)
    out = []
    for i, t in enumerate(texts):
        sections, held = [], []
        for k, line in enumerate(paragraphs(t), int(at[i])):
            node = _node(line)
            held.append((node, codes[first[k]:first[k + 1]]))
            if node[0] % SECTION_PARAGRAPHS == 0:
                sections.append((_node(b"".join(x for x, _ in held)), held))
                held = []
        if held:
            sections.append((_node(b"".join(x for x, _ in held)), held))
        out.append(Tree(_node(b"".join(x for x, _ in sections)), sections))
    return out


def fingerprints(texts: list) -> list[str]:
    return [str(t) for t in trees(texts)]


def _unmatched(a: list, b: list) -> tuple[list, list]:
    """What is left of the (node, content) of ``a`` and of ``b`` when equal
    nodes are paired off, with multiplicity."""
    seen = Counter(x[0] for x in a)
    rest_b = []
    for x in b:
        if seen[x[0]] > 0:
            seen[x[0]] -= 1
        else:
            rest_b.append(x)
    if len(rest_b) == len(b):
        return a, b
    rest_a = []
    for x in reversed(a):           # the last ones of a node are those left over
        if seen[x[0]] > 0:
            seen[x[0]] -= 1
            rest_a.append(x)
    return rest_a[::-1], rest_b


def differing_paragraphs(a: Tree, b: Tree) -> tuple[list, list]:
    """The (node, codes) of paragraphs that one tree has and the other has
    not, found through differing sections only."""
    if a.root == b.root:
        return [], []
    left, right = _unmatched(a.sections, b.sections)
    return _unmatched([p for _, s in left for p in s], [p for _, s in right for p in s])


def locate_edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) of the leaves of ``b`` that differ from
    ``a``: equal roots give none, equal sections and paragraphs are not
    entered.  Paragraphs that differ while their leaves' codes do not (leaves
    moved, or a shared code) give all their leaves."""
    x, y = Tree.parse(a), Tree.parse(b)
    old, new = differing_paragraphs(x, y)
    left = {id(codes) for _, codes in new}
    seen = Counter(c for _, codes in old for c in codes.tolist())
    out = []
    for i, (_, section) in enumerate(y.sections):
        for j, (_, codes) in enumerate(section):
            if id(codes) not in left:
                continue
            changed = []
            for k, c in enumerate(codes.tolist()):
                if seen[c] > 0:
                    seen[c] -= 1
                else:
                    changed.append((i, j, k))
            out += changed or [(i, j, k) for k in range(len(codes))]
    return out


def tree_likeness(a: Tree, b: Tree) -> float:
    """Twice the leaves in common over all leaves.  Leaves below equal nodes
    are in common; below differing paragraphs those of equal code are.  1 for
    equal roots and for nothing else; 0 if only one of them has leaves."""
    if a.root == b.root:
        return 1.0
    total = a.leaves + b.leaves
    left, right = differing_paragraphs(a, b)
    x = np.concatenate([c for _, c in left]) if left else np.zeros(0, np.uint32)
    y = np.concatenate([c for _, c in right]) if right else np.zeros(0, np.uint32)
    common = total - len(x) - len(y)
    u, nu = np.unique(x, return_counts=True)
    v, nv = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    common += 2 * int(np.minimum(nu[i], nv[j]).sum())
    return min(common / total, 1 - 1 / (total + 1))


def likeness(a: str, b: str) -> float:
    """``tree_likeness`` of two fingerprints."""
    return tree_likeness(Tree.parse(a), Tree.parse(b))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many
    code points of ``following``, or all of them."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def _rows(keys: list, texts: list, following: list) -> dict:
    """Result columns of documents and the texts that follow them."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, after = trees(texts), trees(changed)
    # a document is mostly followed by the next of the same batch
    rest = [i for i in range(len(texts)) if i + 1 >= len(texts) or following[i] is not texts[i + 1]]
    other = [*own[1:], None]
    for i, tree in zip(rest, trees([following[i] for i in rest])):
        other[i] = tree
    return {"doc_id": keys, "n_chars": [len(t) for t in texts],
            "edited_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [str(t) for t in own], "edited_fingerprint": [str(t) for t in after],
            "near_edited": [tree_likeness(*x) for x in zip(own, after)],
            "near_next": [tree_likeness(*x) for x in zip(own, other)]}


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs`` (doc_id, text; other
    columns are ignored) and of its edited text, by ascending doc_id (equal
    ids by text, null ids last; after the last the first).  Null texts are
    empty; repeated rows stay; no rows give no rows; a single document is
    followed by itself."""
    spark = docs.sparkSession
    placed, buckets = bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    target = arrow_schema(spark, SCHEMA)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All documents but the last of each bucket."""
        held = None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            rows = [held, *rows] if held is not None else rows
            held = rows[-1]
            for lo, hi in tb.steps([r[1] for r in rows], tb.STEP_CHARS // 2):
                part = [i for i in range(lo, min(hi, len(rows) - 1)) if rows[i][2] == rows[i + 1][2]]
                if part:
                    yield record_batch(_rows([rows[i][0] for i in part], [rows[i][1] for i in part],
                                             [rows[i + 1][1] for i in part]), target)

    def edges(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(3)]
            for lo, hi in tb.steps(cols[1], tb.STEP_CHARS // 2):
                yield record_batch(_rows(*(c[lo:hi] for c in cols)), target)

    main = sorted_buckets(placed, buckets).select("doc_id", "text", "bucket").mapInArrow(inner, SCHEMA)
    return main.union(_bucket_ends(spark, placed).mapInArrow(edges, SCHEMA))


def _bucket_ends(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """(doc_id, text, following): every bucket's last document, and the first
    one of the next bucket that has any; a row per bucket."""
    ends = placed.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    ends = [tuple(r) for r in ends.collect()]              # bounded by MOST_BUCKETS
    if not ends:
        return spark.createDataFrame([], "doc_id long, text string, following string")
    ends.sort()
    rows = [(b, lo, hi, ends[(i + 1) % len(ends)][0]) for i, (b, lo, hi) in enumerate(ends)]
    marks = spark.createDataFrame(rows, "bucket int, lo long, hi long, then int")
    near = placed.join(F.broadcast(marks), "bucket").where(
        F.col("doc_id").eqNullSafe(F.col("lo")) | F.col("doc_id").eqNullSafe(F.col("hi")))
    first = near.where(F.col("doc_id").eqNullSafe(F.col("lo"))).groupBy("bucket").agg(
        F.min("text").alias("following"))
    last = near.where(F.col("doc_id").eqNullSafe(F.col("hi"))).groupBy("bucket", "then").agg(
        F.first("doc_id").alias("doc_id"), F.max("text").alias("text"))
    return last.join(first.select(F.col("bucket").alias("then"), "following"), "then").select(
        "doc_id", "text", "following")
