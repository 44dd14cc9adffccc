"""Exact self-join of documents under the Jaccard metric.

The distance of two shingle sets, 1 - |A & B| / |A | B|, is a metric.  The
join works on regions around pivot documents:

1. Equal sets are one node, whatever the number of copies; copies are
   collapsed before anything is entered anywhere.
2. Documents within the distance ``eps`` have, under any one order of all
   shingles, a common shingle among the first ``floor(eps * n) + 1`` of each.
   So every node is only entered under those few shingles, rare ones first
   (the order comes from a share of all documents; it affects speed, not
   results).
3. Under every shingle one node is the pivot: the most central one.  The
   region of a pivot holds all nodes entered with it under any shingle: two
   nodes that can be linked always meet in a region.
4. A node stays in a region only while another one there has a size within
   the window that the distance allows (the triangle inequality against the
   empty set, with the symmetric difference as metric).
   Within regions of bounded size a parity sketch (a bit per hash class, as
   many as the set has shingles or up to twice that) bounds the symmetric
   difference from below: only nodes that some member could be linked with
   stay, in regions of their own, and equal regions become one.
5. A region of bounded size is joined in one task by Voronoi recursion:
   pivots, nearest-pivot cells, and boundary nodes repeated in every cell
   within ``2 * eps`` of being nearest; small cells compare exactly.
6. A larger region first measures all nodes against its pivot, in slices.
   Nodes within ``eps`` are linked with the pivot, hence with one another;
   for the rest, slices in order of distance meet only slices within ``eps``
   (triangle inequality), two slices a task, recursively joined as in 5.
7. Only links that join two parts leave a task; components follow from them.
8. To count links, the shortcuts by connectivity are left out: a task finds
   every linked pair and adds the copies of its nodes up per node.  A pair is
   counted in the first (by hash) of the regions that hold both nodes, and in
   a larger region by the one task of its two slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm import textbatch as tb
from cohortflow.llm.common import arrow_schema, map_texts, record_batch, release, sample_filter
from cohortflow.llm.components import components
from cohortflow.sources.cube_store import materialize

SHORT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class JaccardParams:
    """``percent``: link at 100 * intersection >= percent * union.
    ``order_share``: one of so many documents gives its shingle counts to the
    order; ``order_sample``: so many documents at least do.
    ``order_size``: shingles in that order's table, most frequent first.
    ``region_nodes`` / ``region_shingles``: bound of what one task joins.
    ``cell_nodes``: below it a cell compares without further pivots.
    ``broadcast_ids``: up to so many documents that share a region are looked
    up by a broadcast of their ids, more by a shuffle."""

    words: int = 4
    percent: int = 85
    order_share: int = 50
    order_sample: int = 5_000
    order_size: int = 1 << 18
    region_nodes: int = 1024
    region_shingles: int = 2_000_000
    cell_nodes: int = 48
    broadcast_ids: int = 500_000


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    cp, offsets = tb.code_points(texts)
    starts, _, h = tb.words(tb.lower_ascii(cp), offsets)
    bounds = tb.per_text(starts, offsets)
    g, first = tb.grams(h, bounds, words)
    cut = np.searchsorted(first, bounds)
    sets = []
    for i in range(len(texts)):
        n = bounds[i + 1] - bounds[i]
        if n >= words:
            sets.append(np.unique(g[cut[i]:cut[i + 1]]))
        elif n:
            own = h[bounds[i]:bounds[i + 1]] * np.arange(3, 2 * n + 3, 2).astype(np.uint64)
            sets.append(tb.mix64(own.sum(dtype=np.uint64, keepdims=True) ^ (SHORT * np.array([n], np.uint64))))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles of each of two linked sets share one at least."""
    return n - -(-percent * n // 100) + 1


def _node(s: np.ndarray) -> bytes | None:
    if len(s) == 0:
        return None
    a = s.sum(dtype=np.uint64)
    b = tb.mix64(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return np.array([a, b], dtype=">u8").tobytes()


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit per hash class: the parity of the set's members in it."""
    size = 1 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(sketch: np.ndarray) -> np.ndarray:
    """The sketches of half as many classes."""
    half = sketch.shape[1] // 2
    return sketch[:, :half] ^ sketch[:, half:]


def possible_links(sketches: list[bytes], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that sizes and sketches do not exclude, each once."""
    width = np.array([len(b) for b in sketches])
    out = []
    for w in np.unique(width):
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        a = np.stack([np.frombuffer(sketches[i], np.uint8) for i in own])
        b = _fold(np.stack([np.frombuffer(sketches[i], np.uint8) for i in wider])) if len(wider) else a[:0]
        rows, ids = np.concatenate([a, b]), np.concatenate([own, wider])
        for k in range(len(own)):
            differ = np.bitwise_count(rows[k + 1:] ^ rows[k]).sum(axis=1, dtype=np.int64)
            both = sizes[ids[k + 1:]] + sizes[own[k]]
            hit = (100 + percent) * np.maximum(differ, np.abs(sizes[ids[k + 1:]] - sizes[own[k]])) <= (
                100 - percent) * both
            out += [(int(own[k]), int(j)) for j in ids[k + 1:][hit]]
    return out


def shingle_order(docs: DataFrame, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles of a share of the documents (sorted), and their
    counts in it: what is left out occurs in fewer than ``3 * order_share``
    documents or so, whatever the size of the table."""
    def count(batch, texts):
        g = [s for s in shingle_sets(texts, p.words) if len(s)]
        u, c = np.unique(np.concatenate(g), return_counts=True) if g else (np.zeros(0, np.uint64),) * 2
        return {"gram": u.view(np.int64), "n": c.astype(np.int64)}

    sample = sample_filter(docs, F.coalesce(F.col("doc_id"), F.xxhash64("text")),
                           max(p.order_sample, docs.count() // p.order_share)).select("text")
    rows = (map_texts(sample, count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .where("n >= 3").orderBy(F.desc("n"), "gram").limit(p.order_size).toPandas())
    gram = rows["gram"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(gram)
    return gram[by], rows["n"].to_numpy(dtype=np.int64)[by]


def text_digest():
    return F.unhex(F.md5("text"))


def document_keys(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """doc_id, digest (of the text), n (set size), node (identity of the set;
    null if empty), its handle, keys
    (its first shingles in the order), central (how much of it is frequent),
    sketch."""
    grams, counts = shingle_order(docs, p)
    order = docs.sparkSession.sparkContext.broadcast((grams, counts))

    def step(batch, texts):
        grams, counts = order.value
        sets = shingle_sets(texts, p.words)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        weight = np.zeros(len(flat), np.int64)
        if len(grams):
            at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
            weight = np.where(grams[at] == flat, counts[at], 0)
        ends = np.cumsum(sizes)
        keys, central = [], []
        for s, e, n in zip(sets, ends, sizes):
            if n == 0:
                keys.append(None)
                central.append(0)
                continue
            w = weight[e - n:e]
            first = np.lexsort((s, w))[:prefix_length(int(n), p.percent)]
            keys.append(s[first].view(np.int64))
            central.append(int(1e6 * np.log1p(w).mean()))
        handle = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "digest": batch.column(2), "n": sizes, "node": [_node(s) for s in sets], "handle": handle,
                "keys": keys, "central": central, "sketch": [parity_sketch(s) if len(s) else None for s in sets]}

    return map_texts(docs.select("doc_id", "text", text_digest().alias("digest")), step,
                     "doc_id long, digest binary, n long, node binary, handle long, keys array<long>, central long, sketch binary")


def node_sets(docs: DataFrame, wanted: DataFrame, p: JaccardParams) -> DataFrame:
    """node, grams (the set's hashes as bytes) of the ``wanted`` (node, doc_id)."""
    def step(batch, texts):
        sets = shingle_sets(texts, p.words)
        return {"node": [_node(s) for s in sets], "grams": [s.tobytes() for s in sets]}

    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    if ids.count() <= p.broadcast_ids:
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    return map_texts(texts, step, "node binary, grams binary").where("node is not null")


def _overlaps(sets: list[np.ndarray], rows: list[int], cols: list[int]) -> np.ndarray:
    """Intersection sizes, by a product of 0/1 matrices over the shingles that
    occur in both parts (in column blocks of bounded size)."""
    flat = np.concatenate([sets[i] for i in rows])
    other = np.concatenate([sets[i] for i in cols])
    shared = np.intersect1d(flat, other)
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    width = max(1, 3_000_000 // (len(rows) + len(cols)))

    def part(ids, lo, block):
        m = np.zeros((len(ids), len(block)), dtype=np.float32)
        for r, i in enumerate(ids):
            s = sets[i]
            s = s[np.searchsorted(s, block[0]):np.searchsorted(s, block[-1], side="right")]
            at = np.searchsorted(block, s)
            m[r, at[block[np.minimum(at, len(block) - 1)] == s]] = 1
        return m

    for lo in range(0, len(shared), width):
        block = shared[lo:lo + width]
        out += part(rows, lo, block) @ part(cols, lo, block).T
    return out


class _Parts:
    """Disjoint sets over the nodes of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[a] = b
            self.links.append((i, j))

    def link_all(self, members: list[int], hit: np.ndarray) -> None:
        for i, j in np.argwhere(np.triu(hit, 1)):
            self.link(members[i], members[j])


class _Pairs:
    """Every link between the nodes of a task; none is implied by others."""

    def __init__(self, n: int):
        self.hit = np.zeros((n, n), dtype=bool)

    def find(self, i: int) -> int:
        return i

    def link(self, i: int, j: int) -> None:
        self.hit[i, j] = self.hit[j, i] = i != j

    def link_all(self, members: list[int], hit: np.ndarray) -> None:
        self.hit[np.ix_(members, members)] |= hit & ~np.eye(len(members), dtype=bool)

    def spanning(self) -> list[tuple[int, int]]:
        """Enough links to connect every part."""
        seen, out = np.zeros(len(self.hit), dtype=bool), []
        for start in range(len(self.hit)):
            todo = [] if seen[start] else [start]
            seen[start] = True
            while todo:
                i = todo.pop()
                new = np.flatnonzero(self.hit[i] & ~seen).tolist()
                seen[new] = True
                out += [(i, j) for j in new]
                todo += new
        return out

    def counts(self, rows: list[dict]) -> np.ndarray:
        """Per node, the copies of the nodes it is linked with, without the
        pairs that an earlier region holds too."""
        own = np.uint64(rows[0]["region_id"] & (1 << 64) - 1)
        earlier = [np.array(r["regions"], dtype=np.int64).view(np.uint64) for r in rows]
        earlier = [np.sort(e[e < own]) for e in earlier]
        hit, every = self.hit, list(range(len(rows)))
        if any(len(e) for e in earlier):
            hit = hit & (_overlaps(earlier, every, every) == 0)
        return hit.astype(np.int64) @ np.array([r["copies"] for r in rows], dtype=np.int64)


def _measure(sets, sizes, rows, cols) -> tuple[np.ndarray, np.ndarray]:
    both = _overlaps(sets, rows, cols).astype(np.int64)
    return both, sizes[rows][:, None] + sizes[cols][None, :] - both


def _pair_up(sets, sizes, members: list[int], percent: int, parts: _Parts | _Pairs) -> None:
    both, union = _measure(sets, sizes, members, members)
    parts.link_all(members, 100 * both >= percent * union)


def voronoi_join(sets: list[np.ndarray], members: list[int], p: JaccardParams, parts: _Parts | _Pairs,
                 sizes: np.ndarray | None = None, depth: int = 0) -> None:
    """Link, in ``parts``, all members whose distance is within the bound.

    Pivots are taken far from one another; a member belongs to the cell of its
    nearest pivot and, as a boundary member, to every cell whose pivot is at
    most ``2 * eps`` farther.  Any two linked members share a cell: if y is
    nearest to q, d(x, q) <= d(y, q) + eps <= d(y, r) + eps <= d(x, r) + 2 eps
    for the pivot r nearest to x."""
    if sizes is None:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
    roots = {parts.find(i) for i in members}
    if len(roots) < 2:
        return
    if len(members) <= p.cell_nodes or depth > 12:
        _pair_up(sets, sizes, members, p.percent, parts)
        return
    want = max(2, int(round(len(members) ** 0.5 / 2)))
    pivots, far = [], None
    distance = np.zeros((len(members), 0))
    at = 0
    while len(pivots) < want:
        both, union = _measure(sets, sizes, members, [members[at]])
        for i in np.flatnonzero(100 * both[:, 0] >= p.percent * union[:, 0]):
            parts.link(members[int(i)], members[at])
        d = 1.0 - both[:, 0] / union[:, 0]
        pivots.append(at)
        distance = np.column_stack([distance, d])
        far = d if far is None else np.minimum(far, d)
        at = int(far.argmax())
        if far[at] == 0.0:
            break
    window = 2 * (1 - p.percent / 100) + 1e-9
    cells = distance <= distance.min(axis=1)[:, None] + window
    if cells.sum() > 0.7 * cells.size:        # nothing is told apart
        _pair_up(sets, sizes, members, p.percent, parts)
        return
    for k in range(cells.shape[1]):
        cell = [members[int(i)] for i in np.flatnonzero(cells[:, k])]
        if len(cell) > 0.8 * len(members):
            _pair_up(sets, sizes, cell, p.percent, parts)
        elif len(cell) > 1:
            voronoi_join(sets, cell, p, parts, sizes, depth + 1)


#: an entry carries its node's centrality and size in one number
_SIZES = 1 << 36


def distinct_nodes(keyed: DataFrame) -> DataFrame:
    """One row per node of ``document_keys``: node, handle, n, central, keys,
    sketch, doc_id (the smallest of its documents) and copies.  Partial
    aggregation collapses copies before the shuffle."""
    return keyed.where("node is not null").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("handle", "n", "central", "keys", "sketch")],
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def region_members(nodes: DataFrame) -> DataFrame:
    """(pivot, handle, n): the nodes of every region, by handles (a handle is
    half of a node's identity; nodes that share one are told apart when the
    handle is looked up)."""
    entries = nodes.select(
        "handle", (F.col("central") * _SIZES + F.col("n")).alias("rank"), F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key")
    met = (entries.withColumn("top", F.max(F.struct("rank", "handle")).over(by_key))
           .withColumn("low", F.min("handle").over(by_key))
           .withColumn("high", F.max("handle").over(by_key))
           .where("low <> high"))
    return met.select(F.col("top.handle").alias("pivot"), "handle", F.pmod("rank", F.lit(_SIZES)).alias("n")
                      ).dropDuplicates(["pivot", "handle"])


def possible_regions(members: DataFrame, nodes: DataFrame, p: JaccardParams) -> DataFrame:
    """(region, pivot, node, n) of ``members`` (pivot, handle, n) and ``nodes``
    (handle, node, n, sketch): regions of at most ``region_nodes`` members
    reduced to members that sizes and sketches leave possible links for, a
    region per connected part; larger ones as they are (there the pivot
    stands in its own row only)."""
    size = members.groupBy("pivot").agg(F.count("*").alias("m"))
    sized = members.join(size, "pivot")
    large = sized.where(F.col("m") > p.region_nodes).drop("n").join(nodes.drop("sketch"), "handle").select(
        F.hex("pivot").cast("binary").alias("region"),
        F.when(F.col("pivot") == F.col("handle"), F.col("node")).alias("pivot"), "node", "n")
    by_size = Window.partitionBy("pivot").orderBy("n", "handle")
    small = (sized.where(F.col("m") <= p.region_nodes)
             .withColumn("before", F.lag("n").over(by_size)).withColumn("after", F.lead("n").over(by_size))
             .where((100 * F.col("before") >= p.percent * F.col("n"))
                    | (100 * F.col("n") >= p.percent * F.col("after")))
             .select("pivot", "handle"))

    def reduce(rows):
        sizes = np.array([r["n"] for r in rows], dtype=np.int64)
        parts, degree = _Parts(len(rows)), np.zeros(len(rows), np.int64)
        for i, j in possible_links([r["sketch"] for r in rows], sizes, p.percent):
            parts.link(i, j)
            degree[[i, j]] += 1
        held: dict[int, list[int]] = {}
        for i in np.flatnonzero(degree).tolist():
            held.setdefault(parts.find(i), []).append(i)
        out = {"region": [], "pivot": [], "node": [], "n": []}
        for group in held.values():
            names = sorted(rows[i]["node"] for i in group)
            name = blake2b(b"".join(names), digest_size=16).digest()
            top = rows[max(group, key=lambda i: (degree[i], rows[i]["node"]))]["node"]
            for i in group:
                for k, v in (("region", name), ("pivot", top), ("node", rows[i]["node"]), ("n", rows[i]["n"])):
                    out[k].append(v)
        return out

    small = _grouped(small.join(nodes, "handle").select("pivot", "node", "n", "sketch"), ["pivot"], reduce,
                     "region binary, pivot binary, node binary, n long")
    return small.union(large).groupBy("region", "node").agg(
        F.max("pivot").alias("pivot"), F.max("n").alias("n")).select("region", "pivot", "node", "n")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, a few at a time as Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 16):
            yield from batch.slice(lo, 16).to_pylist()


def _grouped(df: DataFrame, keys: list[str], handle, schema: str) -> DataFrame:
    """Sort by ``keys`` within partitions and hand every group's rows (a list
    of dicts) to ``handle``; one group is held at a time."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for row in _rows(batches):
            k = tuple(row[c] for c in keys)
            if k != key:
                if held:
                    yield record_batch(handle(held), target)
                held, key = [], k
            held.append(row)
        if held:
            yield record_batch(handle(held), target)
        release()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _once(rows: list[dict]) -> list[dict]:
    """The rows without repeated nodes (of documents that share their id)."""
    return list({r["node"]: r for r in rows}.values())


def _load(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["grams"], dtype=np.uint64) for r in rows]


def _counted(rows: list[dict], pairs: _Pairs) -> dict:
    """Links that connect the parts of a task, and its nodes' link counts."""
    tree, n = pairs.spanning(), pairs.counts(rows)
    some = np.flatnonzero(n).tolist()
    nodes = [r["node"] for r in rows]
    return {"a": [nodes[i] for i, _ in tree] + [nodes[i] for i in some],
            "b": [nodes[j] for _, j in tree] + [None] * len(some),
            "n": [None] * len(tree) + n[some].tolist()}


def links(docs: DataFrame, keyed: DataFrame, p: JaccardParams, count: bool = False) -> DataFrame:
    """(a, b, n): links between nodes, enough of them to connect every
    component; n is null.  With ``count`` also rows without b, whose n add up
    to the rows that a node is linked with, its own copies left out.
    ``keyed``: the document_keys of ``docs``."""
    nodes = materialize(distinct_nodes(keyed), "nodes")
    found = materialize(region_members(nodes), "region-members")
    sketches = nodes.select("node", "handle", "n", "sketch").join(
        found.select("handle").distinct(), "handle", "left_semi")
    members = materialize(possible_regions(found, sketches, p), "regions")
    size = (members.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("total"),
                                          F.max("pivot").alias("pivot"))
            .select("region", "pivot", F.greatest(F.ceil(F.col("m") / p.region_nodes), F.ceil(
                F.col("total") / p.region_shingles)).cast("int").alias("slices")))
    slots = (members.select("region", "node").join(size, "region")
             .withColumn("slice", F.when(F.col("slices") == 1, F.lit(0))
                         .otherwise(F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))))
    # the pivot's own set goes to every slice of a larger region
    repeated = size.where("slices > 1").withColumn("node", F.col("pivot")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cols = ["region", "pivot", "slices", "slice", "node"]
    slots = materialize(slots.select(*cols).union(repeated.select(*cols)).distinct(), "region-slots")
    wanted = nodes.select("node", "doc_id", "copies").join(slots.select("node").distinct(), "node", "left_semi")
    if count:
        within = members.groupBy("node").agg(F.collect_set(F.xxhash64("region")).alias("regions"))
        wanted = materialize(wanted.join(within, "node"), "region-nodes")
    held = node_sets(docs, wanted, p)
    if count:
        held = held.join(wanted.select("node", "copies", "regions"), "node")
        slots = slots.withColumn("region_id", F.xxhash64("region"))
    held = materialize(held, "region-sets")
    if slots.count() <= p.broadcast_ids:
        slots = F.broadcast(slots)
    percent = p.percent

    def first(rows):
        rows = _once(rows)
        s = _load(rows)
        sizes = np.array([len(x) for x in s], dtype=np.int64)
        nodes, pivot = [r["node"] for r in rows], rows[0]["pivot"]
        if count and rows[0]["slices"] == 1:
            pairs = _Pairs(len(rows))
            voronoi_join(s, list(range(len(rows))), p, pairs, sizes)
            out = _counted(rows, pairs)
            return out | {"region": [None] * len(out["a"]), "d": [0.0] * len(out["a"])}
        if rows[0]["slices"] == 1:
            parts = _Parts(len(rows))
            voronoi_join(s, list(range(len(rows))), p, parts, sizes)
            return {"region": [None] * len(parts.links), "a": [nodes[i] for i, _ in parts.links],
                    "b": [nodes[j] for _, j in parts.links], "d": [0.0] * len(parts.links),
                    "n": [None] * len(parts.links)}
        at = nodes.index(pivot)
        both, union = _measure(s, sizes, list(range(len(rows))), [at])
        out = {"region": [], "a": [], "b": [], "d": [], "n": [None] * len(nodes)}
        for i, node in enumerate(nodes):
            linked = not count and 100 * both[i, 0] >= percent * union[i, 0]
            out["region"].append(rows[0]["region"])
            out["a"].append(node)
            out["b"].append(pivot if linked else None)
            out["d"].append(1.0 - both[i, 0] / union[i, 0])
        return out

    found = materialize(_grouped(held.join(slots, "node"), ["region", "slice"], first,
                                 "region binary, a binary, b binary, d double, n long"), "region-links")
    edges = found.where("region is null or b is not null").select("a", "b", "n")
    far = found.where("region is not null").select("region", "a", "b", "d").dropDuplicates(["region", "a"])
    if far.isEmpty():
        return edges
    return edges.union(materialize(_large_regions(far, held, p, count), "large-region-links"))


def _large_regions(far: DataFrame, held: DataFrame, p: JaccardParams, count: bool) -> DataFrame:
    """Links within regions that exceed a task: slices in order of the
    distance to the pivot, joined with the slices within ``eps`` of them.
    Two slices of nodes that are all linked with the pivot need no join
    (where links are counted, ``far`` says of no node that it is)."""
    eps = 1 - p.percent / 100 + 1e-9
    sizes = held.groupBy(F.col("node").alias("a")).agg(F.max(F.length("grams") / 8).alias("n"))
    far = far.join(sizes, "a")      # tables in between are written: one plan of all steps would be too large
    # fine steps of distance, packed into slices of half a task's bound
    load = F.greatest(F.col("k") / (p.region_nodes / 2), F.col("kn") / (p.region_shingles / 2))
    sums = F.count("*").alias("k"), F.sum("n").alias("kn")
    fine = materialize(far.withColumn("near", F.col("b").isNotNull()).withColumn(
        "step", F.floor(F.col("d") * 200).cast("int")), "large-region-steps")
    # as many salts as a step's own load needs
    salts = fine.groupBy("region", "near", "step").agg(*sums).select(
        "region", "near", "step", F.greatest(F.lit(1), F.ceil(4 * load)).cast("long").alias("salts"))
    fine = materialize(fine.join(salts, ["region", "near", "step"]).withColumn(
        "salt", F.pmod(F.xxhash64("a"), F.col("salts"))).drop("salts"), "large-region-salts")
    counts = fine.groupBy("region", "near", "step", "salt").agg(*sums)
    order = Window.partitionBy("region", "near").orderBy("step", "salt")
    packed = counts.withColumn("load", load).withColumn(
        "slice", F.floor(F.sum("load").over(order) - F.col("load") / 2).cast("int")).select(
        "region", "near", "step", "salt", "slice")
    placed = materialize(fine.join(packed, ["region", "near", "step", "salt"]), "large-region-slices")
    cells = placed.groupBy("region", "near", "slice").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"))
    left = cells.select("region", *[F.col(c).alias(f"l_{c}") for c in ("near", "slice", "lo", "hi")])
    right = cells.select("region", *[F.col(c).alias(f"r_{c}") for c in ("near", "slice", "lo", "hi")])
    meet = (left.join(right, "region")
            .where("not l_near and (r_near or r_slice >= l_slice)")
            .where((F.col("r_lo") <= F.col("l_hi") + eps) & (F.col("l_lo") <= F.col("r_hi") + eps))
            .withColumn("task", F.concat_ws("/", F.hex("region"), "l_slice", "r_near", "r_slice"))
            .withColumn("region_id", F.xxhash64("region")))
    meet = materialize(meet, "large-region-tasks")
    one = meet.select("task", "region", "region_id", F.col("l_near").alias("near"), F.col("l_slice").alias("slice"))
    two = meet.select("task", "region", "region_id", F.col("r_near").alias("near"), F.col("r_slice").alias("slice"))
    rows = (one.union(two).distinct().join(placed, ["region", "near", "slice"])
            .select("task", "region_id", F.col("a").alias("node"), "near", "slice").join(held, "node"))

    def join(rows):
        rows = _once(rows)
        s = _load(rows)
        if count:
            pairs = _Pairs(len(rows))
            one, *two = [[i for i, r in enumerate(rows) if r["slice"] == k] for k in {r["slice"] for r in rows}]
            if two:
                both, union = _measure(s, np.array([len(x) for x in s], dtype=np.int64), one, two[0])
                hit = 100 * both >= p.percent * union
                pairs.hit[np.ix_(one, two[0])], pairs.hit[np.ix_(two[0], one)] = hit, hit.T
            else:
                voronoi_join(s, one, p, pairs)
            return _counted(rows, pairs)
        parts = _Parts(len(rows))
        near = [i for i, r in enumerate(rows) if r["near"]]
        for i in near[1:]:
            parts.link(near[0], i)          # all linked with the pivot
        known = len(parts.links)
        voronoi_join(s, list(range(len(rows))), p, parts)
        new = parts.links[known:]
        return {"a": [rows[i]["node"] for i, _ in new], "b": [rows[j]["node"] for _, j in new],
                "n": [None] * len(new)}

    return _grouped(rows, ["task"], join, "a binary, b binary, n long")


def jaccard_components(docs: DataFrame, params: JaccardParams | None = None, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, and with ``count_links`` n_links, for
    every row of ``docs`` (doc_id, text; other columns are ignored).

    n_links is the number of other rows within the bound of this one, copies
    and repeated rows included.

    component_id is the smallest doc_id reachable by links.  A document
    without words (or without text) has no shingles and is linked with
    nothing, its component_id is its doc_id.  Repeated rows stay repeated.
    A null doc_id takes part like any other and is never the smallest; its
    component_id is null if no document with an id is reachable.  The input
    may be empty."""
    p = params or JaccardParams()
    docs = docs.select("doc_id", "text")
    keyed = materialize(document_keys(docs, p), "shingle-keys")
    linked = links(docs, keyed, p, count_links)
    found = components(linked)
    plain = keyed.select("doc_id", "n", "node")
    nodes = plain.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    labelled = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    label = labelled.where("root <> node").join(roots, "root").select("node", "component_id").union(
        roots.select(F.col("root").alias("node"), "component_id"))
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    if count_links:
        counts = linked.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        own = nodes.select("node", "copies").join(counts, "node", "left").select(
            "node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        label = label.join(own, "node")
        cols.append("n_links")
    empty = plain.where("node is null").withColumn("component_id", F.col("doc_id")).withColumn(
        "n_links", F.lit(0).cast("long"))
    return plain.where("node is not null").join(label, "node").select(*cols).unionByName(empty.select(*cols))


def keep_one(docs: DataFrame, params: JaccardParams | None = None) -> DataFrame:
    """One row of ``docs`` for each component: of the smallest doc_id (null
    ones last), then of the least text digest, then the least row.  Repeated
    rows, rows that share an id and rows without an id go like any other.
    Rows without words are linked with nothing and all stay."""
    p = params or JaccardParams()
    keyed = materialize(document_keys(docs.select("doc_id", "text"), p), "shingle-keys")
    found = components(links(docs.select("doc_id", "text"), keyed, p))
    rows = keyed.where("node is not null").groupBy("doc_id", "digest").agg(
        F.first("node").alias("node"), F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    nodes = keyed.where("node is not null").groupBy("node").agg(least.alias("least"))
    first = (nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
             .agg(F.min("least").alias("least"))
             .select(F.col("least.doc_id").alias("first_id"), F.col("least.digest").alias("first_digest")))
    # a row's doc_id and digest settle whether it goes; all but one row of repeated ones go
    cut = materialize(
        rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
        .where("first_digest is null or copies > 1")
        .select(F.col("doc_id").alias("cut_id"), F.col("digest").alias("cut_digest"),
                F.col("first_digest").isNotNull().alias("repeated")), "copies")
    repeated = cut.where("repeated")
    if cut.count() <= p.broadcast_ids:
        cut, repeated = F.broadcast(cut), F.broadcast(repeated)
    same = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (text_digest() == F.col("cut_digest"))
    one = (docs.join(repeated, same, "left_semi").groupBy("doc_id", text_digest().alias("of_text"))
           .agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return docs.join(cut, same, "left_anti").unionByName(one)
