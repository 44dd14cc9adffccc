"""Centroid clustering on exact integers, with bounds that most vectors keep.

Vectors become integer vectors; centroids are integer vectors too, so every
distance, sum and tie is exact.  Per vector an upper bound of the distance to
its own centroid and a lower bound of the distance to any other are carried
from round to round.  When centroids move, the upper bound grows by the drift
of its own one.  The lower bound shrinks by less than the full drift of the
others: the vectors of a cluster lie in a sphere around its old centroid, and
in the plane through that centre and a moving centroid's two places the sphere
is a disc.  Seen from the midpoint of the move, the disc subtends a cone; no
point of it comes nearer by more than ``drift * cos`` of the cone's smallest
angle with the move (a hyperbola about the two places lies within its
asymptotes).  Vectors whose bounds leave no doubt keep their centroid unread;
the others are scanned exactly.  Bounds are rounded outwards.

Vectors are written once, in blocks, as a table bucketed by block; a round reads
them together with the small bucketed table of bounds (no shuffle, no sort) and
writes the next one, with the sums of every block changed by moved vectors
only.  The driver sees k rows of sums, counts and radii a round.  Each round is
a table in the shared checkpoint folder, so a lost executor costs one round.

Vectors of another size, with a null or a non-finite component, or null ones
are left out; repeated ids and equal vectors are vectors of their own; a null
id hashes as an empty string.  Ties go to the smaller number.  With fewer
vectors than centroids there are as many centroids as vectors; without any the
result is empty.  Components of 2^27 or more (after scaling) are refused with
an error, since squared distances would leave the range of a long.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import arrow_schema, record_batch
from cohortflow.sources.cube_store import materialize, scratch_path

BLOCK = 1024                      # vectors of a block
BUCKET_BYTES = 64 << 20
LARGEST = 1 << 27
RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
          "centroid_sha256 string")


@dataclass(frozen=True)
class CentroidParams:
    dims: int = 64
    scale: int = 1024
    k: int = 8
    rounds: int = 10
    seed: str = "3"


# ------------------------------------------------------------------ geometry
def nearer_by(center: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """An upper bound of ``|x - old| - |x - new|`` over the ball of ``radius``
    around ``center``."""
    move = new - old
    drift = float(np.linalg.norm(move))
    if drift == 0:
        return 0.0
    away = center - (old + new) / 2
    along = float(away @ move) / drift              # the plane's two coordinates
    across = float(np.linalg.norm(away - along * move / drift))
    far = float(np.hypot(along, across))
    if radius >= far:
        return drift
    angle = float(np.arctan2(across, along)) - float(np.arcsin(radius / far))
    return drift if angle <= 0 else drift * max(0.0, float(np.cos(angle)))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the lower bounds of every cluster's vectors shrink."""
    k = len(old)
    a, b = old.astype(np.float64), new.astype(np.float64)
    moved = np.flatnonzero((old != new).any(axis=1))
    return np.array([max([0.0, *(nearer_by(a[i], float(radius[i]), a[j], b[j]) for j in moved if j != i)])
                     for i in range(k)]) * (1 + 1e-9) + 1e-9


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half of every centroid's distance to the nearest other one."""
    c = centroids.astype(np.float64)
    gaps = np.array([[np.linalg.norm(x - y) for y in c] for x in c]).reshape(len(c), len(c))
    np.fill_diagonal(gaps, np.inf)
    return gaps.min(axis=1) / 2 * (1 - 1e-9)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = vectors.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", d, d)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


@dataclass(frozen=True)
class Move:
    """What a task needs to bring bounds from one set of centroids to the next."""

    centroids: np.ndarray
    drift: np.ndarray
    loosen: np.ndarray
    half_gap: np.ndarray

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
        drift = np.linalg.norm((new - old).astype(np.float64), axis=1) * (1 + 1e-9)
        return Move(new, drift, loosening(old, new, radius), half_gaps(new))

    @staticmethod
    def start(centroids: np.ndarray) -> Move:
        nothing = np.zeros(len(centroids))
        return Move(centroids, nothing, nothing, half_gaps(centroids))


def assign(vectors: np.ndarray, move: Move, cluster: np.ndarray | None = None,
           upper: np.ndarray | None = None, lower: np.ndarray | None = None):
    """(cluster, upper, lower, vectors scanned) under the moved centroids; no
    earlier bounds: all vectors are scanned."""
    n = len(vectors)
    if cluster is None:
        cluster = np.zeros(n, dtype=np.int32)
        upper, lower = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        doubt = np.arange(n)
    else:
        cluster = cluster.copy()
        upper = _up(upper.astype(np.float64) + move.drift[cluster])
        lower = _down(lower.astype(np.float64) - move.loosen[cluster])
        apart = np.maximum(lower, move.half_gap[cluster])
        doubt = np.flatnonzero(~(upper < apart))
        own = np.sqrt(squared(vectors[doubt], move.centroids[cluster[doubt]]).astype(np.float64))
        upper[doubt] = _up(own)
        doubt = doubt[~(upper[doubt] < apart[doubt])]
    if len(doubt):
        part = vectors[doubt]
        best = np.full(len(doubt), np.iinfo(np.int64).max)
        second = best.copy()
        which = np.zeros(len(doubt), dtype=np.int32)
        for j in range(len(move.centroids)):
            d = squared(part, move.centroids[j])
            nearer = d < best
            second = np.where(nearer, best, np.minimum(second, d))
            which[nearer] = j
            best = np.where(nearer, d, best)
        cluster[doubt] = which
        upper[doubt] = _up(np.sqrt(best.astype(np.float64)))
        lower[doubt] = _down(np.sqrt(second.astype(np.float64)))
    return cluster, upper, lower, len(doubt)


# ------------------------------------------------------------------ tables
def integer_vectors(embeddings: DataFrame, params: CentroidParams, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the kept vectors: ``floor(scale * x)`` of every component."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return embeddings.where((F.size(x) == params.dims) & finite).select(
        F.col(id_col).alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * params.scale)).alias("vec"))


def starting_centroids(vectors: DataFrame, params: CentroidParams) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of ``seed:vec_id`` (then of the
    smallest components), in that order."""
    key = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "vec").orderBy("key", "vec").limit(params.k).collect()
    out = np.array([r["vec"] for r in rows], dtype=np.int64).reshape(len(rows), params.dims)
    _check_range(out)
    return out


def _check_range(v: np.ndarray) -> None:
    if len(v) and (v.max() >= LARGEST or v.min() <= -LARGEST):
        raise ValueError(f"a component is {LARGEST} or more: squared distances do not fit a long")


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """(ids, vectors): blocks of at most BLOCK vectors as 32-bit integers."""
    schema = "ids array<long>, vectors binary"
    target = arrow_schema(vectors.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                _check_range(flat)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()),
                                               part.column(0).cast(pa.int64()))
                yield record_batch({"ids": ids, "vectors": pa.array([flat.astype("<i4").tobytes()], pa.binary())},
                                   target)

    return vectors.mapInArrow(run, schema)


class _Bucketed:
    """External tables in the checkpoint folder, bucketed by block."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.top = scratch_path(spark, "centroids")
        self.prefix = f"cohortflow_centroids_{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        (df.write.mode("overwrite").option("path", f"{self.top}/{name}")
         .bucketBy(self.buckets, "block").format("parquet").saveAsTable(f"{self.prefix}_{name}"))
        return self.spark.table(f"{self.prefix}_{name}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


STATE = ("block long, cluster binary, upper binary, lower binary, totals array<long>, radius array<double>, "
         "scanned long")


def _with_state(blocks: DataFrame, state: DataFrame | None, columns: list[str]) -> DataFrame:
    if state is None:
        return blocks.select(*columns, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "binary"), ("upper", "binary"), ("lower", "binary"), ("totals", "array<long>"))])
    held = state.select("block", "cluster", "upper", "lower", "totals").hint("shuffle_hash")
    return blocks.select(*columns).join(held, "block").select(*columns, "cluster", "upper", "lower", "totals")


def _unpack(row, dims: int):
    vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, dims)
    if row["cluster"] is None:
        return vectors, None, None, None
    return (vectors, np.frombuffer(row["cluster"], "<i4"), np.frombuffer(row["upper"], "<f4"),
            np.frombuffer(row["lower"], "<f4"))


def _rows(batches):
    """Rows of batches as dictionaries, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}


def _totals(vectors, before, after, totals, k: int) -> np.ndarray:
    """Component sums and counts by cluster: all of them, or ``totals`` changed
    by the vectors that moved."""
    dims = vectors.shape[1]
    if before is None:
        out, moved = np.zeros((k, dims + 1), dtype=np.int64), np.arange(len(after))
    else:
        out, moved = np.array(totals, dtype=np.int64).reshape(k, dims + 1), np.flatnonzero(before != after)
        for j in np.unique(before[moved]).tolist():
            gone = moved[before[moved] == j]
            out[j, :dims] -= vectors[gone].sum(axis=0, dtype=np.int64)
            out[j, dims] -= len(gone)
    for j in np.unique(after[moved]).tolist():
        come = moved[after[moved] == j]
        out[j, :dims] += vectors[come].sum(axis=0, dtype=np.int64)
        out[j, dims] += len(come)
    return out.ravel()


def _round(blocks: DataFrame, state: DataFrame | None, move: Move, dims: int) -> DataFrame:
    """The state under the moved centroids."""
    k = len(move.centroids)
    target = arrow_schema(blocks.sparkSession, STATE)

    def run(batches):
        for row in _rows(batches):
            vectors, before, upper, lower = _unpack(row, dims)
            after, upper, lower, scanned = assign(vectors, move, before, upper, lower)
            radius = np.zeros(k)
            np.maximum.at(radius, after, upper.astype(np.float64))
            yield record_batch({
                "block": [row["block"]], "cluster": [after.astype("<i4").tobytes()],
                "upper": [upper.astype("<f4").tobytes()], "lower": [lower.astype("<f4").tobytes()],
                "totals": [_totals(vectors, before, after, row["totals"], k)], "radius": [radius],
                "scanned": [scanned]}, target)

    return _with_state(blocks, state, ["block", "vectors"]).mapInArrow(run, STATE)


def _summary(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(component sums, counts, radii) over all blocks: k * (dims + 1) numbers."""
    rows = (state.select(F.posexplode(F.arrays_zip("totals", "radius")).alias("at", "x"))
            .groupBy("at").agg(F.sum("x.totals").alias("total"), F.max("x.radius").alias("radius")).collect())
    totals, radius = np.zeros(k * (dims + 1), dtype=np.int64), np.zeros(k)
    for r in rows:
        totals[r["at"]] = r["total"]
        if r["at"] < k:
            radius[r["at"]] = r["radius"]
    totals = totals.reshape(k, dims + 1)
    return totals[:, :dims], totals[:, dims].tolist(), radius


def _final(blocks: DataFrame, state: DataFrame | None, move: Move, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) under the last centroids."""
    schema = "vec_id long, cluster int, distance long"
    target = arrow_schema(blocks.sparkSession, schema)

    def run(batches):
        for row in _rows(batches):
            vectors, before, upper, lower = _unpack(row, dims)
            after = assign(vectors, move, before, upper, lower)[0]
            yield record_batch({"vec_id": row["ids"], "cluster": after,
                                "distance": squared(vectors, move.centroids[after])}, target)

    return _with_state(blocks, state, ["block", "ids", "vectors"]).mapInArrow(run, schema)


def cluster(embeddings: DataFrame, params: CentroidParams = CentroidParams(), id_col: str = "vec_id",
            vector_col: str = "embedding", log: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    every kept vector after ``rounds`` updates and a last assignment.  ``log``
    takes (vectors scanned, vectors) of every round."""
    spark, dims = embeddings.sparkSession, params.dims
    vectors = integer_vectors(embeddings, params, id_col, vector_col)
    now = starting_centroids(vectors, params)
    k = len(now)
    if k == 0:
        return spark.createDataFrame([], RESULT)
    n = vectors.count()
    buckets = min(100_000, max(spark.sparkContext.defaultParallelism, -(-n * dims * 4 // BUCKET_BYTES)))
    tables = _Bucketed(spark, buckets)
    packed = materialize(_blocks(vectors, dims), "vector-blocks").withColumn(
        "block", F.monotonically_increasing_id())
    blocks = tables.write(packed.repartition(buckets, "block"), "vectors")
    move, state = Move.start(now), None
    for i in range(params.rounds):
        state = tables.write(_round(blocks, state, move, dims), f"state_{i}")
        if i:
            tables.drop(f"state_{i - 1}")
        sums, counts, radius = _summary(state, k, dims)
        if log is not None:
            log.append((state.agg(F.sum("scanned")).first()[0], n))
        new = now.copy()
        for j in range(k):
            if counts[j]:
                new[j] = np.floor_divide(sums[j], counts[j])
        move, now = Move.between(now, new, radius), new
    done = materialize(_final(blocks, state, move, dims), "clusters")
    if state is not None:
        tables.drop(f"state_{params.rounds - 1}")
    tables.drop("vectors")
    inertia = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(j, inertia.get(j, 0), sum(inertia.values()),
             sha256(",".join(map(str, now[j].tolist())).encode()).hexdigest()) for j in range(k)]
    per_cluster = spark.createDataFrame(rows, T.StructType.fromDDL(
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return done.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(table: str = "embeddings", params: CentroidParams = CentroidParams()) -> str:
    """The same clustering as one DuckDB statement (ids are taken as unique)."""
    p = params
    parts = [f"""vecs AS MATERIALIZED (SELECT vec_id, [floor({p.scale} * x::DOUBLE)::BIGINT for x in embedding] AS v
 FROM {table} WHERE len(embedding) = {p.dims}
 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x::DOUBLE)]) = {p.dims})""",
             f"""comp AS MATERIALIZED (SELECT vec_id, unnest(range({p.dims})) AS dim, unnest(v) AS x FROM vecs)""",
             f"""first_k AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{p.seed}:' || vec_id::VARCHAR)) - 1 AS c
 FROM vecs QUALIFY c < {p.k})""",
             """c0 AS MATERIALIZED (SELECT c, dim, x AS m FROM first_k JOIN comp USING (vec_id))"""]
    for i in range(p.rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM
 (SELECT vec_id, c, sum((x - m) * (x - m))::BIGINT AS d FROM comp JOIN c{i} USING (dim) GROUP BY vec_id, c)
 GROUP BY vec_id)""")
        if i < p.rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, dim, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN
 (SELECT c, dim, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT c, dim, sum(x)::BIGINT AS s, count(*) AS n
  FROM a{i} JOIN comp USING (vec_id) GROUP BY c, dim)) n USING (c, dim))""")
    last = p.rounds
    return ("WITH " + ",\n".join(parts) + f""",
digest AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
 (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{last} JOIN digest USING (c)""")
