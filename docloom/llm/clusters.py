"""Lloyd clustering on whole numbers with scalar lookup tables.

Every round tabulates, for each dimension, the squared difference of each value that occurs and each centroid; the
distances of a block of vectors are gathers from these tables and sums of what they give. Tasks add up the vectors of
each centroid, Spark adds the tasks' sums, and the driver sees one number for each centroid and dimension.

Defined results: vectors are kept if they have exactly ``width`` components, none null or non-finite; others have no row.
Null and repeated ids are vectors of their own (a null id counts as an empty one in the order of starts). Equal hashes are
settled by the vector. With fewer vectors than clusters there are as many clusters as vectors. A distance or inertia beyond 64 bits is
null, while assignments stay exact. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import vectors, work

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Vectors of a block: bounds what the tables and gathers take.
BLOCK = 4096


def tabulated(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vector, centroid): for each dimension one table over the values that occur."""
    out = np.zeros((len(q), len(centroids)), np.result_type(q.dtype, centroids.dtype))
    for d in range(q.shape[1]):
        column = q[:, d]
        low = column.min()
        if q.dtype != object and (span := int(column.max() - low) + 1) <= 8 * len(column):
            seen = np.zeros(span, bool)
            seen[column - low] = True
            occurring = np.flatnonzero(seen)
            number = np.cumsum(seen) - 1
            where, occurring = number[column - low], occurring + low
        else:
            occurring, where = np.unique(column, return_inverse=True)
        out += ((occurring[:, None] - centroids[None, :, d]) ** 2)[where]
    return out


def _blocks(batch: pa.RecordBatch, width: int, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their vectors, nearest centroid, squared distance) of a batch."""
    for at in range(0, len(batch), BLOCK):
        near, q, far, wide = vectors.matrices(batch.slice(at, BLOCK), width)
        for rows, matrix in ((near, q), (far, wide)):
            if len(rows):
                apart = tabulated(matrix, centroids)
                best = np.argmin(apart, axis=1)
                yield rows + at, matrix, best, apart[np.arange(len(rows)), best]


def _sums(centroids: np.ndarray, width: int):
    """Per centroid: the sums by dimension, then the count and the distances."""
    places = width + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            for _, matrix, best, apart in _blocks(batch, width, centroids):
                for c in np.unique(best):
                    mine = best == c
                    for k, n in enumerate([*matrix[mine].sum(axis=0).tolist(), int(mine.sum()), sum(apart[mine].tolist())]):
                        held[int(c) * places + k] = held.get(int(c) * places + k, 0) + n
        yield vectors.sum_rows(held)

    return run


def _assigned(centroids: np.ndarray, width: int, inertia: list[int]):
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own, all_ = [vectors.as_long(n) for n in inertia], vectors.as_long(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(len(batch), np.int32), [None] * len(batch)
            for rows, _, best, apart in _blocks(batch, width, centroids):
                cluster[rows] = best
                for i, d in zip(rows.tolist(), apart.tolist(), strict=True):
                    distance[i] = vectors.as_long(d)
            c = cluster.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64()), pa.array([own[i] for i in c], pa.int64()), pa.array([all_] * len(c), pa.int64()), pa.array([shas[i] for i in c], pa.string())],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return run


def starts(kept: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id: as many rows as clusters."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [vectors.plain(r) for r in kept.select("q", "wide", order.alias("h")).orderBy("h", "wide", "q").limit(clusters).collect()]


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    kept = work.table(vectors.prepared(embeddings, scale, width), "vectors")
    centroids, places = starts(kept, clusters, seed), width + 2
    for k in range(rounds + 1):
        total = vectors.totals(kept.mapInArrow(_sums(vectors.integers(centroids), width), vectors.SUMS)) if centroids else {}
        if k < rounds:
            count = [total.get(c * places + width, 0) for c in range(len(centroids))]
            centroids = [[total.get(c * places + d, 0) // n for d in range(width)] if (n := count[c]) else old for c, old in enumerate(centroids)]
    inertia = [total.get(c * places + width + 1, 0) for c in range(len(centroids))]
    return kept.mapInArrow(_assigned(vectors.integers(centroids), width, inertia), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def oracle() -> str:
    """All rounds as one query."""
    floor = lambda s, n: f"({s} - (({s} % {n}) + {n}) % {n}) // {n}"
    steps = [
        f"v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})",
        f"q AS MATERIALIZED (SELECT vec_id, d, CAST(floor({SCALE} * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM v, range(1, {WIDTH + 1}) AS r(d))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM v QUALIFY c < {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM s JOIN q USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, min((s, c)) AS best FROM (SELECT q.vec_id, c, sum((q.x - m.x) * (q.x - m.x)) AS s FROM q JOIN c{k} AS m USING (d) GROUP BY ALL) GROUP BY vec_id)")
        if k < ROUNDS:
            steps.append(f"m{k} AS (SELECT best[2] AS c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN q USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c0.c, c0.d, coalesce({floor('m.s', 'm.n')}, o.x) AS x FROM c{k} AS o JOIN c0 USING (c, d) LEFT JOIN m{k} AS m USING (c, d))")
    return "WITH " + ",\n".join(steps) + f""",
z AS (SELECT vec_id, CAST(best[2] AS INT) AS cluster, CAST(best[1] AS BIGINT) AS distance FROM a{ROUNDS}),
h AS (SELECT CAST(c AS INT) AS cluster, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM z JOIN h USING (cluster)"""
