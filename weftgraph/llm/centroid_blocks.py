"""Centroid clustering in integers: |x|^2 - 2 x.c + |c|^2 by blocked float64 matrix products, sums combined by RDD treeAggregate.

Components are turned into integers floor(scale * x). A product of a block of vectors with the centroids is exact in float64
as long as every number on the way stays below 2^53; a bound on magnitudes says for which rows of a block that holds, and the
others are worked out in Python's integers. So assignments, ties included, don't depend on blocks, tasks or the BLAS in use.

Each round is one pass over the vectors: tasks hand on a row of sums and counts per centroid, which treeAggregate adds up in
two levels; centroids are floors of exact quotients. Nothing of a vector reaches the driver but the k seeds.

Defined results: vectors of another length, null ones and those with a null or non-finite component are left out; repeated
rows count each; a vector without an id is never a seed; equal distances go to the smaller number; an empty centroid stays.
With fewer vectors than k there are as many centroids as seeds; an empty table gives an empty result. A distance or a sum of
distances beyond 64 bits is null. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import hashlib
import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import ship

EXACT = 1 << 53
LONG = (1 << 63) - 1
#: Rows of a block.
BLOCK = 4096


def usable(column: str, length: int) -> Column:
    c = F.col(column)
    good = F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # false for NaN, which is greatest
    return c.isNotNull() & (F.size(c) == length) & good


def seeds(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The integer components of the k vectors with the least hash of their id; equal ids by their components."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = kept.filter("id IS NOT NULL").select("v", h.alias("h")).orderBy("h", "v").limit(k)
    return [r["v"] for r in first.collect()]


def integers(vectors, scale: int):
    """floor(scale * x) in float64, where scaling by a power of two and the floor are exact."""
    import numpy as np

    return np.floor(np.asarray(vectors, dtype=np.float64) * scale)


def blocks(batch, length: int, scale: int):
    """An Arrow batch (id, v) -> pairs of a slice of ids and the matrix of its integers."""
    ids, lists = batch.column(0), batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    for a in range(0, batch.num_rows, BLOCK):
        yield ids.slice(a, BLOCK), integers(flat[a : a + BLOCK], scale)


def whole(row) -> list[int]:
    return [int(x) for x in row]


def nearest(x, centroids: list[list[int]]):
    """(numbers, distances) of a block's nearest centroids; distances are 64-bit integers, or Python's where a row needs them.

    With m the greatest component of a row and c that of all centroids, every partial sum of the three terms is at most
    length * (m + c)^2."""
    import numpy as np

    length = x.shape[1]
    most = max((abs(v) for c in centroids for v in c), default=0)
    size = np.abs(x).max(axis=1) if x.size else np.zeros(len(x))
    limit = max(-1, int((EXACT / length) ** 0.5) - most - 1)  # rounded down: length * (m + c)^2 < 2^53
    safe = size <= limit
    numbers, distances = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int64)
    if safe.any():
        c = np.array(centroids, dtype=np.float64)
        y = x[safe]
        d = np.einsum("ij,ij->i", y, y)[:, None] - 2 * (y @ c.T) + np.einsum("ij,ij->i", c, c)
        best = d.argmin(axis=1)
        numbers[safe] = best
        distances[safe] = d[np.arange(len(y)), best].astype(np.int64)
    if safe.all():
        return numbers, distances
    distances = distances.astype(object)
    for i in np.nonzero(~safe)[0]:
        row = whole(x[i])
        d = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
        distances[i] = min(d)
        numbers[i] = d.index(distances[i])
    return numbers, distances


def added(x, numbers, distances, k: int) -> list:
    """[counts, sums of components, sums of distances] by centroid, as Python's integers where 64 bits might not do."""
    import numpy as np

    counts = np.bincount(numbers, minlength=k).astype(object)
    if not x.size or float(np.abs(x).max()) * len(x) < EXACT:
        onto = np.zeros((k, len(x)))
        onto[numbers, np.arange(len(x))] = 1.0
        sums = (onto @ x).astype(np.int64).astype(object)
    else:
        sums = np.zeros((k, x.shape[1]), dtype=object)
        for i, n in enumerate(numbers):
            sums[n] += np.array(whole(x[i]), dtype=object)
    if distances.dtype != object and int(distances.max(initial=0)) * len(x) < EXACT:
        inertia = np.bincount(numbers, weights=distances, minlength=k).astype(np.int64).astype(object)
    else:
        inertia = np.zeros(k, dtype=object)
        np.add.at(inertia, numbers, distances.astype(object))
    return [counts, sums, inertia]


def _together(a, b):
    return b if a is None else a if b is None else [x + y for x, y in zip(a, b)]


def totals(kept: DataFrame, centroids: list[list[int]], length: int, scale: int):
    """added() over all vectors: a row per task, combined by treeAggregate in two levels."""
    k = len(centroids)

    def run(batches):
        import pyarrow as pa

        sums = None
        for batch in batches:
            for _, x in blocks(batch, length, scale):
                sums = _together(sums, added(x, *nearest(x, centroids), k))
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

    rows = kept.select("id", "v").mapInArrow(run, "sums binary").rdd
    return rows.treeAggregate(None, lambda acc, r: _together(acc, pickle.loads(bytes(r["sums"]))), _together, 2)


def fit(kept: DataFrame, length: int, k: int, rounds: int, scale: int, salt: str) -> list[list[int]]:
    """The centroids after `rounds` rounds of assigning and averaging."""
    centroids = [whole(integers(v, scale)) for v in seeds(kept, k, salt)]
    for _ in range(rounds if centroids else 0):
        counts, sums, _ = totals(kept, centroids, length, scale)
        centroids = [[int(s) // int(n) for s in row] if n else c for n, row, c in zip(counts, sums, centroids)]
    return centroids


def _long(x) -> int | None:
    return int(x) if x is not None and x <= LONG else None


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", length: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:") -> DataFrame:
    """A row per usable vector: its id, cluster, distance, cluster_inertia, inertia and centroid_sha256. scale must be a power
    of two."""
    ship(vectors.sparkSession)
    kept = vectors.filter(usable(f"`{vector_column}`", length)).select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    centroids = fit(kept, length, k, rounds, scale, salt)
    found = totals(kept, centroids, length, scale) if centroids else None
    inertia = [int(x) for x in found[2]] if found else []
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # a row without an id among too few for a seed has no cluster
    by_cluster, overall = [_long(x) for x in inertia], _long(sum(inertia))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, x in blocks(batch, length, scale):
                if not centroids:
                    continue
                numbers, distances = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(numbers, pa.int32()),
                        pa.array(distances if distances.dtype != object else [_long(d) for d in distances], pa.int64()),
                        pa.array([by_cluster[n] for n in numbers], pa.int64()),
                        pa.array([overall] * len(numbers), pa.int64()),
                        pa.array([hashes[n] for n in numbers], pa.string()),
                    ],
                    names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    schema = T.StructType([kept.schema["id"], *[T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType()))]])
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def oracle(length: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:") -> str:
    """The same in SQL, a pair of tables a round. Products of these tables are exact in doubles."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {length})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), x) - 1 AS n, x AS c FROM v WHERE vec_id IS NOT NULL QUALIFY n < {k})",
    ]
    for i in range(rounds + 1):
        distance = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, n, d FROM (SELECT r, n, {distance} AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, n) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT n, p, floor(sum(x[p]) / count(*)) AS y FROM a{i} JOIN v USING (r), range(1, {length + 1}) g(p) GROUP BY n, p)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.y, c.c) AS c FROM c{i} c LEFT JOIN (SELECT n, list(y ORDER BY p) AS y FROM m{i} GROUP BY n) m USING (n))")
    last = f"SELECT vec_id, n::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY n)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(list_aggregate(list_transform(c, lambda y: y::BIGINT), 'string_agg', ',')) AS centroid_sha256"
    return "WITH " + ",\n".join(parts) + f"\n{last} FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (n)"
