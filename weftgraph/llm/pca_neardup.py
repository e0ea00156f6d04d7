"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto the principal axes of all of them (a d x d matrix of sums, whose size
doesn't depend on the rows). A comparison adds up the leading axes first; what the other axes can add is at most the
product of the norms of the two rests, so that pairs whose bound stays below the threshold are dropped after LEAD axes,
the others after twice as many, and so on; only what is left is computed in double precision from the vectors as given.
The norm of the rest is carried as one more coordinate, so that one matrix product of two tiles gives all their bounds.

Tiles are files of at most TILE vectors in the shared folder, cut along the first axis, with the range of each leading
axis. Each job takes a tile and half of the others, so that every pair of tiles meets once and all jobs have as many;
those too far apart are left out by one comparison of the ranges. It returns, for each vector with a link, the number of
its links and one edge of a spanning forest of what it found, so that a large group of near copies gives rows in
proportion to its vectors, not to their pairs. Equal vectors are one vector with a count.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, links with nothing; so do
vectors of different lengths with each other (each length is a comparison of its own). Vectors are scaled by their largest
component first, so that very small and very large ones have the direction that they are given with. Repeated rows are vectors of their own, with links to each other. A null
vec_id is kept and is a component_id only where no member has an id. Only vec_id and embedding are read; an empty table
gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialise, shared_dir, ship, store, write_bytes
from .components import components

THRESHOLD = 0.95
TILE = 2048
LEAD = 16
#: Jobs at least, and rows of links that a job adds up at once.
JOBS = 64
HELD = 1 << 20
#: What rounding in single precision can take from a bound.
SLACK = 1e-3


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _stack(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def axes(vectors: DataFrame, d: int) -> np.ndarray:
    """The principal axes of vectors of length d, as columns, the leading one first."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                u = unit(_stack(batch.column(0).slice(a, 4096)))
                total += u.T @ u
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    def add(batches):
        total = np.zeros(d * d)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    sums = vectors.select("embedding").mapInArrow(run, "s binary")  # one matrix a task, added up in a tree
    for width in (64, 8):
        sums = sums.repartition(width).mapInArrow(add, "s binary")
    total = sum(np.frombuffer(r["s"], dtype=np.float64) for r in sums.collect())  # 8 rows
    values, columns = np.linalg.eigh(total.reshape(d, d))
    return columns[:, np.argsort(-values)]


def bounds(rotated: np.ndarray, lead: int) -> np.ndarray:
    """The first `lead` coordinates and the norm of the others: inner products of such rows bound those of the whole."""
    rest = np.sqrt(np.maximum(0.0, (rotated[:, lead:] ** 2).sum(1, keepdims=True)))
    return np.concatenate([rotated[:, :lead], rest], axis=1).astype(np.float32)


def write_tiles(vectors: DataFrame, turn: np.ndarray, folder: str, size: int = TILE) -> DataFrame:
    """(rid, n, embedding) -> manifest (name, n, low, high); each task sees a range of the first axis."""
    import pyarrow as pa

    shared = vectors.sparkSession.sparkContext.broadcast(turn)

    def placed(batches):
        for batch in batches:
            parts = [unit(_stack(batch.column(2).slice(a, 4096))) @ shared.value[:, 0] for a in range(0, batch.num_rows, 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, "at"])

    def run(batches):
        parts = []
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _stack(batch.column(2))))
            while sum(len(p[0]) for p in parts) >= size:
                parts = yield from flush(parts)
        while parts and len(parts[0][0]):
            parts = yield from flush(parts)

    def flush(parts):
        from pyspark import TaskContext

        rid, n, x = (np.concatenate(c) for c in zip(*parts))
        y = unit(x[:size]) @ shared.value
        name = f"{TaskContext.get().partitionId():06d}-{int(rid[0])}"
        out = io.BytesIO()
        np.savez(out, rid=rid[:size], n=n[:size], x=x[:size], y=y.astype(np.float32))
        write_bytes(f"{folder}/{name}", [out.getvalue()])
        lead = y[:, :LEAD]
        yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([len(y)], pa.int64()), "low": [lead.min(0).tolist()], "high": [lead.max(0).tolist()]})
        return [(rid[size:], n[size:], x[size:])]

    rows = vectors.mapInArrow(placed, T.StructType([*vectors.schema, T.StructField("at", T.DoubleType())]))
    tasks = max(1, -(-vectors.count() // size))
    ranged = rows.repartitionByRange(min(tasks, 10_000), "at").sortWithinPartitions("at").select("rid", "n", "embedding")
    return materialise(ranged.mapInArrow(run, "name string, n bigint, low array<double>, high array<double>"), "tiles")


def compare(a, b, same: bool, threshold: float):
    """(rows of a, rows of b) of the pairs at or above the threshold; of a tile with itself each pair once."""
    d = a["y"].shape[1]
    lead = min(LEAD, d)
    upper = bounds(a["y"], lead) @ bounds(b["y"], lead).T
    i, j = np.nonzero(upper >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    while lead < d and len(i):  # more axes, for the pairs that are left
        lead = min(2 * lead, d)
        p, q = bounds(a["y"], lead), bounds(b["y"], lead)
        near = np.concatenate([np.einsum("ij,ij->i", p[i[s : s + 65536]], q[j[s : s + 65536]]) >= threshold - SLACK for s in range(0, len(i), 65536)])
        i, j = i[near], j[near]
    exact = [np.einsum("ij,ij->i", a["u"][i[s : s + 65536]], b["u"][j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]
    keep = np.concatenate(exact) if exact else np.zeros(0, dtype=bool)
    return i[keep], j[keep]


def joined(n: np.ndarray, most: int) -> list[int]:
    """Where tiles begin: files that follow each other are one tile of at most `most` vectors, so that tiles are as large
    however many tasks wrote them. Every job joins them alike."""
    begins, size = [], most + 1
    for k, here in enumerate(n.tolist()):
        if size + here > most:
            begins.append(k)
            size = 0
        size += here
    return begins


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component, of n vertices with the edges (x, y): roots are hooked to lesser ones
    and paths cut short, until no edge joins two roots."""
    label = np.arange(n)
    while len(x):
        a, b = label[x], label[y]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return label


def summed(rid: np.ndarray, links: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each rid once, with the sum of its links and the least rid that its edges (rid, root) lead to. Roots are among rids."""
    ids, at = np.unique(rid, return_inverse=True)
    label = spanning(len(ids), at, np.searchsorted(ids, root))
    return ids, np.bincount(at, weights=links, minlength=len(ids)).astype(np.int64), ids[label]


def link(manifest: DataFrame, folder: str, threshold: float, size: int = TILE) -> DataFrame:
    """(rid, links, root): links of a vector found by one job, counting copies, and an edge to its root there."""
    import pyarrow as pa

    spark = manifest.sparkSession
    most = max(1, -(-(manifest.agg(F.sum("n")).first()[0] or 0) // size))
    shares = -(-JOBS // most)  # of a tile's partners, where there are few tiles
    jobs = 2 * most * shares  # joined tiles are more than half full on average; a job beyond the last tile has nothing to do
    files_of = manifest.inputFiles()  # of the manifest itself: a row per tile file

    def tile(names: list[str]):
        parts = []
        for name in names:
            files, path = store(f"{folder}/{name}")
            with files.open_input_file(path) as f:
                parts.append(dict(np.load(io.BytesIO(f.read()))))
        got = {k: np.concatenate([p[k] for p in parts]) for k in ("rid", "n", "y", "x")}
        return got | {"u": unit(got.pop("x"))}

    def tiles():
        """(names of each tile's files, least and greatest coordinates)"""
        import pyarrow.parquet as pq

        parts = []
        for uri in files_of:
            files, path = store(uri)
            with files.open_input_file(path) as f:
                parts.append(pq.read_table(f))
        table = pa.concat_tables(parts).sort_by("name").combine_chunks()
        names, n = table["name"].to_pylist(), table["n"].to_numpy()
        low, high = (np.concatenate([c.flatten().to_numpy() for c in table[k].chunks]).reshape(len(n), -1) for k in ("low", "high"))
        begins = joined(n, size)
        ends = [*begins[1:], len(n)]
        return [names[a:b] for a, b in zip(begins, ends)], np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)

    def run(batches):
        names = None
        for batch in batches:
            for job in batch.column(0).to_pylist():
                if names is None:
                    names, low, high = tiles()
                j, share = divmod(job, shares)
                count = len(names)
                if j >= count:
                    continue
                # of an even number of tiles, those opposite each other meet at the lesser one only
                steps = np.arange(share, count // 2 + 1, shares)
                steps = steps[(steps * 2 < count) | (j < count // 2)]
                i = (j + steps) % count
                apart = np.maximum(0.0, np.maximum(low[j] - high[i], low[i] - high[j]))
                i = i[(apart**2).sum(1) <= 2 - 2 * threshold + SLACK]  # squared distance of two linked unit vectors, at most
                a, found, held = tile(names[j]) if len(i) else None, [], 0
                for k in i.tolist():
                    b = a if k == j else tile(names[k])
                    at, to = compare(a, b, k == j, threshold)
                    if not len(at):
                        continue
                    if k == j:
                        rid = a["rid"]
                        sums = np.bincount(at, weights=a["n"][to], minlength=len(rid)) + np.bincount(to, weights=a["n"][at], minlength=len(rid))
                    else:
                        rid = np.concatenate([a["rid"], b["rid"]])
                        sums = np.concatenate([np.bincount(at, weights=b["n"][to], minlength=len(a["rid"])), np.bincount(to, weights=a["n"][at], minlength=len(b["rid"]))])
                        to = to + len(a["rid"])
                    label, some = spanning(len(rid), at, to), np.flatnonzero(sums)
                    found.append((rid[some], sums[some], rid[label[some]]))
                    held += len(some)
                    if held > HELD:
                        found = [summed(*map(np.concatenate, zip(*found)))]
                        held = 0
                if found:
                    rid, links, root = summed(*map(np.concatenate, zip(*found)))
                    yield pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    return spark.range(0, jobs, 1, min(jobs, 10_000)).mapInArrow(run, "rid bigint, links bigint, root bigint")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile_size: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship(rows.sparkSession)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    every = materialise(rows.select("vec_id", "embedding").withColumn("good", F.coalesce(good, F.lit(False))).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    distinct = every.filter("good").groupBy("embedding").agg(F.min("rid").alias("rid"), F.count("*").alias("n"))
    distinct = materialise(distinct.withColumn("d", F.size("embedding")), "vectors-distinct")
    found = None
    for r in distinct.select("d").distinct().orderBy("d").collect():  # one row per length of vectors
        mine = distinct.filter(F.col("d") == r["d"]).select("rid", "n", "embedding")
        folder = shared_dir(rows.sparkSession, "tile-files")
        manifest = write_tiles(mine, axes(mine, r["d"]), folder, tile_size)
        got = materialise(link(manifest, folder, threshold, tile_size), "vector-links")
        found = got if found is None else found.union(got)
    own = every.filter("good").join(distinct.select(F.col("embedding").alias("_e"), F.col("rid").alias("rep"), "n"), F.col("embedding") == F.col("_e")).select("vec_id", "rep", "n")
    alone = every.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        return alone.withColumn("kept", F.lit(True))
    linked = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")), "vector-cc")
    counted = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = distinct.select("rid").join(counted, "rid", "left").join(linked.withColumnRenamed("node", "rid"), "rid", "left")
    classes = classes.select(F.col("rid").alias("rep"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rid").alias("c"))
    own = own.join(classes, "rep")
    least = own.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    own = own.join(least, "c").select("vec_id", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    return own.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
f AS (SELECT r, x, list_max(list_transform(x, lambda c: abs(c))) AS top FROM v
      WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
g AS (SELECT r, list_transform(x, lambda c: c / top) AS x, len(x) AS d, sqrt(list_sum(list_transform(x, lambda c: (c / top) * (c / top)))) AS size FROM f),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND a.d = b.d AND list_dot_product(a.x, b.x) / (a.size * b.size) >= {THRESHOLD}),
w(a, b) AS (SELECT r, r FROM v UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT w.a, min(v.vec_id) AS component_id FROM w JOIN v ON v.r = w.b GROUP BY w.a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""
