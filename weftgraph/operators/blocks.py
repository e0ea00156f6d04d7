"""Polynomials of a graph's Laplacian times columns of numbers, in blocks of nodes that are files of the shared folder.

Nodes are dealt into parts by a hash of their ids and numbered in each by that hash, so that edges find their numbers without a
join. A tile has the pairs of two parts, each pair once, as numbers of four bytes. A round is a task for each part: it reads the
tiles of its part and the columns of all parts, one after the other, and writes the part's new columns. No edge is moved after
the tiles are made, and a task holds the columns of two parts and NUMBERS numbers, whatever the size of the graph.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import few_shuffle_files, local_path, materialise, shared_base

#: Most nodes of a part, and least ones for which another part is made.
MOST_NODES, LEAST_NODES = 1_000_000, 20_000
#: Pairs that are written or read at once; numbers that are gathered before they are added up.
PAIRS, NUMBERS = 1_000_000, 16_000_000


def _write(path: str, *arrays: np.ndarray) -> None:
    """A reader sees the whole file or none, however often a task is tried."""
    made = f"{path}.{uuid.uuid4().hex[:8]}"
    with open(made, "wb") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)
    os.replace(made, path)


def _read(path: str, kind: type = np.float64) -> np.ndarray | None:
    return np.fromfile(path, dtype=kind) if os.path.exists(path) else None


def _hashes(folder: str, part: int) -> np.ndarray:
    found = _read(f"{folder}/nodes.{part}", np.int64)
    return np.empty(0, np.int64) if found is None else found


def _size(folder: str, part: int) -> int:
    path = f"{folder}/nodes.{part}"
    return os.path.getsize(path) // 8 if os.path.exists(path) else 0


def _places(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each in the sorted ones, whether it is there)."""
    if not len(sorted_hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == wanted


def _runs(batches: Iterator[pa.RecordBatch], most: int = PAIRS) -> Iterator[tuple[int, bool, list[np.ndarray]]]:
    """(key, whether it is the key's last, columns) of rows sorted by their first column, at most about `most` rows at once."""
    key, held, rows = None, [], 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held)]

    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and (columns[0][i] != key or rows >= most):
                yield key, columns[0][i] != key, joined()
                held, rows = [], 0
            key = int(columns[0][i])
            held.append([c[i:j] for c in columns[1:]])
            rows += j - i
    if held:
        yield key, True, joined()


def _number(nodes: DataFrame, folder: str, parts: int, seed: int) -> bool:
    """Writes the sorted hashes of each part; False if two nodes have the same one."""
    one = nodes.filter("node_id IS NOT NULL").groupBy(F.xxhash64(F.lit(seed), "node_id").alias("h")).agg((F.min("node_id") != F.max("node_id")).alias("clash"))
    dealt = one.select(F.pmod("h", F.lit(parts)).cast("int").alias("part"), "h", "clash").repartition("part").sortWithinPartitions("part", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, (h, clash) in _runs(batches, 1 << 62):
            _write(f"{folder}/nodes.{part}", h)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "clash": [bool(clash.any())]})

    return not any(r["clash"] for r in dealt.mapInArrow(run, "part int, clash boolean").collect())


def _tile(edges: DataFrame, folder: str, parts: int, seed: int) -> None:
    """Writes the pairs of different nodes that edges(src, dst[, weight]) join, each once with its greatest weight."""
    weighted = "weight" in edges.columns
    h = lambda c: F.xxhash64(F.lit(seed), c)
    x = edges.filter("src <> dst").select(h("src").alias("a"), h("dst").alias("b"), *([F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w")] if weighted else []))
    p, q = (F.pmod(c, F.lit(parts)) for c in ("a", "b"))
    first = (p < q) | ((p == q) & (F.col("a") < F.col("b")))
    swapped = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    tile = F.least(p, q) * parts + F.greatest(p, q)
    order = ["tile", "u", "v", *([F.desc("w")] if weighted else [])]
    dealt = x.select(tile.alias("tile"), swapped("a", "b").alias("u"), swapped("b", "a").alias("v"), *(["w"] if weighted else [])).repartition("tile").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, made, before, us, vs = None, "", (None, None), None, None
        for tile, last, (u, v, *w) in _runs(batches):
            if out is None:
                made, before = f"{folder}/tile.{tile}.{uuid.uuid4().hex[:8]}", (None, None)
                out, us, vs = open(made, "wb"), _hashes(folder, tile // parts), _hashes(folder, tile % parts)
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            new[0] = (u[0], v[0]) != before
            before = (u[-1], v[-1])
            (i, there), (j, too) = _places(us, u), _places(vs, v)
            kept = new & there & too
            for a in (np.array([kept.sum()], np.int64), i[kept].astype(np.int32), j[kept].astype(np.int32), *[c[kept] for c in w]):
                out.write(a.tobytes())
            if last:
                out.close()
                os.replace(made, f"{folder}/tile.{tile}")
                out = None
                yield pa.RecordBatch.from_pydict({"tile": pa.array([tile], pa.int64())})

    dealt.mapInArrow(run, "tile long").count()


def _pairs(folder: str, parts: int, p: int, q: int, weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    path = f"{folder}/tile.{p * parts + q}"
    if os.path.exists(path):
        with open(path, "rb") as f:
            while len(n := np.fromfile(f, np.int64, 1)):
                yield np.fromfile(f, np.int32, n[0]), np.fromfile(f, np.int32, n[0]), np.fromfile(f, np.float64, n[0]) if weighted else None


def _product(folder: str, part: int, parts: int, weighted: bool, columns: int, of: Callable[[int], np.ndarray | None]) -> np.ndarray:
    """The adjacency's rows of a part times `columns` columns; of(part) are those of a part's nodes, None if all are zero."""
    n, room = _size(folder, part), max(NUMBERS // columns, 1)
    out, to, got, at = np.zeros((columns, n)), np.empty(room, np.intp), np.empty((columns, room)), 0

    def add() -> None:
        for i in range(columns if at else 0):
            out[i] += np.bincount(to[:at], got[i, :at], n)

    for q in range(parts):
        x = None
        for u, v, w in _pairs(folder, parts, min(part, q), max(part, q), weighted):
            if x is None and (x := of(q)) is None:
                break
            for rows, cols in ((u, v), (v, u))[part > q : 1 + (part >= q)]:
                for a in range(0, len(rows), room):
                    m = len(rows[a : a + room])
                    if at + m > room:
                        add()
                        at = 0
                    to[at : at + m], s = rows[a : a + room], cols[a : a + room].astype(np.intp)
                    for i in range(columns):
                        np.take(x[i], s, out=got[i, at : at + m], mode="clip")
                    if w is not None:
                        got[:, at : at + m] *= w[a : a + room]
                    at += m
    add()
    return out


def _each(spark: SparkSession, parts: int, run: Callable[[int], dict], schema: str) -> DataFrame:
    """run(part) of every part, in a task each."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["id"]:
                yield pd.DataFrame(run(int(part)))

    return spark.range(0, parts, 1, parts).mapInPandas(task, schema)


class Blocks:
    """The pairs of edges(src, dst[, weight]) between nodes(node_id), and columns of their nodes."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, parts: int | None = None):
        self.spark, self.weighted, self.seed = nodes.sparkSession, "weight" in edges.columns, 0
        tasks, n = self.spark.sparkContext.defaultParallelism, nodes.count()
        # as many as tasks run at once, or a multiple
        self.parts = parts or (-(-n // (MOST_NODES * tasks)) * tasks if n > LEAST_NODES * tasks else max(1, n // LEAST_NODES))
        self.nodes = nodes.select("node_id")
        self.folder = f"{local_path(shared_base(self.spark))}/weft-blocks-{uuid.uuid4().hex[:12]}"
        os.makedirs(self.folder)
        with few_shuffle_files(self.spark):
            while not _number(self.nodes, self.folder, self.parts, self.seed):
                self.seed += 1
            _tile(edges, self.folder, self.parts, self.seed)
        folder, count, weighted = self.folder, self.parts, self.weighted

        def degree(part: int) -> dict:
            _write(f"{folder}/degree.{part}", _product(folder, part, count, weighted, 1, lambda q: np.ones((1, _size(folder, q))))[0])
            return {"part": [part]}

        def top(part: int) -> dict:
            d, most = _read(f"{folder}/degree.{part}"), 0.0
            for q in range(part, count):
                e = None
                for u, v, _ in _pairs(folder, count, part, q, weighted):
                    e = _read(f"{folder}/degree.{q}") if e is None else e
                    most = max(most, float((d[u] + e[v]).max(initial=0.0)))
            return {"top": [most]}

        self._run(degree, "part long")
        #: The greatest sum of two neighbours' degrees.
        self.top = max((r["top"] for r in self._run(top, "top double")), default=0.0)

    def _run(self, run: Callable[[int], dict], schema: str) -> list:
        return _each(self.spark, self.parts, run, schema).collect()

    def _start(self, start: DataFrame, columns: int) -> None:
        """Writes term 0, the number of rows of start(node_id, signal) of each node and signal, and the nodes that have some."""
        folder, parts = self.folder, self.parts
        x = start.select(F.xxhash64(F.lit(self.seed), "node_id").alias("h"), F.col("signal").cast("long").alias("signal"))
        dealt = x.select(F.pmod("h", F.lit(parts)).cast("int").alias("part"), "h", "signal").repartition("part").sortWithinPartitions("part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for part, last, (h, signal) in _runs(batches):
                own = _hashes(folder, part)
                total = np.zeros((columns, len(own))) if total is None else total
                at, there = _places(own, h)
                np.add.at(total, (signal[there], at[there]), 1.0)
                if last:
                    _write(f"{folder}/term.0.{part}", total)
                    _write(f"{folder}/held.{part}", np.flatnonzero(total.any(axis=0)).astype(np.int64))
                    total = None
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

        dealt.mapInArrow(run, "part int").count()

    def filtered(self, start: DataFrame, columns: int, terms: list[list[float]], top: float) -> Callable[[Callable], DataFrame]:
        """For each of `terms`, coefficients by Chebyshev polynomials of the Laplacian moved from [0, top], the sums of
        start(node_id, signal): files of (sums, columns, nodes) for each part. T_k = 2 L T_(k-1) - T_(k-2), the first without the 2.
        Terms are added to the sums and removed as they come."""
        folder, parts, weighted, order = self.folder, self.parts, self.weighted, len(terms[0]) - 1
        self._start(start, columns)

        def term(k: int, part: int) -> np.ndarray | None:
            x = _read(f"{folder}/term.{k}.{part}")
            return None if x is None else x.reshape(columns, _size(folder, part))

        def step(part: int, k: int, fold: list[int], before: int) -> dict:
            """Writes term k and the sums with the terms `fold`, and removes what no task needs any more. What is there was written
            by an earlier try of the task."""
            n, new = _size(folder, part), term(k, part)
            if k and new is None:
                last = term(k - 1, part)
                new = _product(folder, part, parts, weighted, columns, lambda q: term(k - 1, q)) * (-2 / top)
                if last is not None:
                    new += (2 / top * _read(f"{folder}/degree.{part}") - 1) * last
                new *= 2.0 if k > 1 else 1.0
                if k > 1 and (x := term(k - 2, part)) is not None:
                    new -= x
                _write(f"{folder}/term.{k}.{part}", new)
            done, old = f"{folder}/sums.{k}.{part}", f"{folder}/sums.{before}.{part}"
            if fold and not os.path.exists(done):
                made = f"{done}.{uuid.uuid4().hex[:8]}"
                with open(made, "wb") as f:
                    for d, c in enumerate(terms):
                        y = np.fromfile(old, count=columns * n, offset=8 * d * columns * n).reshape(columns, n) if before >= 0 else np.zeros((columns, n))
                        for j in fold:
                            if (x := new if j == k else term(j, part)) is not None:
                                y += c[j] * x
                        f.write(y.data)
                os.replace(made, done)
            for path in ([old] if fold else []) + [f"{folder}/term.{k - 2}.{part}"]:
                if os.path.exists(path):
                    os.remove(path)
            return {"part": [part]}

        before = -1
        for k in range(order + 1):  # two terms are added at once, as the last two are kept anyway
            fold = [k - 1, k] if k % 2 else [k] if k == order else []
            self._run(lambda part, k=k, fold=fold, before=before: step(part, k, fold, before), "part long")
            before = k if fold else before

        def squares(part: int) -> dict:
            y = _read(f"{folder}/sums.{order}.{part}")
            return {"part": [part], "s": [np.zeros(len(terms) * columns) if y is None or not len(y) else (y.reshape(len(terms) * columns, -1) ** 2).sum(axis=1)]}

        #: The length of each sum and column.
        self.lengths = np.sqrt(sum(np.array(r["s"]) for r in sorted(self._run(squares, "part long, s array<double>")))).reshape(len(terms), columns)

        def rows(of: Callable[[np.ndarray, int, int], np.ndarray], least: float) -> DataFrame:
            """(node_id, sum, signal, z) of nodes that start has not, with z = of(sums, sum, signal) above `least`."""

            def run(part: int) -> dict:
                h, held, found = _hashes(folder, part), _read(f"{folder}/held.{part}", np.int64), []
                for d in range(len(terms)):
                    y = np.fromfile(f"{folder}/sums.{order}.{part}", count=columns * len(h), offset=8 * d * columns * len(h)).reshape(columns, len(h))
                    for i in range(columns):
                        z = of(y[i], d, i)
                        if held is not None:
                            z[held] = -np.inf
                        at = np.flatnonzero(z > least)
                        found.append(pd.DataFrame({"h": h[at], "sum": np.int32(d), "signal": np.int32(i), "z": z[at]}))
                return pd.concat(found)

            found = materialise(_each(self.spark, parts, run, "h long, sum int, signal int, z double"))
            ids = self.nodes.filter("node_id IS NOT NULL").withColumn("h", F.xxhash64(F.lit(self.seed), "node_id"))
            return materialise(ids.join(found, "h").select("node_id", "sum", "signal", "z").distinct())

        return rows

    def remove(self) -> None:
        """Takes the files away; what filtered() has returned stays."""
        shutil.rmtree(self.folder, ignore_errors=True)
