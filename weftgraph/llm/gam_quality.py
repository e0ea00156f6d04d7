"""A quality classifier: a generalised additive model with pairwise interactions, as lookup tables.

Each feature is cut into bins. Shallow trees are boosted one feature after another in cycles, each fitted to what all
others leave; a feature's trees add up to one table over its bins. Then the pairs of features that explain most of the
rest are boosted in the same way on two-way tables. A score is the sigmoid of an intercept and one table entry for each
feature and pair, added for a whole batch at once.

It is fitted on the driver from at most SAMPLE labelled documents, chosen by hash; this bounds what the driver holds, and
the tables' size doesn't depend on the data.

Defined results: a null or empty text has all features 0 and a score like any other; a very long text is read as a whole, its
longest word counts as 100 bytes at most; with labels of one kind only, the score is that kind's smoothed share, without
labels 0.5; a score of exactly 0.5 is predicted 1. Of cuts that gain alike the first is taken, and values on a bin's edge are
in the upper bin. Rows are independent, equal texts score alike, and an empty table gives an empty result; further columns are ignored by `score`
and kept by `annotate`, unless they have a result's name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import is_held_out, sample
from ._shared import arrow_columns, ship

SAMPLE = 12_000
BINS = 48
COARSE = 8
CYCLES = 120
PAIR_CYCLES = 60
PAIRS = 8
RATE = 0.15
LEAST_ROWS = 10

FEATURES = [
    "log_words", "mean_word_bytes", "symbol_share", "upper_share", "digit_share", "mark_share", "beyond_ascii_share",
    "distinct_word_share", "repeated_line_share", "log_words_per_line", "top_word_share", "stop_share", "decorated_word_share", "longest_word",
]
_CLASS = np.zeros(256, dtype=np.int64)
for _chars, _c in ((b"#*$%&|<>", 1), (bytes(range(65, 91)), 2), (bytes(range(48, 58)), 3), (b"!?;:\"'()[]{}", 4), (bytes(range(128, 256)), 5), (bytes(range(97, 123)), 6), (b".,", 7)):
    _CLASS[list(_chars)] = _c


def features(text: str | None) -> list[float]:
    """The features of one text, from bytes in a few passes."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    per_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=8)
    letters = max(1.0, per_class[2] + per_class[6] + per_class[5])
    chars = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    decorated = sum(c for w, c in counts.items() if w[-1:] in b"#*$%&|<>!" or w[:1] in b"#*$%&|<>!")
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    return [
        np.log1p(n), chars / n, per_class[1] / chars, per_class[2] / letters, per_class[3] / chars, per_class[4] / chars, per_class[5] / chars,
        len(counts) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), max(counts.values()) / n, short / n, decorated / n, min(100, max(map(len, counts))),
    ]


def _splits(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of a tree of up to three leaves over ordered bins, fitted to sums of gradients and curvatures."""

    def best(a: int, b: int):
        g, h, r = np.cumsum(grad[a:b]), np.cumsum(hess[a:b]), np.cumsum(rows[a:b])
        if b - a < 2:
            return 0.0, None
        gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(r[:-1] < LEAST_ROWS) | (r[-1] - r[:-1] < LEAST_ROWS)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    cuts = [0, len(grad)]
    for _ in range(2):
        gain, cut = max((best(a, b) for a, b in zip(cuts, cuts[1:])), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, cut])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def _quarters(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts a two-way table at one place of each side: (gain, values)."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    g0, h0 = g[:-1, :-1], h[:-1, :-1]
    g1, h1 = g[:-1, -1:] - g0, h[:-1, -1:] - h0
    g2, h2 = g[-1:, :-1] - g0, h[-1:, :-1] - h0
    g3, h3 = g[-1, -1] - g0 - g1 - g2, h[-1, -1] - h0 - h1 - h2
    total = sum(a**2 / (b + 1) for a, b in ((g0, h0), (g1, h1), (g2, h2), (g3, h3)))
    i, j = np.unravel_index(np.argmax(total), total.shape)
    out = np.empty_like(grad)
    for part, a, b in (((slice(None, i + 1), slice(None, j + 1)), g0, h0), ((slice(None, i + 1), slice(j + 1, None)), g1, h1), ((slice(i + 1, None), slice(None, j + 1)), g2, h2), ((slice(i + 1, None), slice(j + 1, None)), g3, h3)):
        out[part] = a[i, j] / (b[i, j] + 1)
    return float(total[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + 1)), out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), dtype=int)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model: edges, intercept, one table per feature, and (a, b, table) per pair over coarse bins."""
    n, d = (len(x), x.shape[1]) if len(x) else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1.0)
    model = {"intercept": float(np.log(share / (1 - share))), "edges": [np.zeros(0)] * d, "coarse": [np.zeros(0)] * d, "tables": [np.zeros(1)] * d, "pairs": []}
    if n < 2 * LEAST_ROWS or y.min() == y.max():
        return model
    cut = lambda k, m: np.unique(np.quantile(x[:, k], np.linspace(0, 1, m + 1)[1:-1]))
    edges, coarse = [cut(k, BINS) for k in range(d)], [cut(k, COARSE) for k in range(d)]
    b, c = binned(x, edges), binned(x, coarse)
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(n, model["intercept"])

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for k in range(d):
            g, h = slopes()
            size = len(tables[k])
            sums = [np.bincount(b[:, k], weights=w, minlength=size) for w in (g, h, None)]
            step = RATE * _splits(*sums)
            tables[k] += step
            f += step[b[:, k]]

    def two_way(i: int, j: int):
        g, h = slopes()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = c[:, i] * shape[1] + c[:, j]
        return at, [np.bincount(at, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (g, h)]

    wide = [k for k in range(d) if len(coarse[k])]
    gains = sorted(((_quarters(*two_way(i, j)[1])[0], i, j) for i in wide for j in wide if i < j), reverse=True)[:PAIRS]
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains]
    for _ in range(PAIR_CYCLES):
        for i, j, table in pairs:
            at, sums = two_way(i, j)
            step = RATE * _quarters(*sums)[1]
            table += step
            f += step.ravel()[at]
    return model | {"edges": edges, "coarse": coarse, "tables": tables, "pairs": pairs}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of rows of features, by adding table entries."""
    b, c = binned(x, model["edges"]), binned(x, model["coarse"])
    f = np.full(len(x), model["intercept"])
    for k, t in enumerate(model["tables"]):
        f += t[b[:, k]]
    for i, j, t in model["pairs"]:
        f += t[c[:, i], c[:, j]]
    return 1 / (1 + np.exp(-f))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", held_by: int = 3, held: int = 1, most: int = SAMPLE) -> dict:
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample(docs, labels, label, held_by, held, most).select("text", "y").mapInArrow(run, "x array<double>, y int").collect()
    return fit(np.array([r["x"] for r in rows]), np.array([r["y"] > 0 for r in rows], dtype=float))


def annotate(df: DataFrame, model: dict, without: tuple = ()) -> DataFrame:
    """df, less the columns of `without`, with score (double) and predicted (int)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        import pyarrow as pa

        def each(texts):
            p = predict(shared.value, np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES)))
            return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]

        return each

    return arrow_columns(df, "text", [("score", T.DoubleType()), ("predicted", T.IntegerType())], start, without=without)


def score(docs: DataFrame, labels: DataFrame, held_by: int = 3, held: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    found = annotate(docs.select("doc_id", "text"), learn(docs, labels, "quality", held_by, held), ("text",))
    return found.select("doc_id", is_held_out(F.col("doc_id"), held_by, held).alias("held_out"), "score", "predicted")
