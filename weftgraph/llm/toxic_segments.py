"""Toxicity by maximum-scoring segments over token log-odds.

Tokens get the log-odds of their rates in toxic and other labelled documents, smoothed by a Dirichlet prior that follows
the rates of all; only those whose z-score is at least Z count, the others score 0. Every token then pays OFFSET, so that
benign text drifts down and a segment that scores above zero stands out. A linear scan finds all maximal scoring
segments. Evidence counts once per context: a toxic word is telling only if the pairs of its neighbours are, so that
copies of one passage don't make its words telling. Words never seen may score by a prefix that several telling words
share and that other documents hardly have.

Calibration: lambda solves sum(p * exp(lambda * s)) = 1 over benign rates, as for the extreme values of segment scores.
The threshold u divides the best scores of the labelled documents best, and benign segments at or above u have a rate K
per token. A segment scoring S >= u in a text of n tokens has E = K * n * exp(-lambda * (S - u)) expected equals; the
significant segments of a text add up as S = u + sum(S_i - u), and its score is (1 + exp(-E)) / 2. Below u it is
S / (2 u).

The tables come from at most SAMPLE labelled documents, chosen by hash, and hold only telling words; this bounds what is
collected and broadcast.

Defined results: a null or empty text, or one without words, has no passages and score 0; a very long text is scanned as a
whole, in linear time; without toxic or without other labels, every score is 0. Repeated passages each count. Of thresholds
that divide the labelled documents alike that with the widest gap is taken; a segment exactly at it is significant. An empty
table gives an empty result. Rows are independent; further columns are ignored by `score` and
kept by `annotate`, unless they have a result's name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import is_held_out, sample
from ._shared import arrow_columns, materialise, ship

SAMPLE = 20_000
#: Weight of the Dirichlet prior that follows the common rates, and its least count for any word.
PRIOR, LEAST_PRIOR = 500.0, 0.5
Z = 3.3
LEAST_COUNT = 3
OFFSET = 0.35
#: Bytes of a prefix, the longest first, and how many telling words must share it.
PREFIXES = (8, 7, 6, 5, 4)
PREFIX_WORDS = 4
#: Bytes of words; A-Z become lower, other ASCII characters spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass.

    Candidates are kept with the cumulated score before and at their end. A new run of positive scores is joined with the
    last candidate whose left sum is lower, if that one's right sum is lower too; else it becomes a candidate. What lies
    between positive scores is known from cumulated sums, so only positive tokens cost a step.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, left, right, place of the last candidate with a lower left sum
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= left:
                at = found[at][4]
            if at < 0 or found[at][3] >= right:
                found.append([start, end, left, right, at])
                break
            start, left = found[at][0], found[at][2]
            del found[at:]
            at -= 1
    return [(a, b, r - l) for a, b, l, r, _ in found]


class Scorer:
    def __init__(self, model: dict):
        self.words, self.prefixes, self.u, self.decay, self.rate = (model[k] for k in ("words", "prefixes", "u", "lambda", "K"))
        self.stems = {p[: PREFIXES[-1]] for p in self.prefixes}

    def token_scores(self, words: list[bytes]) -> np.ndarray:
        known, shortest = self.words, PREFIXES[-1]
        if self.stems:
            return np.array([known[w] if w in known else self.by_prefix(w) if w[:shortest] in self.stems else 0.0 for w in words]) - OFFSET
        return np.array([known.get(w, 0.0) for w in words]) - OFFSET

    def by_prefix(self, word: bytes) -> float:
        return next((self.prefixes[word[:k]] for k in PREFIXES if len(word) > k and word[:k] in self.prefixes), 0.0)

    def best(self, text: str | None) -> tuple[int, float]:
        """(number of tokens, score of the best segment)"""
        words = tokens(text)
        return len(words), max((s for *_, s in segments(self.token_scores(words))), default=0.0)

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, significant segments as word ranges with their scores)"""
        words = tokens(text)
        if not words or not self.words:
            return 0.0, []
        all_found = segments(self.token_scores(words))
        top = [x for x in all_found if x[2] >= self.u]
        if not top:
            return min(0.499, max((s for *_, s in all_found), default=0.0) / (2 * self.u)), []
        expected = self.rate * len(words) * np.exp(-self.decay * sum(s - self.u for *_, s in top))
        return float(0.5 + 0.5 * np.exp(-expected)), top


def log_odds(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z-scores) of counts in both kinds, of n1 and n0 tokens, with a Dirichlet prior of weight `prior` in
    proportion to the common rates and LEAST_PRIOR for each word."""
    a = LEAST_PRIOR + prior * (toxic + other) / (n1 + n0)
    rest = np.maximum(n1 + prior - toxic - a, 1), np.maximum(n0 + prior - other - a, 1)
    delta = np.log((toxic + a) / rest[0]) - np.log((other + a) / rest[1])
    return delta, delta / np.sqrt(1 / (toxic + a) + 1 / (other + a))


def counted(rows: DataFrame) -> DataFrame:
    """(text, y) -> (w, c1, c0): counts of each word in both kinds, added up in each task before the shuffle."""
    import pyarrow as pa

    ship(rows.sparkSession)

    def run(batches):
        kinds = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                kinds[int(y > 0)].update(tokens(text.as_py()))
        words = list(kinds[0].keys() | kinds[1].keys())
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            yield pa.RecordBatch.from_pydict({"w": pa.array(part, pa.binary()), "c1": pa.array([kinds[1][w] for w in part], pa.int64()), "c0": pa.array([kinds[0][w] for w in part], pa.int64())})

    return rows.select("text", "y").mapInArrow(run, "w binary, c1 bigint, c0 bigint").groupBy("w").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def contexts(rows: DataFrame, words: set[bytes]) -> dict[bytes, list[int]]:
    """word -> in how many different pairs of neighbours it stands in [toxic, other] documents, for the given words."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        found = set()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                ws = [b"", *tokens(text.as_py()), b""]
                found.update((w, int(y > 0), ws[i] + b" " + ws[i + 2]) for i, w in enumerate(ws[1:-1]) if w in shared.value)
        for a in range(0, len(found), 50_000):
            w, y, c = zip(*list(found)[a : a + 50_000])
            yield pa.RecordBatch.from_pydict({"w": pa.array(w, pa.binary()), "y": pa.array(y, pa.int32()), "c": pa.array(c, pa.binary())})

    made = rows.select("text", "y").mapInArrow(run, "w binary, y int, c binary").distinct().groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    return {bytes(r["w"]): [r["a"], r["b"]] for r in made.collect()}


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_by: int = 5, held: int = 0, most: int = SAMPLE) -> dict:
    rows = sample(docs, labels, label, held_by, held, most).filter("text IS NOT NULL")
    rows = materialise(rows.groupBy("text").agg(F.max("y").alias("y")), "toxic-sample")  # copies teach once
    every = materialise(counted(rows), "toxic-counts")
    n1, n0 = (float(x or 0) for x in every.agg(F.sum("c1"), F.sum("c0")).first())
    model = {"words": {}, "prefixes": {}, "u": 1.0, "lambda": 1.0, "K": 0.0}
    if not n1 or not n0:
        return model
    counts = every.filter(F.col("c1") + F.col("c0") >= LEAST_COUNT).collect()  # bounded by the sample
    words = [bytes(r["w"]) for r in counts]
    c1, c0 = (np.array([r[k] for r in counts], dtype=float) for k in ("c1", "c0"))
    delta, z = log_odds(c1, c0, n1, n0)
    seen = contexts(rows, {w for w, x in zip(words, z) if x >= Z})
    for at, w in enumerate(words):
        if w in seen:
            d, x = log_odds(*(np.array([float(v)]) for v in seen[w]), n1, n0)
            delta[at], z[at] = d[0], x[0]
    telling = np.abs(z) >= Z
    model["words"] = {w: float(d) for w, d, t in zip(words, delta, telling) if t}
    model["prefixes"] = _prefixes(every, [w for w, d in model["words"].items() if d > 0], n1, n0)
    s = np.where(telling, delta, 0.0) - OFFSET
    p = (c0 + PRIOR * (c1 + c0) / (n1 + n0)) / (n0 + PRIOR)
    low, high = 0.0, 50.0 / max(1.0, float(s.max(initial=1.0)))
    rest = max(0.0, 1.0 - p.sum())  # rare words score as common ones that tell nothing
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() + rest * np.exp(-mid * OFFSET) < 1 else (low, mid)
    return model | _threshold(_best(rows, model), high)


def _prefixes(every: DataFrame, words: list[bytes], n1: float, n0: float) -> dict[bytes, float]:
    """Prefixes of PREFIX_WORDS telling toxic words or more, whose words, rare ones included, are toxic as a whole."""
    shared = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
    wanted = sorted(p for p, n in shared.items() if n >= PREFIX_WORDS)
    out: dict[bytes, float] = {}
    for k in PREFIXES if wanted else ():
        p = F.substring("w", 1, k)
        mine = [x for x in wanted if len(x) == k]
        if mine:
            for r in every.filter((F.length("w") > k) & p.isin(mine)).groupBy(p.alias("p")).agg(F.sum("c1").alias("a"), F.sum("c0").alias("b")).collect():
                d, z = log_odds(np.array([float(r["a"])]), np.array([float(r["b"])]), n1, n0)
                if z[0] >= Z and r["b"] <= 0.02 * r["a"]:
                    out[bytes(r["p"])] = 0.8 * float(d[0])
    return out


def _best(rows: DataFrame, model: dict) -> list:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def start():
        import pyarrow as pa

        scorer = Scorer(shared.value)

        def each(texts):
            n, s = zip(*[scorer.best(t.as_py()) for t in texts]) if len(texts) else ((), ())
            return [pa.array(n, pa.int64()), pa.array(s, pa.float64())]

        return each

    return arrow_columns(rows, "text", [("n", T.LongType()), ("s", T.DoubleType())], start, without=("text",)).select("n", "s", "y").collect()


def _threshold(best: list, decay: float) -> dict:
    n, s, y = (np.array([r[k] for r in best], dtype=float) for k in ("n", "s", "y"))
    order = np.argsort(s)
    s, y, n = s[order], y[order], n[order]
    # wrong if the cut is before place k: toxic ones below and others above; both kinds weigh as they are
    wrong = np.concatenate([[0], np.cumsum(y)]) + (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    places = [k for k in range(1, len(s)) if s[k] > s[k - 1]] or [len(s) - 1]
    k = min(places, key=lambda k: (wrong[k], -s[k] + s[k - 1]))
    u = max(1e-3, float(s[k - 1] + 0.5 * (s[k] - s[k - 1])))
    above = float(((s >= u) & (y == 0)).sum())
    return {"u": u, "K": (above + 0.5) / max(1.0, float(n[y == 0].sum())), "lambda": decay}


def annotate(df: DataFrame, model: dict, without: tuple = ()) -> DataFrame:
    """df, less the columns of `without`, with score, predicted and passages (word ranges and scores of the significant segments)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    passage = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("score", T.DoubleType())]))

    def start():
        import pyarrow as pa

        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64())]))

        def each(texts):
            found = [scorer(t.as_py()) for t in texts]
            spans = [[{"first_word": a, "end_word": b, "score": s} for a, b, s in x] for _, x in found]
            return [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array(spans, kind)]

        return each

    return arrow_columns(df, "text", [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("passages", passage)], start, without=without)


def score(docs: DataFrame, labels: DataFrame, held_by: int = 5, held: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages."""
    found = annotate(docs.select("doc_id", "text"), learn(docs, labels, "toxic", held_by, held), ("text",))
    return found.select("doc_id", is_held_out(F.col("doc_id"), held_by, held).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
