"""Similarity joins of names: filters that lose no pair, then an exact comparison of what is left.

Sets of words that are mostly rare go by prefixes: two sets whose overlap must be at least k share a token among the first
n - k + 1 of each, from the rarest, so only those prefixes are joined, with lengths and places that still allow the overlap.

Letters and q-grams of names made of a few syllables have no rare tokens. Such names are dealt into blocks of one length, blocks
of lengths that can be alike meet in Arrow tasks, and there a bound that is computed for a whole block at a time (common ones
among a name's rarest q-grams, or common letters) leaves few pairs. That is some nanoseconds for each pair of names, in memory
that a block bounds. Distinct names are compared once, whatever their number of rows.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import PARTS, stem
from .tables import materialise

#: Least share of matching runs, which `name_score` asks for, and least overlap of parts.
RATIO = 0.75
PART_OVERLAP = 0.6
#: Least and most names of a block, and blocks that all names are dealt into in between; names of a block that are compared at once.
LEAST_BLOCK, MOST_BLOCK, BLOCKS, AT_ONCE = 256, 32_768, 32, 256
#: How many of a name's rarest q-grams must be common before all are counted; pairs for which they are counted at once.
RARE, CELLS = 4, 300_000


def grams(text: Column, q: int) -> Column:
    """The q-grams of a text, in order; none of a shorter one."""
    n = F.length(text) - q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _ordered(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """sets(id, tokens) with the tokens from the rarest; sets without tokens are left out."""
    t = sets.select("id", F.explode("tokens").alias("token")).join(rarity, "token")
    o = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    return t.groupBy("id").agg(o.alias("tokens"))


def candidates(a: DataFrame, b: DataFrame, least: Column, needed, ordered: bool = False) -> DataFrame:
    """(x, y, u, v, overlap) of a(id, tokens) and b(id, tokens), sets without repeated tokens: pairs with at least `needed(n, m)`
    common tokens, for sets of n and m. `least` says by column n how many of a set's tokens any partner must share. With `ordered`
    only pairs with x < y. Prefixes are all that is shuffled; pairs that fail are never written out."""
    every = a.select("tokens").union(b.select("tokens"))
    rarity = every.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def prefix(sets: DataFrame, name: str, tokens: str, at: str) -> DataFrame:
        s = _ordered(sets, rarity).withColumn("n", F.size("tokens"))
        length = F.col("n") - F.greatest(least, F.lit(1)) + 1
        s = s.select(F.col("id").alias(name), F.col("tokens").alias(tokens), F.col("n").alias(f"n_{name}"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(length, F.lit(0)))).alias(at, "token"))
        return s

    p, q = prefix(a, "x", "u", "i"), prefix(b, "y", "v", "j")
    need = needed(F.col("n_x"), F.col("n_y"))
    room = F.least(F.col("n_x") - F.col("i"), F.col("n_y") - F.col("j"))
    met = p.join(q, "token").filter((F.least("n_x", "n_y") >= need) & (room >= need))
    met = met.filter("x < y") if ordered else met
    # a pair meets at each token common to both prefixes, the rarest common one among them: there it is kept, and checked in place
    common = F.array_intersect("u", "v")
    kept = met.filter((F.get(common, F.lit(0)) == F.col("token")) & (F.size(common) >= need))
    return kept.select("x", "y", "u", "v", F.size(common).alias("overlap"))


def similar_sets(a: DataFrame, b: DataFrame, threshold: float, ordered: bool = False) -> DataFrame:
    """(x, y, similarity) of a(id, tokens) and b(id, tokens): sets whose common tokens are at least `threshold` of all theirs; with
    `ordered` those with x < y only."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1")
    exact = lambda x: F.ceil(x - 1e-9)  # noqa: E731  rounding mustn't ask for one more
    found = candidates(a, b, exact(F.col("n") * threshold), lambda n, m: exact((n + m) * (threshold / (1 + threshold))), ordered)
    s = F.col("overlap") / (F.size("u") + F.size("v") - F.col("overlap"))
    return found.select("x", "y", s.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def _met(a: DataFrame, b: DataFrame, columns: list[str], least: float, compare: Callable, result: str, ordered: bool = False) -> DataFrame:
    """compare(rows of a, rows of b, whether they are the same block) -> a frame of `result`, for each two blocks of a(id, n, columns) and b, rows of
    which have one n each, the smaller of them at least `least` times the greater. With `ordered` a and b are the same, and two
    blocks meet once."""
    spark = a.sparkSession

    def blocks(df: DataFrame) -> DataFrame:
        size = min(max(df.count() // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
        share = df.groupBy("n").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))  # a row for each length
        dealt = df.join(F.broadcast(share), "n").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        return materialise(dealt.groupBy("n", "part").agg(F.collect_list(F.struct("id", *columns)).alias("rows")))

    p = blocks(a)
    q = p if ordered else blocks(b)
    first = F.col("n") if ordered else F.ceil(F.col("n") * least - 1e-9).cast("int")
    p = p.select(F.col("n").alias("n_x"), F.col("part").alias("part_x"), F.col("rows").alias("xs"), F.explode(F.sequence(first, F.floor(F.col("n") / least + 1e-9).cast("int"))).alias("n_y"))
    j = p.join(q.select(F.col("n").alias("n_y"), F.col("part").alias("part_y"), F.col("rows").alias("ys")), "n_y")
    j = j.filter("n_x < n_y OR part_x <= part_y") if ordered else j
    # a number of its own, as what is small by bytes is much work here
    dealt = j.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64), "n_x", "part_x", "n_y", "part_y")
    same = F.lit(ordered) & (F.col("n_x") == F.col("n_y")) & (F.col("part_x") == F.col("part_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, one = (batch.column(c) for c in ("xs", "ys", "same"))
            for i in range(batch.num_rows):
                yield compare(xs[i].values, ys[i].values, one[i].as_py())

    return dealt.select("xs", "ys", same.alias("same")).mapInArrow(run, result)


def _found(xs: pa.StructArray, ys: pa.StructArray, i: list[np.ndarray], j: list[np.ndarray], values: list[np.ndarray], name: str) -> pa.RecordBatch:
    """(x, y, name) of the rows i of xs and j of ys."""
    at = lambda rows, k: rows.field("id").take(pa.array(np.concatenate(k) if k else [], pa.int64()))
    return pa.RecordBatch.from_arrays([at(xs, i), at(ys, j), pa.array(np.concatenate(values) if values else [], pa.float64())], names=["x", "y", name])


def _gram_numbers(a: list[str], b: list[str], q: int) -> list[np.ndarray]:
    """The q-grams of texts, each text's once, as numbers that both lists share: a row for each text, of one length in a list."""
    size = np.array([len(t) for t in (*a, *b)])
    letter = np.frombuffer("".join((*a, *b)).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner, code = np.repeat(np.arange(len(size)), size), letter.copy()
    for k in range(1, q):
        if k > 2:  # three letters of 21 bits fit
            code = np.unique(code, return_inverse=True)[1]
        code[:-k] = code[:-k] << 21 | letter[k:]
    whole = np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size) <= size[owner] - q
    names, number = np.unique(code[whole], return_inverse=True)
    text, number = np.divmod(np.unique(owner[whole] * len(names) + number), len(names))
    return [number[text < len(a)].reshape(len(a), -1), number[text >= len(a)].reshape(len(b), -1)]


def _near_sets(threshold: float, q: int) -> Callable:
    """For `_met`: (x, y, similarity) of texts p whose q-grams share `threshold` of all theirs. Of two sets of n and m that share k,
    any n - k + RARE of the first have RARE in common with the second: those with the shortest lists in a block are counted for
    all of the block at once, and the others only where they are common."""

    def compare(xs: pa.StructArray, ys: pa.StructArray, same: bool) -> pa.RecordBatch:
        (x, y), found = _gram_numbers(xs.field("p").to_pylist(), ys.field("p").to_pylist(), q), ([], [], [])
        (a, n), (b, m) = x.shape, y.shape
        need = math.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
        if min(n, m) < need:
            return _found(xs, ys, *found, "similarity")
        # each gram's rows of ys, one after the other
        rows, size = np.argsort(y, axis=None, kind="stable") // m, np.bincount(y.ravel(), minlength=x.max() + 1)
        first, rare = np.cumsum(size) - size, min(RARE, need)
        few = np.take_along_axis(x, np.argsort(size[x], axis=1, kind="stable")[:, : n - need + rare], 1)
        step = max(CELLS // b, 1)
        for at in range(0, a, step):
            part = few[at : at + step]
            ids, row = part.ravel(), np.repeat(np.arange(len(part)), part.shape[1])
            ends = np.cumsum(size[ids])
            place = np.arange(ends[-1]) + np.repeat(first[ids] - (ends - size[ids]), size[ids])
            cells = np.bincount(rows[place] + np.repeat(row * b, size[ids]), minlength=len(part) * b)
            i, j = np.divmod(np.flatnonzero(cells >= rare), b)
            i, j = (k[j > i + at] if same else k for k in (i + at, j))
            for c in range(0, len(i), CELLS // (n * m) + 1):
                u, v = i[c : c + CELLS // (n * m) + 1], j[c : c + CELLS // (n * m) + 1]
                k = (x[u][:, :, None] == y[v][:, None, :]).sum(axis=(1, 2))
                value = k / (n + m - k)
                ok = value >= threshold - 1e-12
                for out, new in zip(found, (u[ok], v[ok], value[ok])):
                    out.append(new)
        return _found(xs, ys, *found, "similarity")

    return compare


def similar_names(names: DataFrame, threshold: float = 0.6, q: int = 3) -> DataFrame:
    """names(name) -> (x, y, similarity), x < y: different names that share `threshold` of their q-grams, between blanks and in
    lower case. Repeated and null names are compared once and not at all."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1")
    n = names.select("name").filter("name IS NOT NULL").distinct()
    padded = F.concat(F.lit(" " * (q - 1)), F.lower("name"), F.lit(" " * (q - 1)))
    sets = materialise(n.select(F.col("name").alias("id"), padded.alias("p"), F.size(F.array_distinct(grams(padded, q))).alias("n")).filter("n > 0"))
    near = _met(sets, sets, ["p"], threshold, _near_sets(threshold, q), "x string, y string, similarity double", ordered=True)
    return near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "similarity")


def letters(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^a-zA-Z]", ""))


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem)


def _letter_bits(words: list[str], times: int) -> tuple[np.ndarray, np.ndarray]:
    """(the letters' numbers, whether a word has each letter at least once, twice, ... `times` times), words of one length."""
    w = np.frombuffer("".join(words).encode("ascii"), dtype=np.uint8).reshape(len(words), -1) - 97
    n = np.zeros((len(words), 26), np.int32)
    np.add.at(n, (np.arange(len(words))[:, None], w), 1)
    return w, (n[:, :, None] > np.arange(times)).reshape(len(words), -1).astype(np.float32)


def _common_of_pairs(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of the words i of p and j of q, letters' numbers each; those of p have up to
    64. Bits of V that are 0 count it, for all pairs at once."""
    places = np.zeros((26, len(p)), dtype=np.uint64)
    for k in range(p.shape[1]):
        places[p[:, k], np.arange(len(p))] |= np.uint64(1 << k)
    v = np.full(len(i), np.uint64(2**64 - 1))
    for k in range(q.shape[1]):
        u = v & places[q[j, k], i]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & np.uint64(2 ** p.shape[1] - 1)).astype(np.int32)


def common_subsequences(xs: list[str], ys: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each of ys with each of xs, words of a to z; those of one side are all of
    one length, those of xs of up to 64."""
    j, i = (k.ravel() for k in np.mgrid[: len(ys), : len(xs)])
    return _common_of_pairs(_letter_bits(xs, 1)[0], _letter_bits(ys, 1)[0], i, j).reshape(len(ys), len(xs))


def _near_letters(xs: pa.StructArray, ys: pa.StructArray, _: bool) -> pa.RecordBatch:
    """For `_met`: (x, y, ratio) of words with a ratio of matching runs above RATIO. What matches are common letters, which a product
    of matrices counts, and a common subsequence, which is looked at where those are enough."""
    a, b = xs.field("w").to_pylist(), ys.field("w").to_pylist()
    least = RATIO / 2 * (len(a[0]) + len(b[0])) + 1e-9
    times = min(len(a[0]), len(b[0]))
    times = min(times, max(max(w.count(c) for c in set(w)) for w in (a if len(a) < len(b) else b)))
    (p, has), (q, other) = _letter_bits(a, times), _letter_bits(b, times)
    found, run = ([], [], []), difflib.SequenceMatcher(None)
    for at in range(0, len(b), AT_ONCE):
        j, i = np.nonzero(other[at : at + AT_ONCE] @ has.T > least)
        j += at
        if p.shape[1] <= 64 or q.shape[1] <= 64:
            kept = (_common_of_pairs(p, q, i, j) if p.shape[1] <= 64 else _common_of_pairs(q, p, j, i)) > least
            i, j = i[kept], j[kept]
        last = None
        for x, y in zip(i.tolist(), j.tolist()):
            if y != last:
                run.set_seq2(b[y])  # what it keeps of the second word serves for all first ones
                last = y
            run.set_seq1(a[x])
            if (r := run.ratio()) > RATIO:
                for out, new in zip(found, (x, y, r)):
                    out.append([new])
    return _found(xs, ys, *found, "ratio")


def _alike_letters(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, ratio) with a ratio of matching runs above RATIO, of a(id, w) and b(id, w), w the letters. The shorter then has more
    than RATIO / (2 - RATIO) of the longer's letters."""
    of = lambda df: df.filter("w <> ''").select("id", F.length("w").alias("n"), "w")
    return _met(of(a), of(b), ["w"], RATIO / (2 - RATIO), _near_letters, "x string, y string, ratio double")


def scored(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, score, reason) of a(class) and b(class): the first rule on names that fits, as `matching.name_score` has them, for
    every pair that one fits. Equal letters and stems are equal keys; parts and letters go by the filters."""
    one = lambda df: df.select(F.col("class").alias("id"), letters(F.col("class")).alias("w")).filter("id IS NOT NULL").distinct().withColumn("s", _stem("w"))
    a, b = materialise(one(a)), materialise(one(b))
    equal = lambda k: a.select(F.col("id").alias("x"), k).join(b.select(F.col("id").alias("y"), k), k).select("x", "y")
    parts = lambda df: df.select("id", F.array_distinct(F.transform(F.when(F.size(F.regexp_extract_all("id", F.lit(PARTS), F.lit(0))) > 0, F.regexp_extract_all("id", F.lit(PARTS), F.lit(0))).otherwise(F.array("id")), lambda x: F.lower(x))).alias("tokens"))
    rules = [
        equal("w").select("x", "y", F.lit(0).alias("rule"), F.lit(1.0).alias("score")),
        equal("s").select("x", "y", F.lit(1), F.lit(0.9)),
        similar_sets(parts(a), parts(b), PART_OVERLAP).filter(F.col("similarity") > PART_OVERLAP + 1e-12).select("x", "y", F.lit(2), F.lit(0.8)),
        _alike_letters(a, b).select("x", "y", F.lit(3), "ratio"),
    ]
    found = rules[0]
    for r in rules[1:]:
        found = found.union(r)
    best = found.groupBy("x", "y").agg(F.min(F.struct("rule", "score")).alias("r"))
    reason = F.element_at(F.array(*[F.lit(t) for t in ("exact", "stem", "token_overlap", "fuzzy_name")]), F.col("r.rule") + 1)
    return best.select("x", "y", F.col("r.score").alias("score"), reason.alias("reason"))
