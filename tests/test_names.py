"""Similarity joins of names against all pairs: no pair is lost, none is added, nothing is crossed."""

import difflib
import os
import random

import duckdb
import pyarrow as pa
import pytest

from weftgraph.operators import matching, names
from weftgraph.plans import all_queries

SF = "/root/testdata/sf0.001"
R = random.Random(4)


def _varied(word):
    w = list(word)
    for _ in range(R.choice([0, 1, 1, 2, 3])):
        i = R.randrange(len(w) + 1)
        w[i : i + R.choice([0, 1])] = R.choice(["", "s", "e", "x", "Y", "_", "1", " "])
    return "".join(w)


BASE = "CustomerOrder customer orders OrderItem itemOrdered SensorReadingValue ValueOfSensorReading connection connected abc ab a cab x 12 34 HTTPServer serverHTTP banana bananas ananab aaaaaaaa aaaaaaab locations".split()
NAMES = sorted({_varied(R.choice(BASE)) for _ in range(260)} | set(BASE) | {"", " ", "é", "ünïcode", "unicode"})


@pytest.fixture(scope="module")
def sides(spark):
    half = len(NAMES) * 2 // 3
    a, b = NAMES[:half], NAMES[len(NAMES) - half :]
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, *xs[:9], None]], "class string")
    return a, b, frame(a), frame(b)


def test_scores_equal_those_of_all_pairs(sides):
    a, b, left, right = sides
    got = {(r["x"], r["y"]): (pytest.approx(r["score"]), r["reason"]) for r in names.scored(left, right).collect()}
    want = {(x, y): s for x in a for y in b if (s := matching.name_score(x, y))[1]}
    assert {s[1] for s in want.values()} == {"exact", "stem", "token_overlap", "fuzzy_name"}
    assert {k: (v[0], v[1]) for k, v in want.items()} == got


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.6, 0.8, 1.0])
def test_sets_equal_those_of_all_pairs(spark, threshold):
    sets = [(i, R.sample("abcdefghijklmnop", R.randrange(9))) for i in range(150)]
    df = spark.createDataFrame(sets, "id int, tokens array<string>")
    got = {(r["x"], r["y"]): r["similarity"] for r in names.similar_sets(df, df, threshold).collect()}
    want = {(i, j): len(set(s) & set(t)) / len(set(s) | set(t)) for i, s in sets for j, t in sets if s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= threshold - 1e-12}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_no_cross_join(sides):
    _, _, left, right = sides
    for df in (names.scored(left, right), names.similar_names(left.withColumnRenamed("class", "name"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_sides(spark, sides):
    _, _, left, right = sides
    assert names.scored(left.limit(0), right).count() == 0 == names.scored(left, right.limit(0)).count()
    assert names.similar_names(spark.createDataFrame([(None,), ("ab",)], "name string")).count() == 0


def test_shapes_that_are_alike(spark):
    rows = [(f"c{i}", d, v) for i, (d, v) in enumerate([(0.0, 0), (0.0, 3), (1.0, 1), (2.4, 1), (2.6, 7), (40.0, 2), (41.0, 0), (5.0, 5)])]
    df = spark.createDataFrame(rows, "class string, degree double, diversity int")
    alike = lambda p, q: 1 - abs(p - q) / (max(p, q) + 1e-6)
    want = {(a, b): pytest.approx((alike(d, e) + alike(v, w)) / 2) for a, d, v in rows for b, e, w in rows if (alike(d, e) + alike(v, w)) / 2 > 0.4}
    assert {(r["x"], r["y"]): r["structure"] for r in matching._alike_shapes(df, df).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_fuzzy_match_on_the_tables(spark):
    """The registered query against the rules on all pairs of names."""
    con = duckdb.connect()
    clients, vendors = ({x for (x,) in con.execute(f"SELECT DISTINCT name FROM '{SF}/{t}.parquet' WHERE name IS NOT NULL").fetchall()} for t in ("clients", "vendors"))
    want = []
    for x in clients:
        scored = sorted(((s, y, why) for y in vendors for s, why in [matching.name_score(x, y)] if why and s >= 0.5), key=lambda t: (-round(t[0], 3), t[1]))
        want += [(x, y, round(s, 3), why) for s, y, why in scored[:3]]
    assert sorted(map(tuple, all_queries.QUERIES["fuzzy_match"](spark, SF).collect())) == sorted(want)


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


@pytest.mark.parametrize("n, m", [(1, 1), (5, 9), (64, 40), (63, 130)])
def test_common_subsequences(n, m):
    words = lambda k, size: ["".join(R.choice("abcde") for _ in range(size)) for _ in range(k)]
    xs, ys = words(7, n), words(5, m)
    assert names.common_subsequences(xs, ys).tolist() == [[_subsequence(x, y) for x in xs] for y in ys]


def test_long_names_and_several_blocks(spark, monkeypatch):
    """Names beyond 64 letters on either side and on both, in blocks of a few names; q-grams likewise, each pair once."""
    monkeypatch.setattr(names, "LEAST_BLOCK", 3)
    monkeypatch.setattr(names, "AT_ONCE", 2)
    long = ["".join(R.choice(["an", "jo", "ri", "ke", "el"]) for _ in range(R.choice([7, 7, 8, 26, 33, 33, 40]))) for _ in range(40)]
    some = sorted({*long, *(x[:-3] + "xyz" for x in long), *(x + "e" for x in long)})
    a, b = some[::2], some[1::2]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "class string")
    got = {(r["x"], r["y"]): (pytest.approx(r["score"]), r["reason"]) for r in names.scored(frame(a), frame(b)).collect()}
    assert got == {(x, y): s for x in a for y in b if (s := matching.name_score(x, y))[1]}
    grams = {x: {f"  {x}  "[i : i + 3] for i in range(len(x) + 2)} for x in some}
    want = [(x, y) for x in some for y in some if x < y and len(grams[x] & grams[y]) / len(grams[x] | grams[y]) >= 0.6 - 1e-12]
    assert sorted((r["x"], r["y"]) for r in names.similar_names(frame(some).withColumnRenamed("class", "name")).collect()) == want


@pytest.mark.parametrize("q", [1, 2, 3, 5])
def test_grams_of_texts_as_shared_numbers(q):
    sets = lambda texts: [{t[i : i + q] for i in range(len(t) - q + 1)} for t in texts]
    a, b = ["abcabcd", "bcdeabc\U0001f600"[:7], "é\U0001f600abcde"], ["xbcdefgab", "aabcdefgh"]
    a, b = ([t for t, s in zip(side, sets(side)) if len(s) == len(sets(side)[0])] for side in (a, b))
    x, y = names._gram_numbers(a, b, q)
    for text, row in zip((*sets(a), *sets(b)), (*x.tolist(), *y.tolist())):
        assert len(set(row)) == len(row) == len(text)
        for other, too in zip((*sets(a), *sets(b)), (*x.tolist(), *y.tolist())):
            assert len(text & other) == len(set(row) & set(too))


def test_rare_grams_lose_no_pair_and_add_none(monkeypatch):
    """A block with itself and with another, in many pieces."""
    some = [n for n in NAMES if len(n) > 2]
    grams = lambda p: frozenset(p[i : i + 3] for i in range(len(p) - 2))
    texts = sorted({f"  {n.lower()}  " for n in some})
    by = {}
    for t in texts:
        by.setdefault(len(grams(t)), []).append(t)
    block = lambda ts: pa.StructArray.from_arrays([pa.array(ts), pa.array(ts)], names=["id", "p"])
    monkeypatch.setattr(names, "CELLS", 40)
    compare, found = names._near_sets(0.6, 3), 0
    for n, xs in by.items():
        for m, ys in by.items():
            got = compare(block(xs), block(ys), n == m).to_pydict()
            want = {(s, t): len(grams(s) & grams(t)) / len(grams(s) | grams(t)) for i, s in enumerate(xs) for j, t in enumerate(ys) if (n != m or i < j)}
            want = {k: pytest.approx(v) for k, v in want.items() if v >= 0.6 - 1e-12}
            assert dict(zip(zip(got["x"], got["y"]), got["similarity"])) == want and len(got["x"]) == len(want)
            found += len(want)
    assert found > 50


def test_names_are_scored_once(spark, monkeypatch):
    """Scores are read twice, and comparing is the work."""
    frame = lambda xs: {"classes": spark.createDataFrame([(x,) for x in xs], "class string")}
    plan = matching.matches(frame(["CustomerOrder", "banana"]), frame(["OrdersCustomer", "bananas"]))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_letters_are_counted_before_subsequences(monkeypatch):
    """Pairs with too few letters in common aren't looked at further; long words on either side or both are."""
    looked = []
    real = names._common_of_pairs
    monkeypatch.setattr(names, "_common_of_pairs", lambda p, q, i, j: looked.append(len(i)) or real(p, q, i, j))
    block = lambda ws: pa.StructArray.from_arrays([pa.array(ws), pa.array(ws)], names=["id", "w"])
    R2 = random.Random(8)
    word = lambda n, of: "".join(R2.choice(of) for _ in range(n))
    for n, m, of in ((9, 8, "abcd"), (70, 60, "ab"), (60, 70, "ab"), (70, 72, "ab")):
        xs, ys = [word(n, of) for _ in range(20)], [word(m, of) for _ in range(15)]
        ys[0] = (xs[0] * 2)[:m]
        got = names._near_letters(block(xs), block(ys), False).to_pydict()
        want = {(x, y): r for x in xs for y in ys if (r := difflib.SequenceMatcher(None, x, y).ratio()) > names.RATIO}
        assert dict(zip(zip(got["x"], got["y"]), got["ratio"])) == want and want
    looked.clear()
    names._near_letters(block(["abcdefgh"] * 50), block(["ijklmnop"] * 50), False)
    assert sum(looked) == 0
