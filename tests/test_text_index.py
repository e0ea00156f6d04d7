"""Substring search by index against a scan, and what of the index it reads."""

import random

import pytest

from weftgraph.operators import text_index

R = random.Random(6)
TEXTS = [(i, "".join(R.choice("abcAB é😀 .-") for _ in range(R.randrange(60)))) for i in range(400)]
TEXTS += [(None, "abc abc"), (7, "another text of one id: abc"), (500, None), (501, ""), (502, "ab"), (503, "the needle is here"), (504, "needles, " * 2000), (505, "İstanbul")]


@pytest.fixture(scope="module")
def index(spark):
    return text_index.build(spark.createDataFrame(TEXTS, "id long, text string"), buckets=16)


@pytest.mark.parametrize("query", ["abc", "needle", "bé😀", "a", "ab", "", "Needles, NEEDLES", "not there", " the", "cab ca", "😀😀"])
def test_same_rows_as_a_scan(index, query):
    want = sorted((i, t) for i, t in TEXTS if i is not None and t is not None and query.lower() in t.lower())
    assert sorted(map(tuple, text_index.containing(index, query).collect())) == want


def _partitions_read(df):
    """Partitions of each table that its scan chose."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), {}

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name == "FileSourceScanExec":
            table = node.relation().location().rootPaths().head().getName()
            found[table] = node.metrics().apply("numPartitions").value()
        for kid in ([node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]):
            walk(kid)

    walk(plan)
    return found


def test_only_candidates_are_read(index):
    """Postings of the partitions of three trigrams at most, texts of the candidates' partitions."""
    read = _partitions_read(text_index.containing(index, "the needle"))
    assert read["postings"] <= text_index.RAREST and read["texts"] <= 2 < index.buckets
    assert index.texts.select("place").distinct().count() == index.buckets


def test_trigrams_of_a_long_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(200_000))
    df = text_index.trigrams(spark.createDataFrame([(text,), ("ab",), ("ÀBC",)], "t string"), "t", "g")
    grams = [r["g"] for r in df.collect()]
    assert [len(g) for g in grams] == [26, 0, 1] and grams[2] == ["àbc"]


def test_an_empty_index(spark):
    nothing = text_index.build(spark.createDataFrame([(1, None)], "id long, text string"))
    assert text_index.containing(nothing, "abc").count() == 0 == text_index.containing(nothing, "a").count()


def test_postings_are_of_blocks(spark, monkeypatch):
    """Each block has a trigram once, however many of its texts do, and blocks end by their length."""
    monkeypatch.setattr(text_index, "BLOCK", 1_000)
    texts = spark.createDataFrame([(i, f"text number {i % 10} of many") for i in range(1_000)], "id long, text string")
    built = text_index.build(texts, buckets=2)
    blocks = built.texts.select("place", "block").distinct().count()
    assert 21 <= blocks <= 44  # a task that has both places deals a block to both
    assert built.postings.filter("gram = 'num'").count() == blocks
    assert sorted(r["id"] for r in text_index.containing(built, "number 7 ").collect()) == list(range(7, 1_000, 10))
