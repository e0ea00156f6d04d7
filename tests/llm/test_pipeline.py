"""The pipeline's stages against what their operators say of each input."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import covering_simhash, gam_quality, mixing, queries, zstd_langid

from .conftest import make, prose
from .test_corpus_operators import classes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SF).toArrow())
        if name != "bpe_encode":
            assert docs.columns == columns
        if name == "language_id":
            assert ids(docs) == ids(zstd_langid.annotate(before, zstd_langid.learn(before)).filter("NOT rejected"))
        elif name == "quality_classifier":
            model = gam_quality.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(docs) == ids(gam_quality.annotate(before, model).filter("score >= 0.5"))
        elif name == "near_dedup":
            groups = covering_simhash.near_duplicates(before).collect()
            assert ids(docs) == Counter({g.component_id for g in groups})
        elif name == "mix_sources":
            assert ids(docs) == Counter({r.doc_id: r.passes for r in mixing.mix(before).collect() if r.passes})
        else:
            library = Tokenizer.from_file(queries.tokenizer_path())
            text = {r.doc_id: r.text or "" for r in before.collect()}
            assert ids(docs) == ids(before)
            assert all(list(r.ids) == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in docs.collect())


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    twice = docs.union(docs)
    kept = corpus_pipeline.near_dedup(spark, twice, SF).collect()
    assert len({r.doc_id for r in kept}) == len(kept)


def test_one_row_a_group_whatever_the_ids(spark, odd):
    apart = [(None, prose(i, 80), "en", "s") for i in range(5)] + [(None, prose(0, 80), "de", "t")]
    apart += [(7000, prose(i, 80), "en", "s") for i in range(10, 14)] + [(6999, prose(10, 80), "en", "s")]
    docs = odd.union(make(spark, apart))
    rows = docs.collect()
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    fps = [covering_simhash.fingerprint(r.text) for r in rows]
    found = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    group = {r: c for r, c in zip(rows, found)}
    least = {}
    for r, c in zip(rows, found):
        least[c] = min(least.get(c, 1 << 62), 1 << 62 if r.doc_id is None else r.doc_id)
    got = kept.collect()
    assert Counter(group[r] for r in got) == Counter(set(found))
    assert all((1 << 62 if r.doc_id is None else r.doc_id) == least[group[r]] for r in got)


CLASH = ["_kept", "_row_a", "row_a", "fp", "c0", "c1", "s", "i", "passes", "limit", "_mix_s", "score", "predicted", "rejected", "lang_pred", "n_tokens", "h", "source_size"]


def test_stages_on_odd_rows(spark, odd, nothing, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table and clashing names, for each stage."""
    lang = {0: "the of and with from that", 1: "der die und nicht ein von"}
    extra = [(1000 + i, prose(i, 60, lang[i % 2]) if i % 4 < 2 else prose(i, 60, lang[i % 2]).upper().replace(" ", "!! "), f"l{i % 2}", "s") for i in range(160)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(make(spark, extra).select("doc_id", "text", "lang", "source", "n_chars"))
    for k, name in enumerate(CLASH):
        docs = docs.withColumn(name, F.lit(k) if k % 2 else F.lit(None).cast("string"))
    spark.createDataFrame([(1000 + i, int(i % 4 < 2), 0) for i in range(160)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
        if name != "bpe_encode":
            assert got.columns == docs.columns
            rows, had = Counter(got.collect()), Counter(docs.collect())
            most = 2 if name == "mix_sources" else 1
            assert all(n <= most * had[r] for r, n in rows.items()) and rows
        else:
            assert got.count() == docs.count()
