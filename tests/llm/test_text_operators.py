"""Operators on one text at a time, against brute force, a public library, or held-out labels."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe_segtree, gam_quality, quality_rules, queries, toxic_segments, zstd_langid

from .conftest import make, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(odd):
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *by_hand(r.text)) for r in rows)
    got = quality_rules.score(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_keeps_other_columns(odd, nothing):
    out = quality_rules.annotate(odd)
    assert out.count() == odd.count() and "_text" in out.columns and out.columns.count("kept") == 1
    assert quality_rules.score(nothing).count() == 0


def test_quality_verdict_is_the_table(spark):
    docs = make(spark, [(0, prose(5, 80), "en", "s"), (1, "## ** " * 60, "en", "s"), (2, "zzz qqq xxyy " + " ".join(f"w{i}" for i in range(80)), "en", "s")])
    assert {r.doc_id: r.kept for r in quality_rules.score(docs).collect()} == {0: True, 1: False, 2: False}


def test_quality_runs_no_python(odd):
    plan = quality_rules.score(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(odd, nothing, library):
    rows = odd.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe_segtree.round_trip(odd, queries.tokenizer_path()).collect())) == want
    assert bpe_segtree.round_trip(nothing, queries.tokenizer_path()).count() == 0


def test_bpe_round_trip_columns(odd):
    path = queries.tokenizer_path()
    out = bpe_segtree.decode(bpe_segtree.encode(odd, path), path)
    assert out.filter("coalesce(text, '') <> decoded OR size(ids) <> n_tokens").count() == 0 and "score" in out.columns


def test_bpe_by_array_and_by_list(library):
    codec = bpe_segtree.Codec(bpe_segtree.load(queries.tokenizer_path()))
    r = np.random.default_rng(1)
    words = [bytes(r.integers(97, 103, n, dtype=np.uint8)) for n in r.integers(1, 60, 400)]
    one = [codec.merge_one(w) if len(w) > 1 else codec.byte_ids[list(w)].tolist() for w in words]
    assert codec.merge(words) == one == [library.encode(w.decode(), add_special_tokens=False).ids for w in words]


# --- language ID

LANGS = {"en": "the of and house water running people after before winter", "de": "der die und haus wasser laufen leute nach vorher winterzeit", "fr": "le la et maison eau courir gens après avant hiver"}


def test_language_held_out(spark, odd):
    docs = make(spark, [(i, prose(i, 40, LANGS[k]), k, "s") for i, k in enumerate([*LANGS] * 60)])
    got = zstd_langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(180))
    assert held.filter("lang <> lang_pred OR rejected").count() == 0
    found = zstd_langid.annotate(odd, zstd_langid.learn(docs)).collect()
    letter = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in found if not letter(r.text))
    assert all(r.lang_pred in LANGS for r in found if letter(r.text)) and all(0 <= r.score <= 1 for r in found)


def test_numerals_are_no_letters(spark):
    docs = make(spark, [(i, prose(i, 40, LANGS[k]), k, "s") for i, k in enumerate([*LANGS] * 9)])
    identify = zstd_langid.Identifier(zstd_langid.learn(docs))
    assert [identify(t) for t in ("²", "½ Ⅷ 12 _", "中")][:2] == [("und", 0.0)] * 2 and identify("中")[0] != "und"


def test_language_against_plain_compression(spark):
    """Sizes block by block with a dictionary that is loaded anew each time; the same languages and margins."""
    import zstandard as zstd

    docs = make(spark, [(i, prose(i, 4000 if i % 30 == 0 else 30, LANGS[k]), k, "s") for i, k in enumerate([*LANGS] * 30)])
    dictionaries = zstd_langid.learn(docs)
    identify = zstd_langid.Identifier(dictionaries)
    for r in docs.collect():
        data = " ".join(re.sub(r"[^a-z\x80-\U0010ffff]+", " ", r.text.lower()).split()).encode()
        size = {}
        for lang, content in dictionaries.items():
            how = zstd.ZstdCompressionParameters.from_level(9, dict_size=len(content), source_size=4096, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0)
            size[lang] = sum(len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how).compress(data[a : a + 4096])) for a in range(0, len(data), 4096))
        best, second = sorted(size.values())[:2]
        lang, score = identify(r.text)
        assert size[lang] == best and score == pytest.approx(1 - best / second)


def test_dictionary_takes_each_text_once_and_whole(spark):
    docs = make(spark, [(i, "copied text of many rows", "xx", "s") for i in range(400)] + [(1000 + i, f"wordof{chr(97 + i % 26)}{chr(97 + i // 26)} end", "xx", "s") for i in range(60)])
    learned = zstd_langid.learn(docs)["xx"].decode()
    assert learned.count("copied text") == 1 and learned.count(" end") == sum(zlib.crc32(str(1000 + i).encode()) % 4 != 2 for i in range(60))


def test_language_without_teachers(odd, nothing):
    assert {r.lang_pred for r in zstd_langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert zstd_langid.identify(nothing).count() == 0


# --- quality classifier


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, extra string")


def test_gam_held_out(spark, odd):
    texts = [prose(i, 60) if i % 2 else prose(i, 60).upper().replace(" ", "!! ") for i in range(240)]
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    labels = labelled(spark, [(i, i % 2, None, "x") for i in range(240)] + [(None, 1, 0, "x"), (1, None, 0, "x")])
    got = gam_quality.score(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out)
    model = gam_quality.learn(docs, labels)
    out = gam_quality.annotate(odd, model)
    assert out.count() == odd.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_gam_scores_are_sums_of_tables():
    r = np.random.default_rng(4)
    x = np.round(r.random((800, len(gam_quality.FEATURES))), 2)  # with ties
    model = gam_quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * r.random(800) > 0.9).astype(float))
    assert model["pairs"]
    for row, p in zip(x[:100].tolist(), gam_quality.predict(model, x[:100])):
        total = model["intercept"]
        for k, v in enumerate(row):
            total += model["tables"][k][sum(e <= v for e in model["edges"][k])]
        for a, b, table in model["pairs"]:
            total += table[sum(e <= row[a] for e in model["coarse"][a])][sum(e <= row[b] for e in model["coarse"][b])]
        assert p == pytest.approx(1 / (1 + math.exp(-total)))


def test_gam_trees_by_trying_every_cut():
    r = np.random.default_rng(5)
    for bins in (1, 2, 3, 9):
        g, h, n = r.normal(size=bins), r.random(bins) + 0.5, r.integers(4, 30, bins)
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        cuts = [0, bins]
        for _ in range(2):  # the cut that gains most, then the next
            tried = [(value(a, k) + value(k, b) - value(a, b), k) for a, b in zip(cuts, cuts[1:]) for k in range(a + 1, b) if min(n[a:k].sum(), n[k:b].sum()) >= gam_quality.LEAST_ROWS]
            if not tried or max(tried)[0] <= 1e-9:
                break
            cuts = sorted([*cuts, max(tried)[1]])
        want = np.concatenate([[g[a:b].sum() / (h[a:b].sum() + 1)] * (b - a) for a, b in zip(cuts, cuts[1:])])
        assert np.allclose(gam_quality._splits(g, h, n), want)
        table_g, table_h = r.normal(size=(bins + 1, 4)), r.random((bins + 1, 4)) + 0.5
        best = max((sum(table_g[p].sum() ** 2 / (table_h[p].sum() + 1) for p in ((slice(i), slice(j)), (slice(i), slice(j, None)), (slice(i, None), slice(j)), (slice(i, None), slice(j, None)))), i, j) for i in range(1, bins + 1) for j in range(1, 4))
        gain, tree = gam_quality._quarters(table_g, table_h)
        assert gain == pytest.approx(best[0] - table_g.sum() ** 2 / (table_h.sum() + 1))
        assert tree[0, 0] == pytest.approx(table_g[: best[1], : best[2]].sum() / (table_h[: best[1], : best[2]].sum() + 1))


def test_gam_without_labels(spark, odd, nothing):
    none = labelled(spark, [])
    assert {r.score for r in gam_quality.score(odd, none).collect()} == {0.5}
    assert gam_quality.score(nothing, none).count() == 0


def test_gam_learns_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((3000, len(gam_quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam_quality.fit(x, y)
    assert ((gam_quality.predict(model, x) >= 0.5) == (y > 0)).mean() > 0.95


# --- toxicity


def all_maximal(scores):
    """Maximal scoring segments by their definition: the best one, then those to its left and right."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, n = -best[2], -best[1]
    return all_maximal(scores[:a]) + [(a, a + n)] + [(x + a + n, y + a + n) for x, y in all_maximal(scores[a + n :])]


def test_segments_by_definition():
    r = np.random.default_rng(3)
    for _ in range(200):
        scores = r.normal(-0.3, 1, r.integers(0, 14))
        assert [(a, b) for a, b, _ in toxic_segments.segments(scores)] == all_maximal(scores.tolist())


def test_toxic_held_out(spark, odd):
    bad = "scum moron idiot trash"
    texts = [prose(i, 50) + (f" {bad.split()[i % 4]} {prose(i + 1, 5)} {bad.split()[(i + 1) % 4]}" if i % 4 == 0 else "") for i in range(300)]
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    labels = labelled(spark, [(i, 1, int(i % 4 == 0), "x") for i in range(300)])
    got = toxic_segments.score(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out)
    out = toxic_segments.annotate(odd, toxic_segments.learn(docs, labels))
    assert out.count() == odd.count() and out.filter("score IS NULL OR score < 0 OR score > 1 OR predicted = 1").count() == 0


def test_toxic_model_and_scores_in_plain_python(spark):
    """Log-odds, contexts, lambda, threshold and scores, each by its definition."""
    bad = "vile foul nasty rotten wretch scum"
    texts = [(prose(i, 50) + (" " + prose(1000 + i, 12, bad) if i % 5 == 0 else "")) for i in range(300)]
    docs, labels = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), labelled(spark, [(i, None, int(i % 5 == 0), "x") for i in range(300)])
    model = toxic_segments.learn(docs, labels)
    words_of = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    teach = {t: int(i % 5 == 0) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5}
    count = [Counter(w for t, y in teach.items() if y == k for w in words_of(t)) for k in (0, 1)]
    total = [sum(c.values()) for c in count]

    def odds(c1, c0):
        a = 0.5 + 500 * (c1 + c0) / sum(total)
        side = lambda c, n: math.log((c + a) / max(n + 500 - c - a, 1))
        d = side(c1, total[1]) - side(c0, total[0])
        return d, d / math.sqrt(1 / (c1 + a) + 1 / (c0 + a))

    want = {}
    for w in count[0] | count[1]:
        if count[0][w] + count[1][w] >= 3:
            d, z = odds(count[1][w], count[0][w])
            if z >= 3.3:
                around = [{(x[i - 1], x[i + 1]) for t, y in teach.items() if y == k for x in [["", *words_of(t), ""]] for i in range(1, len(x) - 1) if x[i] == w} for k in (0, 1)]
                d, z = odds(len(around[1]), len(around[0]))
            if abs(z) >= 3.3:
                want[w.encode()] = d
    assert model["words"] == pytest.approx(want) and set(bad.split()) <= {w.decode() for w in want}
    # lambda: benign rates times exp(lambda * score) add up to one
    rate = {w: (count[0][w] + 500 * (count[0][w] + count[1][w]) / sum(total)) / (total[0] + 500) for w in count[0] | count[1] if count[0][w] + count[1][w] >= 3}
    score = lambda w: want.get(w.encode(), 0.0) - 0.35
    rest = max(0, 1 - sum(rate.values()))
    at = model["lambda"]
    assert sum(p * math.exp(at * score(w)) for w, p in rate.items()) + rest * math.exp(-0.35 * at) == pytest.approx(1, abs=1e-6)
    # scores: every maximal segment at or above the threshold
    scorer = toxic_segments.Scorer(model)
    best = {}
    for t in texts[:60]:
        s = [score(w) for w in words_of(t)]
        found = [sum(s[a:b]) for a, b in all_maximal(s)]
        best[t] = max(found, default=0.0)
        top = [x for x in found if x >= model["u"]]
        expected = model["K"] * len(s) * math.exp(-at * sum(x - model["u"] for x in top))
        assert scorer(t)[0] == pytest.approx((1 + math.exp(-expected)) / 2 if top else min(0.499, best[t] / (2 * model["u"])))
    # no other threshold between scores does better on the labelled documents
    mine = [(scorer.best(t)[1], y) for t, y in teach.items()]
    wrong = lambda u: sum((s >= u) != bool(y) for s, y in mine)
    assert wrong(model["u"]) == min(wrong(s) for s, _ in mine)


def test_toxic_without_labels(spark, odd, nothing):
    none = labelled(spark, [])
    assert {r.score for r in toxic_segments.score(odd, none).collect()} == {0.0}
    assert toxic_segments.score(nothing, none).count() == 0


def test_oracles_on_odd_rows(odd):
    """The SQL that checks the queries agrees on the odd rows too."""
    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "source").toArrow())
    rel = con.sql(quality_rules.oracle())
    got = quality_rules.score(odd).select(*rel.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())
