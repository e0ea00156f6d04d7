"""Operators that look at all rows, against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import covering_simhash, lm_trie, mixing, pca_neardup, queries, warc_chunks
from weftgraph.llm.components import components

from .conftest import make, prose


def classes(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


# --- language model


@pytest.mark.parametrize("universe", [5, 1000, 1 << 40])
def test_elias_fano(universe):
    r = np.random.default_rng(universe)
    v = np.unique(r.integers(0, universe, 3000))
    ef = lm_trie.EliasFano(lm_trie.ef_pack("x", v, universe), "x")
    assert (ef.get(np.arange(len(v))) == v).all() and (ef.find(v) == np.arange(len(v))).all()
    ask = r.integers(0, universe, 3000)
    middle = ef.find(v, np.full(len(v), 3), np.full(len(v), len(v) - 1))
    assert (middle == np.where((np.arange(len(v)) >= 3) & (np.arange(len(v)) < len(v) - 1), np.arange(len(v)), -1)).all()
    assert (ef.find(ask) == np.where(np.isin(ask, v), np.searchsorted(v, ask), -1)).all()


def test_lm_against_counts(spark, odd, nothing):
    docs = make(spark, [(i, prose(i, i % 40), "en", "s") for i in range(120)]).union(odd)
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.collect()]
    train = [w for i, w in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    one, two, three = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(w, w[1:])), Counter(p for w in train for p in zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    t1, t2 = Counter(k[0] for k in two), Counter(k[:2] for k in three)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2)

    def p(w, i):
        q = (one[w[i]] - d) / n if one[w[i]] else d * v / n
        if i and one[w[i - 1]]:
            q = (two[w[i - 1], w[i]] + t1[w[i - 1]] * q) / (one[w[i - 1]] + t1[w[i - 1]])
        if i > 1 and two[w[i - 2], w[i - 1]]:
            h = w[i - 2], w[i - 1]
            q = (three[(*h, w[i])] + t2[h] * q) / (two[h] + t2[h])
        return math.log10(q)

    want = defaultdict(list)
    for i, w in rows:
        want[i].append((len(w), sum(one[x] > 0 for x in w), sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(p(w, k) for k in range(len(w)))))
    got = defaultdict(list)
    for r in lm_trie.score(docs).collect():
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        got[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9) and a[3] == pytest.approx(b[3], rel=0.03, abs=0.05)
    empty = lm_trie.score(nothing)
    assert empty.count() == 0


def test_lm_children_by_pointers(spark):
    docs = make(spark, [(i, "a b c a b d a b c", "en", "s") for i in (1, 2)])
    meta = lm_trie.train(docs)
    words = lm_trie.Vocabulary(meta)
    end, a, b, c, d = words.look_up([b"a", b"b", b"c", b"d"])[0].tolist()
    k = int(lm_trie.shard_of(np.array([a * words.universe + b]), meta["shards"])[0])
    files = [lm_trie.mapped(f"{meta['folder']}/{x}-{k}") for x in ("shard", "second")]
    shard = lm_trie.Shard(*files, words.universe)
    head = shard.heads.find(np.array([a]))
    pair = shard.level2.find(head * words.universe + b)
    first, end = shard.children(shard.pointers3, pair)
    assert sorted((shard.level3.get(np.arange(first[0], end[0])) - pair[0] * words.universe).tolist()) == sorted([c, d])
    # c(ab) / (c(a) + T(a)) and c(abd) / (c(ab) + T(ab)), within a code's step
    second, third, rest = (x[0] for x in shard.look_up(*(np.array([x]) for x in (a, b, d))))
    assert second == pytest.approx(6 / 7, rel=0.02) and third == pytest.approx(2 / 8, rel=0.02) and rest == pytest.approx(2 / 8, rel=0.02)


def test_lm_beyond_what_is_kept_open(spark, monkeypatch):
    """With more shards than may stay open the scores are the same, and what is open isn't opened again."""
    import pyarrow as pa

    from .conftest import prose

    texts = [prose(i, 60, " ".join(f"w{k}" for k in range(80))) for i in range(40)]
    meta = lm_trie.train(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    opened = Counter()
    real = lm_trie._open
    monkeypatch.setattr(lm_trie, "_open", lambda uri: (opened.update([uri]), real(uri))[1])
    batches = [pa.array(texts[i : i + 10]) for i in range(0, 40, 10)]
    scores = {}
    for most in (1, 100):
        monkeypatch.setattr(lm_trie, "MOST_OPEN", most)
        opened.clear()
        model = lm_trie.Model(meta)
        scores[most] = [model.score(b)[3].tolist() for b in batches]
        assert len(opened) > 1 and min(opened.values()) == 1 and max(opened.values()) == (len(batches) if most == 1 else 1)
        assert len(model.shards) <= most
    assert scores[1] == scores[100]


@pytest.mark.parametrize("texts", [["a b c"], ["a b c", "d e f"], ["", None], ["a a b b"]])
def test_lm_of_few_words_is_finite(spark, texts):
    docs = make(spark, [(i + 1, t, "en", "s") for i, t in enumerate(texts)] + [(50, "a q", None, None)])
    for r in lm_trie.score(docs).collect():
        assert math.isfinite(r.score) and r.score < 0


def test_lm_words_are_those_of_the_pattern(odd):
    texts = [r.text for r in odd.select("text").collect()] + ["\x1c a\u00a0b\u2003c\x0b\x0cD É", "  lead", "trail \n"]
    array = pa.array(["dropped", *texts]).slice(1)
    words, at, sizes = lm_trie.tokenised(array)
    found = iter([words[k].decode() for k in at])
    for t, n in zip(texts, sizes, strict=True):
        want = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        assert [next(found) for _ in range(n)] == want


def test_lm_rows_added_up_in_turns():
    r = np.random.default_rng(3)
    parts = [(r.integers(0, 9, 50), r.integers(0, 5, 50), r.integers(1, 4, 50)) for _ in range(4)]
    whole = Counter()
    for p, w, c in parts:
        for x, y, n in zip(p.tolist(), w.tolist(), c.tolist()):
            whole[x, y] += n
    some = lm_trie._added_up(parts[:2])
    p, w, c = (x.tolist() for x in lm_trie._added_up([some, *parts[2:]]))
    assert list(zip(p, w)) == sorted(whole) and c == [whole[k] for k in sorted(whole)]


def test_lm_batches_dont_matter(spark):
    docs = make(spark, [(i, prose(i, 30), "en", "s") for i in range(40)])
    model = lm_trie.Model(lm_trie.train(docs))
    texts = pa.array([prose(i, 25) for i in range(30)])
    whole, parts = model.score(texts), [model.score(texts.slice(a, 4)) for a in range(0, 30, 4)]
    for k in range(4):
        assert np.allclose(np.concatenate([p[k] for p in parts]), whole[k])


# --- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, refers_to int")


def test_warc_round_trip(spark):
    long = "é<p>\r\n\r\nWARC/1.0\r\n" * 40_000
    rows = [(1, "http://a/\r\nx", long), (5, None, long), (3, "u", long), (4, "u", "short"), (6, "u", "short"), (7, None, None), (8, "", ""), (None, "u", "y" * 2000), (9, "u", "y" * 2000), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "q" * 1000), (12, "u", "q" * 1000)]
    p = pages(spark, rows)
    con = duckdb.connect()
    con.register("pages", p.toArrow())
    rel = con.sql(warc_chunks.ORACLE)
    got = warc_chunks.stored(p).select(*rel.columns).collect()
    want = [(i, n, d, "revisit" if i is None and n == 2000 else t, 9 if i is None and n == 2000 else r) for i, n, d, t, r in rel.fetchall()]  # a null id revisits
    assert Counter(map(tuple, got)) == Counter(want)


def test_warc_chunks_hold_the_payload(spark):
    html = "".join(chr(97 + i % 26) for i in range(200_000))
    manifest = warc_chunks.write(pages(spark, [(1, "u", html), (2, "v", "")]))
    rows = warc_chunks.read_chunks(manifest).orderBy("page_id", "chunk_no").collect()
    mine = [r for r in rows if r.page_id == 1]
    assert len(mine) == 4 and [r.chunk_no for r in mine] == [0, 1, 2, 3] and b"".join(r.data for r in mine).decode() == html
    assert [r["last"] for r in mine] == [False, False, False, True] and mine[-1].sha1_so_far == mine[-1].payload_digest
    assert [bytes(r.data) for r in rows if r.page_id == 2] == [b""]


def test_warc_record_ids_differ(spark):
    rows = [(i, "u", h) for i in (1, 1, 2, None, None) for h in ("y" * 1500, "short")]
    found = warc_chunks.read_chunks(warc_chunks.write(pages(spark, rows)), with_data=False).collect()
    assert len({r.record_id for r in found}) == len(found) == len(rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in found if r.payload_bytes == 1500) == {(1, "revisit", 2): 2, (2, "response", None): 1, (None, "revisit", 2): 2}


def test_warc_of_nothing(spark):
    assert warc_chunks.stored(pages(spark, [])).count() == 0


# --- mixing


def test_mix_against_sql(spark, odd, nothing):
    docs = make(spark, [(i, prose(i, i % 90), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(400)]).union(odd)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    rel = con.sql(mixing.ORACLE)
    got = mixing.mix(docs).select(*rel.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())
    whole = mixing.repeated(docs)
    assert whole.columns == docs.columns
    assert whole.count() == sum(r.passes for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.repeated(nothing).count() == 0


def test_mix_without_ids_comes_near_its_targets(spark):
    docs = make(spark, [(None if i % 2 else 7, prose(i, 1 + i % 50), "en", f"s{i % 3}") for i in range(900)])
    sized = Counter()
    for r in mixing.repeated(docs).collect():
        sized[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.plan(docs)[1].collect()}
    assert targets.keys() == {"s0", "s1", "s2"} and all(abs(sized[k] - t) <= 25 for k, t in targets.items())


def test_mix_comes_near_its_targets(spark):
    docs = make(spark, [(i, prose(i, 1 + i % 50), "en", f"s{i % 5}") for i in range(1500)])
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 50 and r.over <= 0 for r in got)
    total = sum(len(r.text.split()) for r in docs.collect())
    assert sum(r.target for r in got) == pytest.approx(1.5 * total)


# --- SimHash


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_all_pairs(spark, odd, nothing):
    base = [prose(i, 60) for i in range(30)]
    near = [t.replace(t.split()[7], "changed", 1) for t in base]
    docs = make(spark, [(1000 + i, t, "en", "s") for i, t in enumerate(base + near + base[:5])]).union(odd.filter("doc_id IS NOT NULL"))
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    found = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = defaultdict(lambda: 1 << 62)
    for r, c in zip(rows, found):
        least[c] = min(least[c], r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least[c], r.doc_id == least[c]) for r, f, c in zip(rows, fps, found))
    assert Counter(map(tuple, covering_simhash.near_duplicates(docs).collect())) == want
    assert covering_simhash.near_duplicates(nothing).count() == 0


def test_covering_is_total():
    masks = covering_simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_in_a_hot_bucket(spark):
    r = np.random.default_rng(4)
    fps = {0, 3, *(int(x) for x in r.integers(0, 1 << 12, 500))}
    fps = sorted(fps)
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r.node: r.component for r in components(covering_simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    assert [got.get(x, x) for x in fps] == [fps[c] for c in want]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 501), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}


# --- vectors


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(5)
    centers = r.normal(size=(20, 24))
    x = [centers[i % 20] + 0.12 * r.normal(size=24) for i in range(300)]
    rows = [(i, [float(c) for c in v], 1, "k") for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in x[0]], 1, "k") for i in range(7)]
    rows += [(2000, None, 1, "k"), (2001, [], 1, "k"), (2002, [0.0] * 24, 1, "k"), (2003, [float("nan")] * 24, 1, "k"), (2004, [None] * 24, 1, "k"), (2005, [1.0, 0.0], 1, "k"), (2006, [2.0, 0.0], 1, "k"), (2007, [float("inf")] * 24, 1, "k"), (5, [float(c) for c in x[5]], 1, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, kept string")
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, *_ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / math.sqrt(np.dot(rows[i][1], rows[i][1]) * np.dot(rows[j][1], rows[j][1])) >= 0.95]
    n = Counter(k for p in links for k in p)
    found = classes(len(rows), links)
    least = {}
    for (i, *_), c in zip(rows, found):
        least[c] = min(least.get(c, i), i)
    want = Counter((row[0], n[k], least[c], row[0] == least[c]) for k, (row, c) in enumerate(zip(rows, found)))
    for size in (pca_neardup.TILE, 32):  # one tile, and links across eight tiles and many jobs
        assert Counter(map(tuple, pca_neardup.near_duplicates(df, tile_size=size).collect())) == want
    assert pca_neardup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_any_magnitude_link(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [1e300, 2e300]), (4, [2.0, -1.0]), (5, [5e-324, 0.0]), (None, [7.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pca_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), None: (1, 5)}


@pytest.mark.parametrize("n, size", [(700, 50), (1, 3), (90, 7)])
def test_a_chain_of_vectors_over_many_tiles(spark, n, size):
    """Neighbours on a circle's arc link, others don't: one component, through links between tiles and jobs only."""
    step = math.acos(0.95) * 0.9
    at = [k * step / 1.0 for k in range(min(n, 18))]
    rows = [(k, [math.cos(a), math.sin(a), 0.0]) for k, a in enumerate(at)] + [(1000 + k, [0.0, 0.001 * (k % 9), 1.0 + k]) for k in range(n)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= 0.95, 1)
    found = classes(len(rows), list(zip(*map(np.ndarray.tolist, np.nonzero(near)))))
    got = {r.vec_id: (r.n_links, r.component_id) for r in pca_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile_size=size).collect()}
    degree = (near | near.T).sum(1)
    assert got == {i: (int(degree[k]), rows[found[k]][0]) for k, (i, _) in enumerate(rows)}


def test_spanning_against_a_walk():
    r = np.random.default_rng(8)
    for n, m in ((1, 0), (50, 20), (300, 290), (40, 900)):
        x, y = r.integers(0, n, m), r.integers(0, n, m)
        assert pca_neardup.spanning(n, x, y).tolist() == classes(n, list(zip(x.tolist(), y.tolist())))


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(6)
    y = pca_neardup.unit(r.normal(size=(400, 32)))
    for lead in (1, 8, 31, 32):
        b = pca_neardup.bounds(y, lead)
        assert (b @ b.T + 1e-5 >= y @ y.T).all()


def test_queries_are_named():
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{i}" for i in range(1, 14)}
