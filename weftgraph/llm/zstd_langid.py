"""Language identification by compression: a zstandard raw-content dictionary per language, the smallest encoding wins.

A text is reduced to lower-case letters and spaces and encoded in blocks of BLOCK bytes, each on its own with every
language's dictionary, so that a long text is judged by all its blocks rather than by what it repeats of itself. The
margin is the share by which the second smallest total is larger; a text is rejected below `least_margin`.

A dictionary takes whole documents of its language in order of the hash of their text, each different text once, until
they fill it: at most DOCS documents of DICT_BYTES bytes in all, a bounded sample whose size is what is broadcast. Where a
document doesn't fit as a whole, its beginning fills the rest. Documents beyond the first DOCS by hash teach nothing.

Defined results: a null text, or one without letters (characters of Unicode's categories L), is `und` with score 0 and is rejected; so is any text if nothing was
learned (an empty table, or no lang). Ties go to the language with more documents, then the first in code point order, with score 0. Rows are independent and repeated rows get
equal results; long texts are encoded block by block; documents without a lang teach nothing; further columns are ignored by `identify` and kept by `annotate`, unless they have a result's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ._labels import is_held_out, remainder
from ._shared import arrow_columns

DOCS = 400
DICT_BYTES = 128 << 10
BLOCK = 4 << 10
LEVEL, LEAST_MATCH = 9, 4
LEAST_MARGIN = 0.01
#: Bytes that stay: a-z and what belongs to characters beyond ASCII; A-Z become lower, the rest spaces.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def reduced(text: str | None) -> bytes:
    return b" ".join(text.lower().encode().translate(_KEEP).split()) if text else b""


def learn(docs: DataFrame, held_by: int = 4, held: int = 2) -> dict[str, bytes]:
    """A dictionary for each lang of the documents outside the held-out remainder."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), held_by) != held)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()  # one row per language
    # a hash threshold keeps about twice as many texts as are wanted; the window then ranks only those
    h = F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    near = [(F.col("lang") == r["lang"]) & (h <= 2.0 * DOCS / max(1, r["texts"])) for r in counts]
    if not near:
        return {}
    some = known.filter(_any(near)).select("lang", "text", h.alias("h"))
    distinct = some.groupBy("lang", "h", F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.min("text").alias("text"))
    ranked = distinct.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "h2"))).filter(F.col("k") <= DOCS)
    # whole texts until the dictionary is full: what lies before a text tells whether it is needed
    before = F.coalesce(F.sum(F.octet_length("text")).over(W.partitionBy("lang").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.withColumn("before", before).filter(F.col("before") < 2 * DICT_BYTES).select("lang", "k", F.substring("text", 1, 2 * DICT_BYTES).alias("text")).collect()
    out = {}
    many = {r["lang"]: -r["n"] for r in counts}
    for lang in sorted({r["lang"] for r in rows}, key=lambda x: (many[x], x)):
        data = b" ".join(filter(None, (reduced(r["text"]) for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["k"]))))
        if len(data) >= 8:
            out[lang] = data[:DICT_BYTES]
    return out


def _any(conditions):
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


class Identifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import regex
        import zstandard as zstd

        self.letter = regex.compile(r"\p{L}").search

        self.langs = list(dictionaries)  # the most frequent first: it has the ties
        self.encoders = []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            how = zstd.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionaries[lang]), source_size=BLOCK, min_match=LEAST_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=how)
            self.encoders.append(zstd.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin)"""
        if not text or not self.langs or not self.letter(text):
            return "und", 0.0
        data = reduced(text)
        blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)] or [b""]
        sizes = [sum(len(x(b)) for b in blocks) for x in self.encoders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, second = sizes[order[0]], sizes[order[min(1, len(order) - 1)]]
        return self.langs[order[0]], 1.0 - best / second if len(order) > 1 else 1.0


def annotate(df: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN, without: tuple = ()) -> DataFrame:
    """df, less the columns of `without`, with lang_pred, score (the margin) and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def start():
        import pyarrow as pa

        identify = Identifier(shared.value)

        def each(texts):
            found = [identify(t.as_py()) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == "und" or s < least_margin for x, s in found], pa.bool_())]

        return each

    return arrow_columns(df, "text", [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], start, without=without)


def identify(docs: DataFrame, held_by: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    found = annotate(docs.select("doc_id", "text"), learn(docs, held_by, held), without=("text",))
    return found.select("doc_id", is_held_out(F.col("doc_id"), held_by, held).alias("held_out"), "lang_pred", "score", "rejected")
