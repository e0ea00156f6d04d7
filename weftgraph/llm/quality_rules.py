"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every metric is a SQL expression over array functions of one row, so the plan is a scan and a projection: no
shuffle, whatever the skew, and a long text costs n log n of its own words.

Defined results: a null or empty text has no words and zero metrics, so the base rule fails it. Repeated rows and null
ids are scored row by row. Input columns beyond those named are ignored (`score`) or passed through unless a result
column has their name (`annotate`); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WS

SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was as be with by at from this are",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose metric lies in [least, most]; None leaves a side open."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The default table. Ratios are per word, per line or per character of words.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2, most=20),
    Rule("symbol_ratio", most=0.05),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.4),
    Rule("repeat_word_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
)


def words_of(text: Column) -> Column:
    """Words between white space. Replacing single characters and splitting at one is several times faster than a
    regular expression."""
    t = F.coalesce(text, F.lit(""))
    for c in WS[1:]:
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def _counted(df: DataFrame, text: str) -> DataFrame:
    """df with the counts. Each step is a projection of its own: what several expressions read is computed once and, outside
    of lambdas, by generated code. For n_repeat_words the 3-word windows are sorted with their positions, so that equal
    ones are neighbours; the words covered follow from the gaps between the positions of those."""
    c = F.col
    df = df.withColumn("_w", words_of(c(f"`{text}`"))).withColumn("_t", F.coalesce(c(f"`{text}`"), F.lit("")))
    n = F.size("_w")
    windows = F.arrays_zip(F.slice("_w", 1, n - 2), F.slice("_w", 2, n - 2), F.slice("_w", 3, n - 2), F.sequence(F.lit(0), n - 3))
    lines = F.filter(F.transform(F.split("_t", "\n"), lambda x: F.struct(x.alias("raw"), F.btrim(x, F.lit(WS)).alias("x"))), lambda x: x["x"] != "")
    df = df.withColumns({"_j": F.array_join("_w", ""), "_l": lines, "_s": F.when(n >= 4, F.sort_array(windows))})

    def as_before(k: Column) -> Column:
        x, y = F.get("_s", k), F.get("_s", k - 1)
        return (x["0"] == y["0"]) & (x["1"] == y["1"]) & (x["2"] == y["2"])

    df = df.withColumn("_k", F.filter(F.when(F.size("_s") > 1, F.sequence(F.lit(1), F.size("_s") - 1)).otherwise(F.array().cast("array<int>")), as_before))
    at = F.sort_array(F.array_distinct(F.concat(F.transform("_k", lambda k: F.get("_s", k)["3"]), F.transform("_k", lambda k: F.get("_s", k - 1)["3"]))))
    df = df.withColumn("_at", at)
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    step = F.transform("_at", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("_at", k + 1) - x), F.lit(3)))
    some = lambda test: F.size(F.filter("_l", test))
    found = {
        "n_words": n,
        "word_chars": F.length("_j"),
        "n_symbols": sum((F.octet_length("_j") - F.octet_length(F.replace(F.col("_j"), F.lit(x), F.lit(""))) for x in SYMBOLS), F.lit(0)),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l.raw")),
        "n_repeat_words": F.aggregate(step, F.lit(0), lambda s, x: s + x),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(stops))),
        "n_lines": F.size("_l"),
        "n_bullet_lines": some(lambda x: F.substring(x["x"], 1, 1).isin("-", "*", "•")),
        "n_ellipsis_lines": some(lambda x: x["x"].endswith("...") | x["x"].endswith("…")),
    }
    return df.withColumns({k: v.cast("long") for k, v in found.items()}).drop("_w", "_t", "_j", "_l", "_s", "_k", "_at")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


#: Derived metrics, as SQL that Spark and other engines read alike.
RATIOS = {
    "mean_word_chars": _ratio("word_chars", "n_words"),
    "symbol_ratio": _ratio("n_symbols", "word_chars"),
    "stop_word_ratio": _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    "repeat_word_ratio": _ratio("n_repeat_words", "n_words"),
    "bullet_line_ratio": _ratio("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": _ratio("n_ellipsis_lines", "n_lines"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines"]
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def verdict(rules=RULES) -> str:
    """The table as one SQL condition."""
    sides = [(f"({RATIOS.get(r.metric, r.metric)})", op, x) for r in rules for op, x in ((">=", r.least), ("<=", r.most)) if x is not None]
    return " AND ".join(f"{m} {op} {x!r}" for m, op, x in sides) or "TRUE"


def annotate(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """df with the counts, `base_failed` and `kept`; these replace columns of the same names (names match case-insensitively)."""
    made = {c.lower() for c in [*COUNTS, "base_failed", "kept"]}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    held = {c: f"_in{i}" for i, c in enumerate(c for c in df.columns if c.lower() not in made)}
    counted = _counted(df.select(*[c.alias(k) for c, k in zip(rest, held.values())], F.col(f"`{text}`").alias("_text")), "_text")
    counted = counted.select(*[F.col(k).alias(c) for c, k in held.items()], *COUNTS)
    judged = counted.withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", F.expr(f"NOT ({BASE_FAILED}) AND {verdict(rules)}"))


def score(df: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept."""
    return annotate(df.select("doc_id", "text"), "text", rules).select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])


def oracle(rules=RULES) -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    ws = r"' \t\n\x0b\f\r'".replace("\\t", "' || chr(9) || '").replace("\\n", "' || chr(10) || '").replace("\\x0b", "' || chr(11) || '").replace("\\f", "' || chr(12) || '").replace("\\r", "' || chr(13) || '")
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, r, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
win AS (SELECT r, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g
        FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, raw, trim(raw, {ws}) AS x FROM (SELECT r, unnest(string_split(text, chr(10))) AS raw FROM t)),
la AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT raw) AS n_dup_lines,
              count(*) FILTER (substr(x, 1, 1) IN ('-', '*', '•')) AS n_bullet_lines,
              count(*) FILTER (x LIKE '%...' OR x LIKE '%…') AS n_ellipsis_lines
       FROM ln WHERE x <> '' GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(array_to_string(words, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_bullet_lines, 0) AS BIGINT) AS n_bullet_lines,
             CAST(coalesce(n_ellipsis_lines, 0) AS BIGINT) AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (r) LEFT JOIN la USING (r))
SELECT *, ({BASE_FAILED}) AS base_failed, (NOT ({BASE_FAILED}) AND {verdict(rules)}) AS kept FROM m
"""
