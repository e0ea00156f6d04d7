"""Secret scans: patterns of assigned and known keys, and sliding-window entropy per character class, in DataFrame functions.

The plan is a scan and projections: no shuffle, no Python. A text is split at a pattern and the matches are taken out beside
the pieces, so that running lengths give each match its place in code points; both are one pass of the text.

Entropy. A class is an alphabet with a window, a least entropy and kinds of characters that a candidate must mix. Candidates
are the runs of the alphabet at least a window long. One fold over a candidate's characters keeps the counts in the window and
the sum of c log2 c over them: the character that enters and the one that leaves change one term each. Terms are integers (a
fixed-point table), so the sum doesn't drift and the outcome is the same everywhere. Entropy is log2 w - sum / w; windows of at
least the class's entropy that touch are one span. Candidates on the allow-list, by themselves or by what stands before them,
are suppressed; what the patterns find never is.

Defined results: a null or empty text has no spans; repeated rows and null ids are scanned row by row; a text without blanks is
one candidate, whatever its length, in time of its length; an empty table gives an empty result. `annotate` replaces a column
`spans` and passes all others through; `scan` ignores further columns.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_case(words: str) -> str:
    """A pattern with each ASCII letter in both cases, which no engine folds beyond ASCII."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c in string.ascii_letters else c for c in words)


#: (kind, pattern, group whose length counts, its least length). Fixed by the contract.
PATTERNS = (
    ("assign", f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


@dataclass(frozen=True)
class CharacterClass:
    """Runs of `alphabet` (`run` as a pattern's class) of at least `window` characters with a window of `least` bits a character;
    a candidate must have a match of each pattern in `mixed`."""

    kind: str
    alphabet: str
    run: str
    window: int
    least: float
    mixed: tuple[str, ...] = ()


CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdefABCDEF", "[0-9A-Fa-f]", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("entropy_base64", string.ascii_letters + string.digits + "+/_=-", "[A-Za-z0-9+/_=-]", 20, 3.7, ("[0-9]", "[a-z]", "[A-Z]")),
)

#: Candidates that are known to be no secrets: placeholders, runs of an alphabet, and identifiers of the form of a UUID.
ALLOWED = (
    "EXAMPLE|example|SAMPLE|sample|PLACEHOLDER|placeholder",
    "abcdefghij|ABCDEFGHIJ|0123456789",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: What stands right before such a candidate: names of digests, and the start of an address.
ALLOWED_BEFORE = (f"({either_case('sha-?[0-9]+|md5|checksum|digest|fingerprint|commit|integrity|etag')})[\"']?\\x20*[:=-]?\\x20*[\"']?$", "://[^ \\t\\n\"'<>]*$")
#: Code points before a candidate that are looked at.
BEFORE = 40
#: Fixed-point scale of c log2 c.
SCALE = 1_000_000

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>"


def _terms(window: int) -> list[int]:
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def _most(c: CharacterClass) -> int:
    """The greatest sum of c log2 c at which a window still has the class's entropy."""
    return math.floor(c.window * (math.log2(c.window) - c.least) * SCALE)


def located(df: DataFrame, text: str, pattern: str, group: int, to: str) -> DataFrame:
    """df with `to`: an array of (start, found, counted, before) for each match of the pattern, leftmost first and not
    overlapping: its place, itself, its group and the end of the piece before it."""
    c = F.col(text)
    df = df.withColumn("_m", F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    some = F.size("_m") > 0
    df = df.withColumns({"_p": F.when(some, F.split(c, pattern, -1)), "_g": F.when(some, F.regexp_extract_all(c, F.lit(pattern), F.lit(group))) if group else F.col("_m")})
    empty = F.array().cast("array<struct<start:bigint,found:string,counted:string,before:string>>")

    def step(acc: Column, i: Column) -> Column:
        piece, match = F.get("_p", i), F.get("_m", i)
        start = acc["at"] + F.length(piece)
        before = F.substring(piece, -BEFORE, BEFORE)
        before = F.when(F.length(piece) >= BEFORE, before).otherwise(piece)
        one = F.struct(start.alias("start"), match.alias("found"), F.get("_g", i).alias("counted"), before.alias("before"))
        return F.struct((start + F.length(match)).cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size("_m") - 1), F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return df.withColumn(to, F.when(some, walked).otherwise(empty)).drop("_m", "_p", "_g")


def _candidate_windows(found: Column, c: CharacterClass) -> Column:
    """(from, upto) of the stretches of a candidate that windows of enough entropy cover."""
    w, terms, most = c.window, F.array(*[F.lit(x) for x in _terms(c.window)]), _most(c)
    at = F.transform(F.filter(F.split(found, ""), lambda x: x != ""), lambda x: F.instr(F.lit(c.alphabet), x) - 1)
    none = F.array().cast("array<struct<from:int,upto:int>>")
    counts = F.array_repeat(F.lit(0), len(c.alphabet))
    start = F.struct(at.alias("code"), counts.alias("n"), F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("from"), F.lit(-1).alias("upto"), none.alias("out"))
    span = lambda acc: F.struct(acc["from"].alias("from"), acc["upto"].alias("upto"))

    def step(acc: Column, i: Column) -> Column:
        came, left = F.get(acc["code"], i), F.when(i >= w, F.get(acc["code"], i - w)).otherwise(F.lit(-1))
        more, less = F.get(acc["n"], came), F.get(acc["n"], F.greatest(left, F.lit(0)))
        gain = F.get(terms, more + 1) - F.get(terms, more)
        loss = F.when(left >= 0, F.get(terms, less - 1) - F.get(terms, less)).otherwise(F.lit(0))
        same = came == left
        n = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda x, k: x + F.when(k == came, 1).when(k == left, -1).otherwise(0)))
        total = F.when(same, acc["sum"]).otherwise(acc["sum"] + gain + loss)
        high = (i >= w - 1) & (total <= most)
        apart = high & (acc["upto"] >= 0) & (i - w + 1 > acc["upto"])
        opened = F.when(high & ((acc["upto"] < 0) | apart), i - w + 1).otherwise(acc["from"])
        return F.struct(
            acc["code"].alias("code"), n.alias("n"), total.cast("bigint").alias("sum"), opened.alias("from"), F.when(high, i + 1).otherwise(acc["upto"]).alias("upto"),
            F.when(apart, F.concat(acc["out"], F.array(span(acc)))).otherwise(acc["out"]).alias("out"),
        )

    last = lambda acc: F.when(acc["upto"] >= 0, F.concat(acc["out"], F.array(span(acc)))).otherwise(acc["out"])
    return F.aggregate(F.sequence(F.lit(0), F.length(found) - 1), start, step, last)


def _suspect(x: Column, c: CharacterClass, allowed, allowed_before) -> Column:
    """Whether a candidate mixes the kinds of characters that its class asks for and isn't on the allow-list."""
    ok = F.lit(True)
    for p in c.mixed:
        ok = ok & x["found"].rlike(p)
    for p in allowed:
        ok = ok & ~x["found"].rlike(p)
    for p in allowed_before:
        ok = ok & ~x["before"].rlike(p)
    return ok


def _span(rank: int, kind: str, start: Column, end: Column, found: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), found.alias("found"))


def _pattern_spans(matches: Column, rank: int, kind: str, least: int) -> Column:
    long = F.filter(matches, lambda x: F.length(x["counted"]) >= least)
    return F.transform(long, lambda x: _span(rank, kind, x["start"], x["start"] + F.length(x["found"]), x["found"])).cast(SPAN)


def _class_windows(matches: Column, c: CharacterClass, allowed, allowed_before) -> Column:
    suspects = F.filter(matches, lambda x: _suspect(x, c, allowed, allowed_before))
    return F.transform(suspects, lambda x: F.struct(x["start"].alias("start"), x["found"].alias("found"), _candidate_windows(x["found"], c).alias("w")))


def _class_spans(candidates: Column, rank: int, kind: str) -> Column:
    def of(x: Column) -> Column:
        return F.transform(x["w"], lambda s: _span(rank, kind, x["start"] + s["from"], x["start"] + s["upto"], F.substr(x["found"], s["from"] + 1, s["upto"] - s["from"])))

    return F.flatten(F.transform(candidates, of)).cast(SPAN)


def annotate(df: DataFrame, text: str = "text", classes=CLASSES, allowed=ALLOWED, allowed_before=ALLOWED_BEFORE) -> DataFrame:
    """df with `spans`: structs (start, rank, end, kind, found) in order, of patterns (rank by their place) and classes (after
    the patterns). Places are code points, end exclusive."""
    rest = [c for c in df.columns if c.lower() != "spans"]
    inner = df.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(rest)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        whole = f"{pattern.removesuffix('+')}{{{least},}}" if kind == "hex" else pattern  # a run is a match from its start to its end
        inner = located(inner, "_text", whole, group, f"_s{rank}")
        parts.append(_pattern_spans(F.col(f"_s{rank}"), rank, kind, least))
    for rank, c in enumerate(classes, len(PATTERNS)):
        inner = located(inner, "_text", f"{c.run}{{{c.window},}}", 0, f"_s{rank}")
        inner = inner.withColumn(f"_w{rank}", _class_windows(F.col(f"_s{rank}"), c, allowed, allowed_before))
        parts.append(_class_spans(F.col(f"_w{rank}"), rank, c.kind))
    return inner.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(rest)], F.array_sort(F.concat(*parts)).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(df: DataFrame, **given) -> DataFrame:
    """One row per document: doc_id, the number of spans of each pattern, a hash of these, all spans, and the number of those
    that entropy found."""
    found = annotate(df.select("doc_id", "text"), "text", **given)
    base = lambda x: x["rank"] < len(PATTERNS)

    def number(rank: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")

    counts = [number(r).alias(f"n_{kind}") for r, (kind, *_) in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(told(F.filter("spans", base)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: ~base(x))).cast("long").alias("n_entropy"))


def oracle(classes=CLASSES, allowed=ALLOWED, allowed_before=ALLOWED_BEFORE) -> str:
    """The same in SQL: windows are laid out as rows and their characters counted anew."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    found, tests = [], []
    places = """SELECT r, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, m[i] AS found, g[i] AS counted, p[i] AS piece
  FROM (SELECT r, p, m, g, unnest(generate_series(1, len(m))) AS i FROM (SELECT r, string_split_regex(text, {p}) AS p, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {g}) AS g FROM t))"""
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        found.append(f"SELECT r, start, {rank} AS rank, start + length(found) AS e, '{kind}' AS kind FROM ({places.format(p=q(pattern), g=group)}) WHERE length(counted) >= {least}")
    for i, c in enumerate(classes):
        rank = len(PATTERNS) + i
        ok = " AND ".join([f"regexp_matches(found, {q(p)})" for p in c.mixed] + [f"NOT regexp_matches(found, {q(p)})" for p in allowed] + [f"NOT regexp_matches(right(piece, {BEFORE}), {q(p)})" for p in allowed_before])
        tests.append(f"SELECT {rank} AS rank, '{c.kind}' AS kind, {c.window} AS w, {_most(c)} AS most, r, start, found FROM ({places.format(p=q(f'{c.run}{{{c.window},}}'), g=0)}) WHERE {ok}")
    terms = f"{_terms(max(c.window for c in classes))}::BIGINT[]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cand AS (SELECT row_number() OVER () AS k, * FROM ({" UNION ALL ".join(tests)})),
win AS (SELECT k, any_value(rank) AS rank, any_value(kind) AS kind, any_value(w) AS w, any_value(r) AS r, any_value(start) AS start, i, sum(term) AS total, any_value(most) AS most
  FROM (SELECT k, i, c, any_value(rank) AS rank, any_value(kind) AS kind, any_value(w) AS w, any_value(r) AS r, any_value(start) AS start, any_value(most) AS most, ({terms})[count(*) + 1] AS term
        FROM (SELECT *, substr(found, i + j, 1) AS c FROM (SELECT *, unnest(range(1, w + 1)) AS j FROM (SELECT *, unnest(range(0, length(found) - w + 1)) AS i FROM cand))) GROUP BY k, i, c) GROUP BY k, i),
high AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + w THEN 0 ELSE 1 END AS fresh FROM win WHERE total <= most),
part AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS s FROM high),
spans AS ({" UNION ALL ".join(found)}
  UNION ALL SELECT any_value(r), any_value(start) + min(i), any_value(rank), any_value(start) + max(i) + any_value(w), any_value(kind) FROM part GROUP BY k, s),
agg AS (SELECT r, {", ".join(f"count(*) FILTER (rank = {n}) AS n_{kind}" for n, (kind, *_) in enumerate(PATTERNS))}, count(*) FILTER (rank >= {len(PATTERNS)}) AS n_entropy,
  string_agg(kind || ':' || start::BIGINT || ':' || e::BIGINT, ',' ORDER BY start, rank, e) FILTER (rank < {len(PATTERNS)}) AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || e::BIGINT, ',' ORDER BY start, rank, e) AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM t LEFT JOIN agg USING (r)
"""
