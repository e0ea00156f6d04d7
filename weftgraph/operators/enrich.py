"""Enrichment of nodes: extensions, dates in names, reactor channels and their grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row letters, columns, corner exclusions and the patterns of the two grids.
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXY"
LAST_COLUMN = 25
EXCLUDED = ("A01", "A02", "A23", "A24", "Y01", "Y02", "Y23", "Y24")
LETTER_CHANNEL = r"^[A-Y](?:0[1-9]|1[0-9]|2[0-5])$"
FOUR_DIGITS = r"^(?:0[2-9]|[1-4][0-9]|5[2-9]|[6-9][0-9])(?:[0-9][0-9])$"
GRID_WIDTH, GRID_HEIGHT = 24, 25

# --- files


def extension_counts(files: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """files(node_id, name) -> (extension, n, share), those of `known` only if it names any."""
    x = files.select(F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).filter("extension <> ''")
    x = x.filter(F.col("extension").isin(*known)) if known else x
    g = x.groupBy("extension").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("extension", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# --- dates in tokens


def _digits(c: Column, a: int, n: int) -> Column:
    return F.substring(c, a, n).try_cast("int")


def date_tokens(tokens: DataFrame) -> DataFrame:
    """tokens(token, parent, sibling_dates, sibling_times) -> token, kind and its date or time parts.

    Eight digits are a date if month and day can be one; HH:MM(:SS) is a time, 20YY a year. Six digits are a date if the
    parent holds a date, if more siblings look like dates than like times, or if they begin with 20 to 30; else a time.
    """
    t = F.col("token")
    month, day = _digits(t, 5, 2), _digits(t, 7, 2)
    long = t.rlike(r"^20\d{6}$") & month.between(1, 12) & day.between(1, 31)
    clock = t.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    parent = F.coalesce(F.col("parent"), F.lit(""))
    likely = parent.rlike(r"20\d{6}|\d{2}[-_/]\d{2}[-_/]\d{2}") | (F.col("sibling_dates") > F.col("sibling_times")) | _digits(t, 1, 2).between(20, 30)
    six = t.rlike(r"^\d{6}$")
    as_date = six & likely & _digits(t, 3, 2).between(1, 12) & _digits(t, 5, 2).between(1, 31)
    as_time = six & ~likely & (_digits(t, 1, 2) < 24) & (_digits(t, 3, 2) < 60) & (_digits(t, 5, 2) < 60)
    kind = F.when(long, "date").when(clock, "time").when(t.rlike(r"^20\d{2}$"), "year").when(as_date, "date").when(as_time, "time")
    text = F.when(long, F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    text = text.when(as_date, F.concat_ws("-", F.concat(F.lit("20"), F.substring(t, 1, 2)), F.substring(t, 3, 2), F.substring(t, 5, 2)))
    text = text.when(as_time, F.concat_ws(":", F.substring(t, 1, 2), F.substring(t, 3, 2), F.substring(t, 5, 2))).otherwise(t)
    return tokens.select("token", kind.alias("kind"), text.alias("text")).filter("kind IS NOT NULL")


def merged_timestamps(found: DataFrame) -> DataFrame:
    """found(parent, kind, text) -> a date and a time of one parent as one timestamp, the least of each."""
    g = found.groupBy("parent").agg(F.min(F.when(F.col("kind") == "date", F.col("text"))).alias("d"), F.min(F.when(F.col("kind") == "time", F.col("text"))).alias("t"))
    return g.filter("d IS NOT NULL AND t IS NOT NULL").select("parent", F.concat_ws(" ", "d", "t").alias("stamp"))


def older_dates(tokens: DataFrame) -> DataFrame:
    """tokens(token) -> kind and confidence by the older rules: YYYYMMDD and YYMMDD .9, HHMMSS .9, YYYY .7."""
    t = F.col("token")
    eight = t.rlike(r"^20\d{6}$") & _digits(t, 5, 2).between(1, 12) & _digits(t, 7, 2).between(1, 31)
    six = t.rlike(r"^\d{6}$") & _digits(t, 3, 2).between(1, 12) & _digits(t, 5, 2).between(1, 31)
    clock = t.rlike(r"^([01]\d|2[0-3])[0-5]\d[0-5]\d$")
    year = t.rlike(r"^(19|20)\d{2}$")
    kind = F.when(eight, "YYYYMMDD").when(six, "YYMMDD").when(clock, "HHMMSS").when(year, "YYYY")
    return tokens.select("token", kind.alias("kind"), F.when(year, 0.7).otherwise(0.9).alias("confidence")).filter("kind IS NOT NULL")


# --- channels


def channels(tokens: DataFrame) -> DataFrame:
    """tokens(token) -> channel_id, reactor and confidence, one row per channel."""
    t = F.upper("token")
    reactor = F.when(t.rlike(LETTER_CHANNEL), "CANDU").when(t.rlike(FOUR_DIGITS), "AGR").when(t.rlike(r"^[A-Z]\d{2,3}$") | t.rlike(r"^[A-Z]-\d{2,3}$"), "letter").when(t.rlike(r"^\d{4}$"), "digits")
    confidence = F.when(reactor.isin("CANDU", "AGR"), 0.95).when(reactor == "letter", 0.8).otherwise(0.7)
    x = tokens.select(t.alias("channel_id"), reactor.alias("reactor"), confidence.alias("confidence")).filter("reactor IS NOT NULL")
    return x.groupBy("channel_id", "reactor", "confidence").agg(F.count("*").alias("n"))


def letter_grid(spark: SparkSession) -> DataFrame:
    """Positions of the letter grid without its excluded corners."""
    rows = spark.range(len(ROW_LETTERS)).select(F.substring(F.lit(ROW_LETTERS), F.col("id").cast("int") + 1, F.lit(1)).alias("letter"), F.col("id").alias("row"))
    x = rows.select("letter", "row", F.explode(F.sequence(F.lit(1), F.lit(LAST_COLUMN))).alias("column"))
    x = x.withColumn("channel_id", F.concat("letter", F.lpad(F.col("column").cast("string"), 2, "0")))
    return x.filter(~F.col("channel_id").isin(*EXCLUDED)).select("channel_id", F.col("row").cast("int").alias("row"), "column")


def even_grid(spark: SparkSession) -> DataFrame:
    """Positions with even rows and columns from 2 to 98 but 50."""
    even = [x for x in range(2, 99, 2) if x != 50]
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in even])).alias("row"))
    x = rows.select("row", F.explode(F.array(*[F.lit(c) for c in even])).alias("column"))
    return x.select(F.format_string("%02d%02d", "row", "column").alias("channel_id"), "row", "column")
