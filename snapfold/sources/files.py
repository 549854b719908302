"""File sources: strict CSV, schedules in CSV or JSON, game logs, manifests, binary documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.functions import dates
from snapfold.functions.text import row_identity

TRANSACTION = ("Date", "Team", "Acquired", "Relinquished", "Notes")
DAYS = ("yyyy-M-d", "M/d/yyyy", "M/d/yy")


def _strict(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_bad")])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def transactions(spark: SparkSession, path: str, source_type: str) -> tuple[DataFrame, DataFrame]:
    """(rows, invalid): rows of the five-column CSV with a date and an identity, and those too short, too long or undated."""
    raw = _strict(spark, path, TRANSACTION)
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in TRANSACTION[1:]}
    day = dates.parse(F.trim("Date"), *DAYS)
    good = F.col("_bad").isNull() & day.isNotNull()
    rows = raw.where(good).select(day.alias("transaction_date"), *(v.alias(c.lower()) for c, v in text.items()), F.lit(source_type).alias("source_type"))
    names = [c.lower() for c in TRANSACTION[1:]]
    key = row_identity(F.lit("v1"), F.col("source_type"), F.col("transaction_date").cast("string"), *map(F.col, names))
    return rows.withColumn("source_row_key", key), raw.where(~good)


def schedule_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, invalid) of the normalised schedule: trimmed, ISO dates only."""
    columns = ("season", "game_date", "season_type", "away_team", "home_team", "matchup")
    raw = _strict(spark, path, columns)
    trimmed = raw.select(*(F.trim(c).alias(c) for c in columns), "_bad").withColumn("game_date", dates.parse(F.when(F.col("game_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("game_date")), "yyyy-MM-dd"))
    good = F.col("_bad").isNull() & F.col("game_date").isNotNull() & (F.col("matchup") != "")
    return trimmed.where(good).drop("_bad"), trimmed.where(~good)


SEASON_TYPES = ("preseason", "regular", "play_in", "playoffs")  # fixed values


def reference_schedule(spark: SparkSession, path: str, season: str | None = None) -> DataFrame:
    """A normalised schedule of one season, or all. A season type of another name is an error."""
    rows, _ = schedule_csv(spark, path)
    rows = rows if season is None else rows.where(F.col("season") == season)
    known = F.when(F.col("season_type").isin(*SEASON_TYPES), F.col("season_type")).otherwise(F.raise_error(F.concat(F.lit("unknown season type "), F.coalesce("season_type", F.lit("null")))))
    return rows.withColumn("season_type", known)


def build_schedule(raw: DataFrame) -> DataFrame:
    """The normalised schedule of rows with a day, two teams and a kind, by any of their spellings, in order.

    Unknown kinds, unread days and games that stand there twice are errors. "play-in" is known, "Play In" is not.
    """
    pick = lambda *names: F.trim(F.coalesce(*(F.col(n) for n in names if n in raw.columns), F.lit(None).cast("string")).cast("string"))
    day = dates.parse(pick("game_date", "date", "Date"), "yyyy-M-d", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy")
    kind = F.replace(F.replace(F.lower(pick("season_type", "type", "Type")), F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))
    rows = raw.select(day.alias("game_date"), kind.alias("season_type"), pick("away_team", "away", "Away").alias("away_team"), pick("home_team", "home", "Home").alias("home_team"))
    fine = F.col("game_date").isNotNull() & F.coalesce(F.col("season_type").isin(*SEASON_TYPES), F.lit(False))
    rows = rows.withColumn("season_type", F.when(fine, F.col("season_type")).otherwise(F.raise_error(F.lit("a game without a day or a known season type"))))
    rows = rows.select(dates.season(F.col("game_date"), 9).alias("season"), "game_date", "season_type", "away_team", "home_team", F.concat("away_team", F.lit("@"), "home_team").alias("matchup"))
    twice = rows.groupBy("game_date", "matchup").agg(F.count("*").alias("n"), F.first(F.struct(*rows.columns)).alias("x"))
    once = twice.select(F.when(F.col("n") == 1, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("a game stands there twice: "), F.col("game_date").cast("string"), F.lit(" "), "matchup"))).alias("x"))
    return once.select("x.*").orderBy("season", "game_date", "matchup")


def write_schedule(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Distinct addresses of a saved list: one a line, without query and fragment; blank lines, notes (#) and others go."""
    line = spark.read.text(path).select(F.trim("value").alias("url")).where(F.startswith("url", F.lit("https://")))
    return line.select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct()


def query_url(base: str, **arguments: Column) -> Column:
    """An address with encoded arguments, in the order given."""
    parts = [F.concat(F.lit(f"{name}="), F.url_encode(value.cast("string"))) for name, value in arguments.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def catalogued(spark: SparkSession, prefix: str = "") -> DataFrame:
    """(name, columns) of the catalog's tables whose name starts with prefix; only names and schemas are read."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
    return spark.createDataFrame([(n, len(spark.table(n).columns)) for n in names], "name string, columns int")


def mixed_schedule(spark: SparkSession, path: str) -> DataFrame:
    """A schedule in CSV, or JSON as a list or under games, schedule or data; columns by any of their spellings."""
    if path.endswith(".json"):
        raw = spark.read.json(path, multiLine=True)
        under = [c for c in ("games", "schedule", "data") if c in raw.columns]
        df = raw.select(F.inline(F.coalesce(*under))) if under else raw
    else:
        df = spark.read.csv(path, header=True)
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in df.columns), F.lit(None).cast("string"))
    return df.select(
        dates.parse(pick("game_date", "date", "Date").cast("string"), "yyyy-M-d", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy").alias("game_date"),
        pick("away_team", "away", "Away").alias("away_team"), pick("home_team", "home", "Home").alias("home_team"),
        F.replace(F.lower(F.trim(pick("season_type", "type", "Type"))), F.lit(" "), F.lit("_")).alias("season_type"),
    )


def games(log: DataFrame) -> DataFrame:
    """One row a game from a log of two rows a game. Games of any other number, or whose matchup names other teams, go."""
    matchup = r"^\s*([A-Z]{3})\s*(@|vs\.)\s*([A-Z]{3})\s*$"
    a, sign, b = (F.regexp_extract("MATCHUP", matchup, i) for i in (1, 2, 3))
    row = F.struct(F.when(sign == "@", a).otherwise(b).alias("away"), F.when(sign == "@", b).otherwise(a).alias("home"))
    found = log.withColumn("pair", F.when(sign != "", row)).groupBy("GAME_ID").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("TEAM_ABBREVIATION")).alias("teams"), F.first("pair", ignorenulls=True).alias("pair"), F.min("GAME_DATE").alias("day")
    )
    ok = (F.col("n") == 2) & F.col("pair").isNotNull() & (F.sort_array(F.array("pair.away", "pair.home")) == F.col("teams"))
    day = dates.parse("day", "yyyy-M-d", "MMM d, yyyy")
    return found.where(ok).select(F.col("GAME_ID").alias("game_id"), day.alias("game_date"), "pair.away", "pair.home", F.concat("pair.away", F.lit("@"), "pair.home").alias("matchup"), dates.season(day, 9).alias("season"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Binary documents by content: content_hash, content, and all paths that hold it."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("content_hash"))
    first = raw.groupBy("content_hash").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return first.join(raw.select("content_hash", "path", "content"), (first.content_hash == raw.content_hash) & (F.element_at("paths", 1) == raw.path)).select(first.content_hash, "paths", "content")


def url_inventory(spark: SparkSession, first: str, last: str, base: str, dense_from: str) -> DataFrame:
    """Addresses that reports of each day may have: by hour, from ``dense_from`` on by quarter of an hour as well."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    minutes = F.when(F.col("day") >= F.lit(dense_from).cast("date"), F.array(*map(F.lit, ("_00", "_15", "_30", "_45")))).otherwise(F.array(F.lit("")))
    hours = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda h: F.lpad(h.cast("string"), 2, "0"))
    each = days.withColumn("minute", F.explode(minutes)).withColumn("hour", F.explode(hours)).withColumn("half", F.explode(F.array(F.lit("AM"), F.lit("PM"))))
    url = F.concat(F.lit(base), F.col("day").cast("string"), F.lit("_"), "hour", "minute", "half", F.lit(".pdf"))
    return each.select("day", url.alias("url"), dates.url_time(url).alias("published"))
