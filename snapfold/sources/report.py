"""Report documents to entry rows, from positioned words: lines, header layouts, cells, inherited context and fragments.

Every step is a column expression or a window over one document; nothing is parsed row by row. words has
(doc_id, page, x0, top, text), one row a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.functions.text import collapse, reason_parts
from snapfold.sources import layout

# How a report says when it is from, what stands for a whole team, statuses, and how far a team's second line lies below its first.
STAMP = r"(?i)Injury\s*Report:\s*(\d{2}/\d{2}/\d{2})\s+(\d{1,2}:\d{2})\s*([AP]M)"
NONE_YET, ALL_IN = "NOT YET SUBMITTED", "ALL PLAYERS AVAILABLE"
STATUSES = ("Available", "Probable", "Questionable", "Doubtful", "Out")
TEAM_WRAP = 10.0
#: Words of a column's header that begin it, left of its cells by this much at most.
SLACK = 2.0
#: A player's column that begins beyond this is of the compact layout.
COMPACT = 400
FIELDS = ("date", "time", "matchup", "team", "player", "category", "reason", "status", "previous_status", "previous_reason")


def page_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, top, words, raw): the lines of each page from its top, words from the left."""
    placed = layout.lines(words)
    word = F.struct("x0", "text")
    grouped = placed.groupBy("doc_id", "page", "line").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(word)).alias("words"))
    return grouped.withColumn("raw", collapse(F.array_join(F.transform("words", lambda w: w["text"]), " ")))


def _starts(words: Column, text: str) -> Column:
    """Where the words of a text begin, from the left."""
    return F.transform(F.filter(words, lambda w: w["text"] == text), lambda w: w["x0"] - SLACK)


def header(words: Column, raw: Column) -> Column:
    """struct(version, columns array<struct<x, name>>) of a header line; null if it is none, columns null if it lacks one."""
    at = {name: _starts(words, name) for name in ("Game", "Matchup", "Team", "Player", "Category", "Reason", "Current", "Previous")}
    nth = lambda name, i=1: F.try_element_at(at[name], F.lit(i))
    places = {"date": nth("Game"), "time": nth("Game", 2), "matchup": nth("Matchup"), "team": nth("Team"), "player": nth("Player"), "status": nth("Current"), "reason": nth("Reason")}
    reasons, previous = F.size(at["Reason"]), F.size(at["Previous"])
    extra = lambda **more: F.array(*(F.struct(x.alias("x"), F.lit(n).alias("name")) for n, x in (places | more).items()))
    layouts = [
        (F.size(at["Category"]) > 0, F.lit("legacy-category-v1"), extra(category=nth("Category"), previous_status=nth("Previous"))),
        ((previous == 2) & (reasons == 2), F.lit("legacy-status-history-v1b"), extra(previous_status=nth("Previous"), previous_reason=nth("Previous", 2))),
        ((previous == 1) & (reasons == 1), F.when(nth("Reason") < nth("Current"), "legacy-reason-first-v1c").otherwise("legacy-current-previous-v1d"), extra(previous_status=nth("Previous"))),
        (previous == 0, F.when(nth("Player") > COMPACT, "compact-v3").otherwise("standard-v2"), extra()),
    ]
    found = F.coalesce(*(F.when(ok, F.struct(version.alias("version"), F.array_sort(columns).alias("columns"))) for ok, version, columns in layouts))
    whole = F.forall(found["columns"], lambda c: c["x"].isNotNull())
    return F.when(F.contains(raw, F.lit("Game Date")) & F.contains(raw, F.lit("Player Name")), F.struct(F.when(whole, found["version"]).alias("version"), F.when(whole, found["columns"]).alias("columns")))


def _cells(words: Column, columns: Column) -> Column:
    """Text by column: a word belongs to the last column that begins left of it, or to the first."""
    place = lambda w: F.greatest(F.size(F.filter(columns, lambda c: c["x"] <= w["x0"])), F.lit(1))
    cell = lambda k: collapse(F.array_join(F.transform(F.filter(words, lambda w: place(w) == k + 1), lambda w: w["text"]), " "))
    return F.map_from_entries(F.transform(columns, lambda c, k: F.struct(c["name"].alias("name"), cell(k).alias("text"))))


def placed_lines(words: DataFrame) -> DataFrame:
    """Data lines of all documents with their cells by column, the layout's version and whether they begin an entry.

    A page without a header goes by the last one before it; lines above a page's own header, page numbers and the
    report's time are no data.
    """
    lines = page_lines(words).withColumn("header", header(F.col("words"), F.col("raw")))
    pages = lines.groupBy("doc_id", "page").agg(F.min_by("header", F.when(F.col("header").isNotNull(), F.col("line"))).alias("own"), F.min(F.when(F.col("header").isNotNull(), F.col("line"))).alias("header_line"))
    before = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow)
    pages = pages.withColumn("layout", F.last("own", ignorenulls=True).over(before)).select("doc_id", "page", "layout", "header_line")
    data = lines.drop("header").join(pages, ["doc_id", "page"]).where(F.col("layout.columns").isNotNull() & (F.col("line") > F.coalesce("header_line", F.lit(-1))))
    data = data.where((F.col("raw") != "") & ~F.col("raw").rlike(r"^Page \d+ of \d+$") & ~F.col("raw").rlike(STAMP))
    values = _cells(F.col("words"), F.col("layout.columns"))
    data = data.withColumn("cell", values).select("doc_id", "page", "line", "top", "raw", F.col("layout.version").alias("version"), *(F.coalesce(F.col("cell")[f], F.lit("")).alias(f) for f in FIELDS))
    whole = F.upper("raw").contains(NONE_YET) | F.upper("raw").contains(ALL_IN)
    return data.withColumn("begins", ((F.col("player") != "") & (F.col("status") != "")) | whole)


def _joined(words: DataFrame) -> DataFrame:
    """Entries put together from their lines, with ``whole``: whether they have a player, if they need one, and a game."""
    order = W.partitionBy("doc_id").orderBy("page", "line")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    anchor = F.when(F.col("begins"), F.struct("page", "top"))
    lines = placed_lines(words).withColumns({"above": F.last(anchor, ignorenulls=True).over(so_far), "below": F.first(anchor, ignorenulls=True).over(rest), "entry": F.count_if("begins").over(so_far)})
    apart = lambda side: F.when(F.col(f"{side}.page") == F.col("page"), F.abs(F.col("top") - F.col(f"{side}.top"))).otherwise(float("inf"))
    alone = F.lit(True)
    for f in FIELDS:
        alone = alone & ((F.col(f) != "") if f == "team" else (F.col(f) == ""))
    down = F.col("top") - F.col("above.top")
    lines = lines.withColumn("wraps", ~F.col("begins") & alone & F.coalesce((F.col("above.page") == F.col("page")) & (down > 0) & (down <= TEAM_WRAP), F.lit(False)))

    held = {"date": layout.is_date(F.col("date")), "time": layout.is_time(F.col("time")), "matchup": layout.is_matchup(F.col("matchup")), "team": (F.col("team") != "") & ~F.col("wraps")}
    lines = lines.withColumns({f"game_{f}": F.last(F.when(ok, F.col(f)), ignorenulls=True).over(so_far) for f, ok in held.items()} | {"spell": F.count_if(held["team"]).over(so_far)})
    # The further lines of a team's name, up to those under the entry itself.
    by_spell = W.partitionBy("doc_id", "spell").orderBy("entry").rangeBetween(W.unboundedPreceding, W.currentRow)
    more = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("wraps"), F.struct("page", "line", "team"))).over(by_spell)), lambda w: w["team"]), " ")
    lines = lines.withColumn("game_team", collapse(F.concat_ws(" ", "game_team", more)))

    up = (F.col("entry") > 0) & (F.col("below").isNull() | (apart("above") <= apart("below")))
    to = F.when(F.col("begins") | F.col("wraps") | up, F.col("entry")).when((F.col("entry") > 0) | (F.col("reason") != "") | (F.col("category") != ""), F.col("entry") + 1)
    part = F.when(F.col("begins"), 0).when(to > F.col("entry"), 1).when(F.col("wraps"), 2).otherwise(3)
    lines = lines.withColumns({"to": to, "part": part}).where("to is not null")
    named = (F.col("player") != "") & ((F.col("begins")) | ((F.col("status") == "") & (F.col("reason") == "")))
    item = F.struct("part", "page", "line", "raw", F.when(named, F.col("player")).otherwise("").alias("player"), "category", "reason", "previous_reason")
    own = lambda c: F.max(F.when(F.col("begins"), F.col(c)))
    joined = lines.groupBy("doc_id", "to").agg(F.array_sort(F.collect_list(item)).alias("items"), *(own(c).alias(c) for c in ("page", "version", "status", "previous_status", "game_date", "game_time", "game_matchup", "game_team")))
    text = lambda c: collapse(F.array_join(F.transform("items", lambda x: x[c]), " "))
    joined = joined.where("page is not null").select("*", text("player").alias("player"), text("raw").alias("raw_row_text"), text("previous_reason").alias("previous_reason"), reason_parts(text("reason"), text("category")).alias("why"), text("category").alias("category"))
    said = F.upper(F.concat_ws(" ", "player", "status", "category", "why.reason"))
    kind = F.when(said.contains(ALL_IN), "all_available").when(said.contains(NONE_YET), "not_submitted").otherwise("player")
    game_day = F.to_date(F.try_to_timestamp("game_date", F.lit("MM/dd/yyyy")))
    in_game = F.col("day").isNotNull() & F.col("game_matchup").isNotNull() & (F.coalesce("game_team", F.lit("")) != "")
    return joined.withColumns({"entry_type": kind, "day": game_day}).withColumn("whole", in_game & ((F.col("entry_type") != "player") | (F.col("player") != "")))


def entries(words: DataFrame) -> DataFrame:
    """One row an entry: doc_id, page_number, row_number, game_date, game_time (seconds), matchup, team, player_name, status,
    reason_category, raw_reason, previous_status, previous_reason, raw_row_text, entry_type, format_version.

    Date, time, matchup and team hold until others follow. A line of a team's name alone, just under an entry, goes on
    with its team. Any other line goes to the nearest entry of its page, of two as near to the one above, and without
    one on its page to the one before. Entries without a player or a game are left out here, and ``documents`` says so.
    """
    good = _joined(words).where("whole")
    is_player, all_in = F.col("entry_type") == "player", F.col("entry_type") == "all_available"
    clock = F.regexp_extract("game_time", r"^(\d{1,2}):(\d{2})", 1).try_cast("int") * 3600 + F.regexp_extract("game_time", r"^(\d{1,2}):(\d{2})", 2).try_cast("int") * 60
    filled = lambda c: F.nullif(c, F.lit(""))
    return good.select(
        "doc_id", F.col("page").alias("page_number"), F.row_number().over(W.partitionBy("doc_id").orderBy("to")).alias("row_number"), F.col("day").alias("game_date"), clock.alias("game_time"),
        F.col("game_matchup").alias("matchup"), F.col("game_team").alias("team"), F.when(is_player, F.col("player")).alias("player_name"), F.when(~all_in, filled(F.col("status"))).alias("status"),
        F.when(~all_in, F.col("why.category")).alias("reason_category"), F.when(all_in, F.lit(ALL_IN)).otherwise(F.col("why.reason")).alias("raw_reason"),
        filled(F.col("previous_status")).alias("previous_status"), filled(F.col("previous_reason")).alias("previous_reason"), "raw_row_text", "entry_type", F.col("version").alias("format_version"),
    )


def date_matchups(words: DataFrame) -> DataFrame:
    """Distinct (doc_id, game_date, matchup) of games that an entry of a player stands for."""
    return entries(words).where((F.col("entry_type") == "player") & F.col("status").isNotNull()).select("doc_id", "game_date", "matchup").distinct()


def documents(words: DataFrame) -> DataFrame:
    """(doc_id, published, format_version, problem) of each document; problem is null where it was read whole.

    A document that cannot be read is a row that says why, and no error of the job.
    """
    lines = page_lines(words).withColumn("header", header(F.col("words"), F.col("raw")))
    stamp = F.when(F.col("raw").rlike(STAMP), F.concat_ws(" ", *(F.regexp_extract("raw", STAMP, i) for i in (1, 2, 3))))
    first = lines.groupBy("doc_id").agg(F.min(F.when(F.col("header").isNotNull(), F.col("page"))).alias("first_header"), F.min("page").alias("first_page"), F.min_by(stamp, F.when(stamp.isNotNull(), F.struct("page", "line"))).alias("stamp"), F.collect_set("header.version").alias("versions"), F.bool_or(F.col("header").isNotNull() & F.col("header.version").isNull()).alias("cut"))
    odd = F.col("whole") & (F.col("entry_type") == "player") & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    made = _joined(words).groupBy("doc_id").agg(F.count_if("whole").alias("n"), F.count_if(~F.col("whole")).alias("lost"), F.count_if(odd).alias("odd"))
    both = first.join(made, "doc_id", "left")
    problem = (
        F.when(F.col("stamp").isNull(), "no time of the report")
        .when(F.coalesce(F.col("first_header") > F.col("first_page"), F.lit(True)), "no table header on the first page")
        .when(F.col("cut"), "incomplete table header")
        .when(F.size("versions") > 1, "several layouts")
        .when(F.col("lost") > 0, "entry without a game, team or player")
        .when(F.coalesce("n", F.lit(0)) == 0, "no entries")
        .when(F.col("odd") > 0, "unknown status")
    )
    return both.select("doc_id", F.try_to_timestamp("stamp", F.lit("MM/dd/yy h:mm a")).alias("published"), F.try_element_at(F.sort_array("versions"), F.lit(1)).alias("format_version"), problem.alias("problem"))
