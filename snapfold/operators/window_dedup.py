"""Greedy de-duplication in time windows whose width depends on the last row kept."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.operators import latest
from snapfold.tables import cut

#: The most days that any of the medical rules below reaches over.
LONGEST = 750
#: Rows of a run that are folded in one array; longer runs are walked by doubling.
MOST = 1024
TEARS = ("tear", "ACL tear", "MCL tear", "PCL tear")


class Follow(NamedTuple):
    """A row of a kind in ``next`` continues a kept one of a kind in ``last`` for so many days, whatever its window."""

    last: tuple[str, ...]
    next: tuple[str, ...]
    days: int
    part: str | None = None


# Fixed values.
MEDICAL = (
    Follow(TEARS, ("surgery",), 180),
    Follow(("tear",), ("achilles injury",), 750, "achilles"),
    Follow(("achilles injury",), ("achilles injury",), 180),
    Follow(("surgery",), ("surgery",), 365),
)


def medical_window(kind: Column, part: Column) -> Column:
    """Days that a kept row of a kind covers."""
    return F.when(kind.isin(*TEARS) & part.isin("knee", "achilles"), 365).when(kind == "surgery", 180).when(kind.isin("achilles injury", "fracture"), 90).otherwise(30)


def window_dedup(df: DataFrame, keys: list[str], day: str, kind: str, tie: str, window=medical_window, follows: tuple[Follow, ...] = MEDICAL, part: str | None = None, longest: int | None = LONGEST, most: int = MOST) -> DataFrame:
    """Keep a row if it lies further from the last kept row of its keys than that row's window and continues it not.

    The first row of a key is kept; suppressed rows move nothing. Rows with a null key or day vanish. ``window`` gives
    the days that a kind covers, 0 at least; ``part`` must be one of the keys. No rule may reach over more than
    ``longest`` days (None: no bound is known).

    A kept row rules out all others of its day, and whether a row is kept depends on its kind only as far as a rule of
    ``follows`` names it. So of a day's rows only the first of each named kind, and the first of all others, can be
    kept: a history has no more candidates than days times kinds, however dense it is. Histories are cut where a gap
    is longer than ``longest``. Runs of at most ``most`` candidates are folded in order; the others are walked by
    ``_doubled``.
    """
    named = sorted({k for f in follows for k in f.next})
    part_ = F.col(part) if part else F.lit(None).cast("string")

    def covers(last: Column, next_: Column) -> Column:
        """Days after a kept row of kind ``last`` in which no row named ``next_`` is kept."""
        days = [F.greatest(window(last, part_).cast("int"), F.lit(0))]
        for f in follows:
            holds = last.isin(*f.last) & next_.isin(*f.next) & (F.lit(True) if f.part is None else part_ == f.part)
            days.append(F.when(F.coalesce(holds, F.lit(False)), F.lit(f.days)))
        return F.greatest(*days) if len(days) > 1 else days[0]

    called = F.when(F.col(kind).isin(*named), F.col(kind)).otherwise("") if named else F.lit("")
    rows = df.dropna(subset=[*keys, day]).select(*keys, F.col(day).cast("date").alias("_day"), called.alias("_named"), F.struct(F.col(tie).alias("tie"), F.col(kind).alias("kind")).alias("_row"))
    first = rows.groupBy(*keys, "_day", "_named").agg(F.min("_row").alias("_row")).select(*keys, "_day", "_named", F.col("_row.tie").alias("_tie"), F.col("_row.kind").alias("_kind"))
    runs = [*keys, "_run"]
    if longest is None:
        numbered = first.withColumn("_run", F.lit(0).cast("long"))
    else:
        numbered = latest.episodes_by_gap(first, keys, "_day", "_tie", longest).withColumnRenamed("episode", "_run")
    numbered = cut(numbered)
    sizes = numbered.groupBy(*runs).agg(F.count("*").alias("_size"))
    long_ = cut(sizes.where(F.col("_size") > most).select(*runs))
    many = not long_.isEmpty()
    short = numbered.join(long_, runs, "left_anti") if many else numbered
    kept = _folded(short, keys, runs, covers)
    if many:
        kept = kept.unionByName(_doubled(numbered.join(long_, runs, "left_semi"), keys, runs, covers, named))
    return kept.select(*keys, F.col("_day").alias(day), F.col("_tie").alias(tie), F.col("_kind").alias(kind))


def _folded(rows: DataFrame, keys: list[str], runs: list[str], covers) -> DataFrame:
    """The rows kept of runs that fit into an array each."""
    folded = rows.groupBy(*runs).agg(F.array_sort(F.collect_list(F.struct("_day", "_tie", "_kind", "_named"))).alias("_rows"))
    start = F.struct(F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("kind"), F.expr("cast(array() as array<int>)").alias("kept"), F.lit(0).alias("at"))

    def step(state: Column, row: Column) -> Column:
        keep = state["day"].isNull() | (F.datediff(row["_day"], state["day"]) > covers(state["kind"], row["_named"]))
        moved = F.struct(row["_day"].alias("day"), row["_kind"].alias("kind"), F.array_append(state["kept"], state["at"]).alias("kept"), (state["at"] + 1).alias("at"))
        return F.when(keep, moved).otherwise(state.withField("at", state["at"] + 1))

    kept = folded.select(*keys, F.inline(F.transform(F.aggregate("_rows", start, step)["kept"], lambda at: F.col("_rows")[at])))
    return kept.select(*keys, "_day", "_tie", "_kind")


def _doubled(rows: DataFrame, keys: list[str], runs: list[str], covers, named: list[str]) -> DataFrame:
    """The rows kept of runs of any length.

    Which row is kept after a row, if that is kept, follows from the row alone: the first one of any name beyond what
    it covers. These pointers make a forest, and the rows kept are the way from each run's first row. A round follows
    the pointers of all rows found so far and then doubles the pointers' length, so the way is known after as many
    rounds as its length has binary digits; no row's task ever holds a run.
    """
    in_order = W.partitionBy(*runs).orderBy("_day", "_tie", "_named")
    rows = cut(rows.withColumn("_at", F.row_number().over(in_order)))
    # For each row and name, the day up to which that name is covered; scanned from the latest day, the last row seen is the first beyond.
    names = F.array(*map(F.lit, ["", *named]))
    asked = rows.withColumn("_for", F.explode(names)).select(*runs, F.col("_for").alias("_named"), F.date_add("_day", covers(F.col("_kind"), F.col("_for"))).alias("_day"), F.lit(None).cast("int").alias("_to"), F.col("_at").alias("_from"))
    there = rows.select(*runs, "_named", "_day", F.col("_at").alias("_to"), F.lit(None).cast("int").alias("_from"))
    back = W.partitionBy(*runs, "_named").orderBy(F.desc("_day"), F.col("_to").asc_nulls_first())
    seen = there.unionByName(asked).withColumn("_to", F.last("_to", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # Places rise with the day and its ties, so the least place is the first row.
    jump = cut(seen.where("_from is not null").groupBy(*runs, F.col("_from").alias("_at")).agg(F.min("_to").alias("_to")).where("_to is not null"))
    found = cut(rows.where("_at = 1").select(*runs, "_at"))
    n = found.count()
    while True:
        onward = found.join(jump, [*runs, "_at"]).select(*runs, F.col("_to").alias("_at"))
        found = cut(found.unionByName(onward).distinct())
        n, before = found.count(), n
        if n == before:
            break
        jump = cut(jump.join(jump.select(*runs, F.col("_at").alias("_to"), F.col("_to").alias("_then")), [*runs, "_to"]).select(*runs, "_at", F.col("_then").alias("_to")))
    return rows.join(found, [*runs, "_at"]).select(*keys, "_day", "_tie", "_kind")
