"""Mix sources to target weights by entropy balancing, all in DataFrame operations.

A document's rate r lies between 0 and ``most``. The rates of a source have the least relative entropy to one copy each,

    sum_i r_i log r_i + (most - r_i) log((most - r_i) / (most - 1)),

among those whose words, sum_i r_i size_i, equal the source's target. The dual is convex with one multiplier b for each
source, and its solution is an exponential tilt by size, r = most / (1 + (most - 1) exp(-b x)), x the size over the
source's mean. Newton's iterations find b for all sources at once, over counts of equal sizes. Rates become whole
copies by class of size, largest sizes first, each class correcting what the larger ones left over or short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm.common import cut, partitions, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Least number of a hash's bits that deal one class of a source among windows.
SALT_BITS = 6
#: Classes of size per doubling.
FINE = 32
#: Equal rows that one task writes out at once.
CHUNK = 4096


def ranked(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in the order of ``by``, without one task for all: ranges, then ranks within a range."""
    spans = cut(df.repartitionByRange(partitions(df.sparkSession), *by).withColumn("_span", F.spark_partition_id()))
    counts = spans.groupBy("_span").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_span")) - F.col("_n")).select("_span", "_before")
    inside = F.row_number().over(W.partitionBy("_span").orderBy(*by)) - 1
    return spans.withColumn(name, inside).join(before, "_span").withColumn(name, F.col(name) + F.col("_before")).drop("_span", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size): shares of all sizes by weight, none above ``most`` times its source's.

    Weights go round the sources in the order of their code points, null last. What a source cannot take is shared
    again among the others by weight until none is above.
    """
    place = F.pmod(F.col("place"), F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    state = ranked(sources, [F.col("source").asc_nulls_last()], "place").withColumn("weight", weight).withColumn("full", F.lit(False))
    state = cut(state.select("source", "source_size", "weight", "full"))
    while True:
        cap = F.col("source_size") * F.lit(float(most))
        total, taken, open_weight = state.agg(F.sum("source_size"), F.sum(F.when(F.col("full"), cap).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight")))).first()
        level = (float(total or 0) - float(taken or 0)) / open_weight if open_weight else 0.0
        next_ = state.withColumn("now", F.col("full") | (F.col("weight") * F.lit(level) > cap))
        if not next_.where("now and not full").limit(1).count():
            return state.withColumn("target", F.when(F.col("full"), cap).otherwise(F.col("weight") * F.lit(level))).select("source", "source_size", "weight", "target")
        state = cut(next_.select("source", "source_size", "weight", F.col("now").alias("full")))


def rate_of(b: Column, x: Column, most: float) -> Column:
    """The tilted rate. b is null where a source takes nothing, and infinite where it takes all it can."""
    odds = F.exp(F.greatest(F.lit(-700.0), F.least(-b * x, F.lit(700.0))))
    return F.when(b.isNull(), F.lit(0.0)).when(b == float("inf"), F.lit(float(most))).otherwise(F.lit(float(most)) / (1 + F.lit(most - 1.0) * odds))


def tilt(counts: DataFrame, goals: DataFrame, most: float = MOST, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """(source, b, mean): the dual's solution for every source. counts (source, size, n); goals (source, source_size, target).

    A source whose target is its bound has an infinite multiplier, one without a target a null one. A step that leaves
    the interval in which the solution must lie is replaced by a bisection, or a doubling where an end is open, so that
    the iterations end from any start.
    """
    cells = cut(counts.where("size > 0"))
    docs = cells.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("docs"))
    solved = goals.join(docs, F.col("source").eqNullSafe(F.col("_s")))
    fixed = F.when(F.col("target") <= 0, F.lit(None).cast("double")).when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), F.lit(float("inf")))
    solved = solved.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), fixed.alias("b"))
    open_ = (F.col("target") > 0) & F.col("b").isNull()
    ends = solved.where(~open_).select("source", "b", "mean")
    solved = cut(solved.where(open_).withColumns({"b": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))}))
    for _ in range(rounds):
        c = cells.alias("c").join(solved.alias("p"), F.expr("c.source <=> p.source"))
        x = F.col("c.size") / F.col("p.mean")
        rate = rate_of(F.col("p.b"), x, most)
        words = F.col("c.n") * rate * x
        sums = c.groupBy(F.col("p.source").alias("source"), "p.target", "p.mean", "p.b", "p.low", "p.high").agg(F.sum(words).alias("got"), F.sum(words * x * (1 - rate / F.lit(float(most)))).alias("slope"))
        due = F.col("target") / F.col("mean")
        gap = due - F.col("got")
        low, high = F.when(gap > 0, F.col("b")).otherwise(F.col("low")), F.when(gap < 0, F.col("b")).otherwise(F.col("high"))
        sums = sums.select("source", "target", "mean", "b", low.alias("low"), high.alias("high"), F.when(F.col("slope") > 0, F.col("b") + gap / F.col("slope")).alias("newton"), (F.abs(gap) / due).alias("off"))
        far = F.abs("b") + 1
        safe = F.when(F.col("high") == float("inf"), F.col("low") + 2 * far).when(F.col("low") == float("-inf"), F.col("high") - 2 * far).otherwise((F.col("low") + F.col("high")) / 2)
        fine = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")) & (F.abs(F.col("newton") - F.col("b")) <= 4 * far)
        done = F.col("off") < tolerance
        step = cut(sums.select("source", "target", "mean", F.when(done, F.col("b")).when(fine, F.col("newton")).otherwise(safe).alias("b"), "low", "high", "off"))
        solved = step.drop("off")
        if (step.agg(F.max("off")).first()[0] or 0.0) < tolerance:
            break
    return ends.union(solved.select("source", "b", "mean"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies and taken (copies times size).

    A null text has size 0, a null source is a source of its own. Documents of size 0 get one copy and take no words.
    Rows that repeat an id are mixed like others; rows equal in id, source and text stand for one another, so that the
    same table gives the same rows whatever its partitions. They are counted before any row moves and dealt out at the
    end, so any number of them may be equal. Extra columns are ignored; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(13), t).alias("key"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(11), "doc_id", "key"))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("alike")))
    counts = cut(rows.groupBy("source", "size").agg(F.sum("alike").alias("n")))
    goals = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    solved = cut(tilt(counts, goals, most))
    level = F.when(F.col("size") > 0, F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double")) * FINE)).otherwise(-1).cast("int")
    raw = F.when(F.col("size") > 0, rate_of(F.col("b"), F.col("size") / F.col("mean"), most)).otherwise(0.0)
    rate = F.when(F.abs(raw - F.round(raw)) < 1e-7, F.round(raw)).otherwise(raw)
    # Whole parts of the rates are taken as they are, the rest is dealt class by class, largest first.
    s = solved.withColumnRenamed("source", "_source")
    rated = lambda df: df.join(s, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("rate", rate).withColumn("base", F.floor("rate")).drop("_source", "b", "mean")
    cells = rated(counts).withColumn("part", F.col("rate") - F.col("base")).withColumn("level", level)
    classes = cells.where("level >= 0").groupBy("source", "level").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(F.col("n") * F.col("size") * F.col("part")).alias("due"))
    # At most FINE classes a doubling of size: an array of bounded length per source.
    per_source = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", "n", "words", "due")), asc=False).alias("classes"))

    def deal(state: Column, c: Column) -> Column:
        mean = c["words"] / c["n"]
        owed = state["owed"] + c["due"]
        extra = F.least(F.greatest(F.round(owed / mean), F.lit(0.0)), c["n"].cast("double"))
        done = F.concat(state["done"], F.array(F.struct(c["level"].alias("level"), c["n"].alias("n"), extra.cast("long").alias("extra"))))
        return F.struct((owed - extra * mean).alias("owed"), done.alias("done"))

    start = F.struct(F.lit(0.0).alias("owed"), F.expr("cast(array() as array<struct<level:int,n:bigint,extra:bigint>>)").alias("done"))
    dealt = per_source.select(F.col("source").alias("_source"), F.inline(F.aggregate("classes", start, deal)["done"]))
    dealt = cut(dealt.select("_source", F.col("level").alias("_level"), F.col("n").alias("in_class"), "extra"))

    # Ranks inside a class follow the hash. Its high bits are the salt, so that no window holds more than a share of a
    # class and the number of salts, which grows with the partitions, changes no rank; every n/extra-th is taken.
    bits = max(SALT_BITS, (4 * partitions(docs.sparkSession)).bit_length())
    placed = rows.withColumn("level", level).withColumn("salt", F.shiftright("h", 64 - bits))
    salted = placed.where("level >= 0").groupBy("source", "level", "salt").agg(F.sum("alike").alias("n"))
    before = salted.withColumn("before", F.sum("n").over(W.partitionBy("source", "level").orderBy("salt")) - F.col("n"))
    before = before.join(dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("level") == F.col("_level")))
    before = before.select(F.col("source").alias("_source"), F.col("level").alias("_level"), F.col("salt").alias("_salt"), "before", "in_class", "extra")
    so_far = W.partitionBy("source", "level", "salt").orderBy("h", "doc_id", "key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rated(placed.withColumn("rank", F.sum("alike").over(so_far) - F.col("alike")))
    out = out.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("level") == F.col("_level")) & (F.col("salt") == F.col("_salt")), "left")
    goal = goals.select(F.col("source").alias("_g"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))
    out = out.join(goal, F.col("source").eqNullSafe(F.col("_g")))
    out = out.select("doc_id", "h", "size", "source_size", "target", "base", "extra", "in_class", "alike", (F.col("before") + F.col("rank")).alias("first"))

    # Equal rows get the places first + 1, first + 2, ... Only where many are equal do they go over several tasks.
    out = out.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(alike - 1) div {CHUNK}"))))
    if (rows.agg(F.max("alike")).first()[0] or 0) > CHUNK:
        out = out.repartition(partitions(docs.sparkSession), "h", "chunk")
    start = F.col("chunk") * CHUNK
    out = out.withColumn("place", F.explode(F.sequence(start, F.least(start + CHUNK, F.col("alike")) - 1)))
    at = F.col("first") + F.col("place") + 1
    extra = F.coalesce((F.floor(at * F.col("extra") / F.col("in_class")) > F.floor((at - 1) * F.col("extra") / F.col("in_class"))).cast("long"), F.lit(0))
    copies = F.when(F.col("size") > 0, F.least(F.col("base") + extra, F.lit(most))).otherwise(F.lit(1)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
