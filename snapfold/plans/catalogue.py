"""The reference queries bound to the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.functions import dates, rules
from snapfold.functions import text as X
from snapfold.operators import admission, episodes, latest, lookup, matching, upsert, window_dedup
from snapfold.plans import rule_sql, serve
from snapfold.registry import register
from snapfold.sources import layout
from snapfold.streaming import pairs
from snapfold.tables import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _entries(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


@register("serve_page", """SELECT o_orderkey, o_orderstatus, o_orderdate, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31' AND c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, n_name, c_name, o_orderkey LIMIT 100 OFFSET 100""")
def serve_page(spark, d):
    """FLT-01..05, JON-01, SRT-01/02: the serving query."""
    found = serve.where(_entries(spark, d), equal={"c_mktsegment": "BUILDING", "n_name": None}, among={"o_orderstatus": ["F", "O"]}, between={"o_orderdate": ("1996-01-01", "1998-12-31")})
    return serve.page(found.select("o_orderkey", "o_orderstatus", "o_orderdate", "c_name", "n_name"), [F.desc_nulls_last("o_orderdate"), F.asc_nulls_last("n_name"), F.asc_nulls_last("c_name"), F.asc("o_orderkey")], 2, 100)


@register("serve_reason_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%_ED%'")
def serve_reason_search(spark, d):
    """FLT-06: wildcards in the searched text keep their meaning."""
    return serve.where(table(spark, d, "part"), search={"p_name": "_ED"}).select("p_partkey", "p_name")


@register("serve_empty_in", "SELECT o_orderkey, o_orderstatus FROM orders WHERE false")
def serve_empty_in(spark, d):
    """FLT-04."""
    return serve.where(table(spark, d, "orders"), among={"o_orderstatus": []}).select("o_orderkey", "o_orderstatus")


@register("serve_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS json FROM nation""")
def serve_json(spark, d):
    """SNK-03."""
    return serve.export_json(table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@register("null_aware_filter", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def null_aware_filter(spark, d):
    """FLT-07/08/13: a null is unequal."""
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.where(~F.col("quality").eqNullSafe(1)).select("doc_id", "quality")


@register("composite_key_semi", "SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT user_id, min(ts)::DATE AS day FROM events GROUP BY user_id) k WHERE k.user_id = e.user_id AND k.day = e.ts::DATE)")
def composite_key_semi(spark, d):
    """FLT-09: a disjunction of key pairs is a semi join."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    keys = e.groupBy("user_id").agg(F.min("day").alias("day"))
    return e.join(keys, ["user_id", "day"], "left_semi").select("event_id", "user_id")


@register("missing_literals", "SELECT doc_id, CASE WHEN w NOT IN ('', 'NA', 'null', 'None', 'nan') THEN w END AS word FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN '' ELSE lang END AS w FROM documents)")
def missing_literals(spark, d):
    """FLT-12."""
    word = F.when(F.col("doc_id") % 5 == 0, "NA").when(F.col("doc_id") % 5 == 1, "null").when(F.col("doc_id") % 5 == 2, "").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", X.missing_to_null(word).alias("word"))


@register("dim_optional_left", "SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def dim_optional_left(spark, d):
    """JON-02."""
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@register("primary_condition_join", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1")
def primary_condition_join(spark, d):
    """JON-03: the constant goes to the scan."""
    first = table(spark, d, "lineitem").where("l_linenumber = 1")
    o = table(spark, d, "orders")
    return o.join(first, o.o_orderkey == first.l_orderkey).select("o_orderkey", "l_partkey", "l_quantity")


@register("normalized_key_join", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON regexp_replace(lower(c_name), '[^0-9]', '', 'g') = regexp_replace(lower(s_name), '[^0-9]', '', 'g')")
def normalized_key_join(spark, d):
    """JON-04, STR-09: computed keys hash like others."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9]", "")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, key("c_name") == key("s_name"), "left").select("c_custkey", "s_suppkey")


@register("season_filter_inner", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def season_filter_inner(spark, d):
    """JON-05: the filter turns the outer join into an inner one."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").where("quality = 1").select("doc_id", "quality")


_SHIFT = "o_orderdate + INTERVAL 24 YEAR"


@register("schedule_lookup_fallback", f"""WITH p(season, phase, a, b, rank) AS (VALUES {lookup.phase_sql()}), o AS (SELECT o_orderkey, ({_SHIFT})::DATE AS day FROM orders),
h AS (SELECT o_orderkey, season, phase, row_number() OVER (PARTITION BY o_orderkey ORDER BY rank) AS k FROM o JOIN p ON day BETWEEN a AND b)
SELECT o.o_orderkey, coalesce(season, 'none') AS season, coalesce(phase, 'none') AS phase FROM o LEFT JOIN h ON o.o_orderkey = h.o_orderkey AND k = 1""")
def schedule_lookup_fallback(spark, d):
    """JON-06/07: range lookup by priority, with a fallback for the pair."""
    hit = lookup.season_phase(F.add_months(F.to_date("o_orderdate"), 24 * 12))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(hit["season"], F.lit("none")).alias("season"), F.coalesce(hit["phase"], F.lit("none")).alias("phase"))


def _season_sql(first):
    return f"CASE WHEN month(o_orderdate) >= {first} THEN year(o_orderdate) || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') ELSE (year(o_orderdate) - 1) || '-' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') END"


@register("season_label", f"SELECT o_orderkey, {_season_sql(10)} AS season, {_season_sql(9)} AS early, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def season_label(spark, d):
    """DAT-02/03/06, STR-13."""
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.season(day).alias("season"), dates.season(day, 9).alias("early"), dates.month(day).alias("month"))


@register("unprocessed_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unprocessed_anti(spark, d):
    """JON-08, STA-07."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@register("orphan_dims", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def orphan_dims(spark, d):
    """JON-09, DML-08: stacked anti joins."""
    n = table(spark, d, "nation")
    s, c, r = table(spark, d, "supplier").where("s_acctbal > 9000"), table(spark, d, "customer").where("c_acctbal > 9900"), table(spark, d, "region").where("r_name = 'ASIA'")
    n = n.join(s, n.n_nationkey == s.s_nationkey, "left_anti").join(c, F.col("n_nationkey") == c.c_nationkey, "left_anti")
    return n.join(r, F.col("n_regionkey") == r.r_regionkey, "left_anti").select("n_nationkey", "n_name")


@register("reconcile_semi", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'returned' ELSE o_orderstatus END AS status FROM orders")
def reconcile_semi(spark, d):
    """JON-10, DML-06/07: an update by subquery is a flag and a case."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "orders").join(back, "o_orderkey", "left").select("o_orderkey", F.when(F.col("hit"), "returned").otherwise(F.col("o_orderstatus")).alias("status"))


@register("alias_residual", "WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h) SELECT doc_id, first_id FROM h JOIN f ON h.h = f.h AND doc_id <> first_id")
def alias_residual(spark, d):
    """JON-11, SNK-09: other addresses of one content."""
    h = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return h.join(h.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").where("doc_id <> first_id").select("doc_id", "first_id")


@register("lineage_subquery", "SELECT o_orderkey, c_name, lines, first_part FROM (SELECT l_orderkey, count(*) AS lines, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def lineage_subquery(spark, d):
    """JON-12/13: aggregate next to the scan, then join."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.min("l_partkey").alias("first_part"))
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return a.join(o, a.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "lines", "first_part")


_INTERVALS = """WITH a AS (SELECT user_id, event_id, ts::DATE AS day FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id, ts::DATE AS day FROM events WHERE event_type = 'purchase')
SELECT a.event_id, count(*) AS candidates, sum(CASE WHEN b.day < a.day THEN 1 ELSE 0 END)::BIGINT AS earlier FROM a JOIN b ON a.user_id = b.user_id AND abs(date_diff('day', a.day, b.day)) <= 7 GROUP BY a.event_id"""


@register("interval_candidates", _INTERVALS)
def interval_candidates(spark, d):
    """JON-15: binned interval join."""
    e = table(spark, d, "events")
    found = matching.candidates(e.where("event_type = 'click'"), e.where("event_type = 'purchase'").withColumnRenamed("event_id", "other_id"), "user_id", "ts", "event_id", "other_id")
    return found.groupBy("event_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("right_day") < F.col("left_day")).alias("earlier"))


@register("interval_candidates_stream", _INTERVALS)
def interval_candidates_stream(spark, d):
    """STA-03, JON-15 as a join of two streams: both sides replayed in order of time, with a restart in between."""
    e = table(spark, d, "events")
    folder = scratch(spark)
    sides = {"clicks": e.where("event_type = 'click'"), "purchases": e.where("event_type = 'purchase'").withColumnRenamed("event_id", "other_id")}
    half = e.agg(F.expr("date_add(min(ts), cast(datediff(max(ts), min(ts)) / 2 AS INT))").alias("half")).first().half
    for part in (F.to_date("ts") < F.lit(half), F.to_date("ts") >= F.lit(half)):
        streams = []
        for name, rows in sides.items():
            rows.where(part).write.mode("append").parquet(f"{folder}/{name}")
            streams.append(spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}"))
        pairs.run(pairs.candidates_stream(*streams, "user_id", "ts", "event_id", "other_id"), f"{folder}/pairs", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}/pairs")
    return found.groupBy("event_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("right_day") < F.col("left_day")).alias("earlier"))


@register("three_way_split", """SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%') b ON a.k = b.k GROUP BY 1""")
def three_way_split(spark, d):
    """JON-17, AGG-22."""
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = o.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k")).distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return a.join(b, "k", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@register("label_map_join", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'MISSING' END AS label FROM orders")
def label_map_join(spark, d):
    """JON-18/19, STR-07/16: a constant dictionary is a map literal."""
    labels = F.create_map(*[F.lit(x) for x in ("F", "Finished", "O", "Open")])
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(labels, F.col("o_orderstatus")), F.lit("MISSING")).alias("label"))


@register("get_or_create", "WITH f AS (SELECT user_id % 40 AS k, arg_min('user ' || user_id, event_id) AS name FROM events GROUP BY 1), dim AS (SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation) SELECT * FROM dim UNION ALL SELECT k, name FROM f WHERE k NOT IN (SELECT k FROM dim)")
def get_or_create(spark, d):
    """JON-20: dimension rows made on first sight."""
    facts = table(spark, d, "events").select((F.col("user_id") % 40).alias("k"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), "event_id")
    return upsert.get_or_create(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), facts, "k", "name", "event_id")


@register("matchup_resolution", "WITH m AS (SELECT a.n_nationkey AS i, a.n_name || '@' || b.n_name AS matchup FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1) SELECT matchup, x.n_nationkey AS away, y.n_nationkey AS home FROM m JOIN nation x ON x.n_name = split_part(matchup, '@', 1) JOIN nation y ON y.n_name = split_part(matchup, '@', 2)")
def matchup_resolution(spark, d):
    """JON-21, STR-10."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    other = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("other"))
    m = n.join(other, "n_nationkey").select(F.concat("n_name", F.lit("@"), "other").alias("matchup"))
    x, y = n.select(F.col("n_nationkey").alias("away"), F.col("n_name").alias("xn")), n.select(F.col("n_nationkey").alias("home"), F.col("n_name").alias("yn"))
    return m.join(x, F.split_part("matchup", F.lit("@"), F.lit(1)) == F.col("xn")).join(y, F.split_part("matchup", F.lit("@"), F.lit(2)) == F.col("yn")).select("matchup", "away", "home")


@register("quality_counts", """SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE event_type = 'error') AS errors, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 2)::DOUBLE AS error_percent, count(*) FILTER (WHERE value IS NULL) AS no_value FROM events""")
def quality_counts(spark, d):
    """AGG-01/02/05/20, RPT-01: all counts in one pass."""
    error = F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(error).alias("errors"), F.round(F.try_divide(F.count_if(error) * 100.0, F.count("*")), 2).alias("error_percent"), F.count_if(F.col("value").isNull()).alias("no_value"))


@register("group_count_nullkey", "SELECT CASE WHEN coalesce(k, '') = '' THEN '<null>' ELSE k END AS key, count(*) AS n FROM (SELECT nullif(o_orderpriority, '5-LOW') AS k FROM orders) GROUP BY 1")
def group_count_nullkey(spark, d):
    """AGG-03."""
    k = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return table(spark, d, "orders").groupBy(F.coalesce(F.nullif(k, F.lit("")), F.lit("<null>")).alias("key")).agg(F.count("*").alias("n"))


@register("distinct_tuple", "SELECT count(DISTINCT (ts::DATE, user_id)) AS pairs, count(*) FILTER (WHERE event_type = 'view') AS views, count(DISTINCT CASE WHEN event_type = 'purchase' THEN (ts::DATE, user_id) END) AS buying FROM events")
def distinct_tuple(spark, d):
    """AGG-06/07/08."""
    pair = F.struct(F.to_date("ts"), "user_id")
    return table(spark, d, "events").agg(F.countDistinct(pair).alias("pairs"), F.count_if(F.col("event_type") == "view").alias("views"), F.countDistinct(F.when(F.col("event_type") == "purchase", pair)).alias("buying"))


@register("multi_condition_groups", "SELECT count(*) AS groups, sum(n - 1)::BIGINT AS repeats FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)")
def multi_condition_groups(spark, d):
    """AGG-09/26/33."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("repeats"))


@register("season_summary", f"SELECT {_season_sql(10)} AS season, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice::DECIMAL(18,2)) / nullif(count(*), 0), 2)::DOUBLE AS mean_price, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM orders GROUP BY 1")
def season_summary(spark, d):
    """AGG-10/11, RPT-04: one grouped pass instead of a scan per season."""
    price = F.round(F.try_divide(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), F.count("*")), 2)
    return table(spark, d, "orders").groupBy(dates.season(F.col("o_orderdate")).alias("season")).agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), price.alias("mean_price"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))


@register("outlier_days", """WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), m AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS middle FROM c) SELECT day, n, n < 0.3 * middle AS low_n FROM c, m""")
def outlier_days(spark, d):
    """AGG-18: flags against the upper median of daily counts."""
    c = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return admission.low_flags(c, "n")


@register("outlier_sources", """WITH c AS (SELECT source, count(*) AS reports, sum(n_chars)::BIGINT AS entries, count(DISTINCT lang) FILTER (doc_id % 3 = 0) AS games FROM documents GROUP BY 1), m AS (SELECT list_sort(list(reports))[count(*) // 2 + 1] AS r, list_sort(list(entries))[count(*) // 2 + 1] AS e, list_sort(list(games))[count(*) // 2 + 1] AS g FROM c)
SELECT source, reports, entries, games, reports < 0.3 * r AS low_reports, entries < 0.3 * e AS low_entries, games < 0.3 * g AS low_games FROM c, m""")
def outlier_sources(spark, d):
    """AGG-18, RPT-04: three measures, each flagged under three tenths of its upper median."""
    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("reports"), F.sum("n_chars").alias("entries"), F.countDistinct(F.when(F.col("doc_id") % 3 == 0, F.col("lang"))).alias("games"))
    return admission.low_flags(c, "reports", "entries", "games")


@register("top_reasons", "SELECT split_part(p_name, ' ', 1) AS word, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def top_reasons(spark, d):
    """AGG-12/13, SRT-08: a total order decides ties."""
    return table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


_TYPES = """CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%COPPER%' THEN 'red metal' WHEN p_type LIKE '%TIN%' THEN 'tin' END"""


@register("classify_distinct_weighted", f"SELECT {_TYPES} AS label, count(DISTINCT p_type) AS reasons, count(*) AS n FROM part GROUP BY 1")
def classify_distinct_weighted(spark, d):
    """AGG-14, CND-01: classify distinct texts, weigh by their counts."""
    counts = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    label = X.ladder("steel: STEEL\nred metal: BRASS, COPPER\ntin: TIN", lambda terms: X.any_of(F.col("p_type"), terms))
    return counts.groupBy(label.alias("label")).agg(F.count("*").alias("reasons"), F.sum("n").alias("n"))


@register("duration_stats", """WITH s AS (SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders GROUP BY 1)
SELECT round(quantile_cont(days, 0.5), 4) AS p50, round(quantile_cont(days, 0.75), 4) AS p75, round(quantile_cont(days, 0.9), 4) AS p90, round(quantile_cont(days, 0.99), 4) AS p99, max(days)::BIGINT AS most, count(*) FILTER (WHERE days = 0) AS d0, count(*) FILTER (WHERE days BETWEEN 1 AND 90) AS d1_90, count(*) FILTER (WHERE days > 90) AS over_90 FROM s""")
def duration_stats(spark, d):
    """AGG-17/19, RPT-03, UDF-11."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    p = F.percentile("days", [0.5, 0.75, 0.9, 0.99])
    return s.agg(p.alias("p"), F.max("days").cast("long").alias("most"), F.count_if(F.col("days") == 0).alias("d0"), F.count_if(F.col("days").between(1, 90)).alias("d1_90"), F.count_if(F.col("days") > 90).alias("over_90")).select(*(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p75", "p90", "p99"))), "most", "d0", "d1_90", "over_90")


@register("set_cardinality", "SELECT user_id, count(DISTINCT coalesce(nullif(event_type, 'view'), '<null>')) AS kinds, count(DISTINCT nullif(event_type, 'view')) AS named FROM events GROUP BY user_id")
def set_cardinality(spark, d):
    """AGG-15: with and without the null as a member."""
    kind = F.nullif(F.col("event_type"), F.lit("view"))
    return table(spark, d, "events").groupBy("user_id").agg(F.size(F.collect_set(F.coalesce(kind, F.lit("<null>")))).cast("long").alias("kinds"), F.size(F.collect_set(kind)).cast("long").alias("named"))


@register("status_changes", "SELECT user_id, sum(CASE WHEN k > 1 AND event_type IS DISTINCT FROM p THEN 1 ELSE 0 END)::BIGINT AS changes, count(*) AS n FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def status_changes(spark, d):
    """WIN-06, AGG-16."""
    return latest.status_changes(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")


@register("near_repeats", "SELECT user_id, event_type, count(*) FILTER (WHERE g BETWEEN 0 AND 3) AS near FROM (SELECT user_id, event_type, date_diff('day', lag(ts) OVER w, ts) AS g FROM (SELECT user_id, event_type, event_id, ts::DATE AS ts FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) GROUP BY ALL")
def near_repeats(spark, d):
    """WIN-05: gaps to the row before within an identity."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    gap = F.datediff("day", F.lag("day").over(W.partitionBy("user_id", "event_type").orderBy("day", "event_id")))
    return e.withColumn("g", gap).groupBy("user_id", "event_type").agg(F.count_if(F.col("g").between(0, 3)).alias("near"))


@register("agreement_summary", "SELECT count(a) AS comparable, count(*) FILTER (WHERE a) AS agree, round(100.0 * count(*) FILTER (WHERE a) / nullif(count(a), 0), 2)::DOUBLE AS percent FROM (SELECT quality = toxic AS a FROM documents LEFT JOIN labels USING (doc_id))")
def agreement_summary(spark, d):
    """AGG-21: a null comparison counts neither way."""
    a = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select((F.col("quality") == F.col("toxic")).alias("a"))
    return a.agg(F.count("a").alias("comparable"), F.count_if("a").alias("agree"), F.round(F.try_divide(F.count_if("a") * 100.0, F.count("a")), 2).alias("percent"))


@register("multi_label_counts", "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS label FROM part) GROUP BY label")
def multi_label_counts(spark, d):
    """AGG-23, CND-11."""
    return table(spark, d, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("row_reconciliation", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def row_reconciliation(spark, d):
    """AGG-24, SNK-13."""
    counts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@register("nested_coverage", f"SELECT {_season_sql(10)} AS season, o_orderstatus AS kind, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS games FROM orders GROUP BY GROUPING SETS ((1, 2, 3), (1, 2))")
def nested_coverage(spark, d):
    """AGG-25, RPT-05: months and totals in one pass."""
    o = table(spark, d, "orders").select(dates.season(F.col("o_orderdate")).alias("season"), F.col("o_orderstatus").alias("kind"), dates.month(F.col("o_orderdate")).alias("month"), "o_custkey")
    return o.groupingSets([[F.col("season"), F.col("kind"), F.col("month")], [F.col("season"), F.col("kind")]], "season", "kind", "month").agg(F.countDistinct("o_custkey").alias("games"))


@register("cross_tab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def cross_tab(spark, d):
    """AGG-34, RPT-07."""
    t = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return t.select("o_orderpriority", *(F.col(x).alias(x.lower()) for x in "FOP"))


@register("pair_collapse", "SELECT l_orderkey, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2")
def pair_collapse(spark, d):
    """AGG-29: groups of exactly two."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))
    return g.where("n = 2").select("l_orderkey", "low", "high")


@register("content_digest", "SELECT n_regionkey, sha256(string_agg(n_nationkey || chr(31) || coalesce(n_name, '<null>'), chr(10) ORDER BY n_nationkey)) AS digest, count(*) AS n FROM nation GROUP BY n_regionkey")
def content_digest(spark, d):
    """AGG-31."""
    return lookup.digest(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])


@register("exact_dedup_best", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (CASE WHEN l_returnflag = 'R' THEN 1000 ELSE 0 END + l_quantity) DESC, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) AS k FROM lineitem) WHERE k = 1")
def exact_dedup_best(spark, d):
    """WIN-01, MTH-02: best score, ties by all else."""
    score = F.when(F.col("l_returnflag") == "R", 1000).otherwise(0) + F.col("l_quantity")
    order = [score.desc(), *map(F.col, ("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))]
    return latest.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def _days(kind):
    return F.when(kind == "1-URGENT", 365).when(kind == "2-HIGH", 180).when(kind == "3-MEDIUM", 90).otherwise(30)


@register("window_dedup", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS k FROM orders),
w AS (SELECT *, CASE kind WHEN '1-URGENT' THEN 365 WHEN '2-HIGH' THEN 180 WHEN '3-MEDIUM' THEN 90 ELSE 30 END AS width FROM o),
f AS (SELECT o_custkey, k, day AS last, width, true AS kept, o_orderkey, day, kind FROM w WHERE k = 1
UNION ALL SELECT w.o_custkey, w.k, CASE WHEN date_diff('day', f.last, w.day) > f.width THEN w.day ELSE f.last END, CASE WHEN date_diff('day', f.last, w.day) > f.width THEN w.width ELSE f.width END, date_diff('day', f.last, w.day) > f.width, w.o_orderkey, w.day, w.kind FROM f JOIN w ON w.o_custkey = f.o_custkey AND w.k = f.k + 1)
SELECT o_custkey, day AS o_orderdate, o_orderkey, kind AS o_orderpriority FROM f WHERE kept""")
def window_dedup_query(spark, d):
    """WIN-02, CND-10, UDF-06: windows follow the last kept row."""
    return window_dedup.window_dedup(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderpriority", "o_orderkey", lambda k, p: _days(k), ())


@register("window_dedup_long", """WITH RECURSIVE o AS (SELECT o_orderstatus, o_orderkey, o_orderdate::DATE AS day, o_orderpriority AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 365 WHEN '2-HIGH' THEN 180 WHEN '3-MEDIUM' THEN 90 ELSE 30 END AS width FROM orders),
d AS (SELECT o_orderstatus, day, min(o_orderkey) AS k FROM o GROUP BY ALL),
n AS (SELECT o.*, d.k AS next FROM o ASOF LEFT JOIN d ON o.o_orderstatus = d.o_orderstatus AND o.day + o.width::INTEGER < d.day),
f AS (SELECT * FROM n WHERE o_orderkey IN (SELECT arg_min(k, day) FROM d GROUP BY o_orderstatus) UNION ALL SELECT n.* FROM f JOIN n ON n.o_orderkey = f.next)
SELECT o_orderstatus, day AS o_orderdate, o_orderkey, kind AS o_orderpriority FROM f""")
def window_dedup_long(spark, d):
    """WIN-02 over three histories that nothing cuts: kept rows are found by pointer doubling."""
    return window_dedup.window_dedup(table(spark, d, "orders"), ["o_orderstatus"], "o_orderdate", "o_orderpriority", "o_orderkey", lambda k, p: _days(k), ())


@register("latest_per_game", "SELECT user_id, day, event_id, event_type FROM (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def latest_per_game(spark, d):
    """WIN-03, AGG-27/28."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type", "ts")
    return latest.latest_per_key(e, ["user_id", "day"], "ts", "event_id").select("user_id", "day", "event_id", "event_type")


@register("last_wins_precedence", "SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source DESC) AS r FROM (SELECT n_nationkey AS k, n_name AS name, 1 AS source FROM nation UNION ALL SELECT r_regionkey, r_name, 2 FROM region)) WHERE r = 1")
def last_wins_precedence(spark, d):
    """WIN-04, SET-01."""
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(1).alias("source"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(2).alias("source"))
    return a.unionByName(b).groupBy("k").agg(F.max_by("name", "source").alias("name"))


@register("forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def forward_fill(spark, d):
    """WIN-07."""
    e = table(spark, d, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return latest.forward_fill(e, ["user_id"], [F.col("ts"), F.col("event_id")], "bought", "last_purchase").select("event_id", "last_purchase")


@register("row_numbering", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_number FROM conversations")
def row_numbering(spark, d):
    """WIN-11."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("row_number"))


@register("set_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, d):
    """SET-04/05/06."""
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@register("set_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark, d):
    """SET-03."""
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@register("set_union", "SELECT lang AS v FROM documents UNION SELECT role FROM conversations")
def set_union(spark, d):
    """SET-02."""
    return table(spark, d, "documents").select(F.col("lang").alias("v")).union(table(spark, d, "conversations").select("role")).distinct()


@register("calendar_gaps", "WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e GROUP BY user_id) SELECT user_id, day FROM r EXCEPT SELECT user_id, day FROM e")
def calendar_gaps(spark, d):
    """SET-07, DAT-07."""
    return lookup.missing_days(spark, table(spark, d, "events"), "user_id", "ts")


@register("discrepancy_union", "SELECT 'nation' AS side, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region")
def discrepancy_union(spark, d):
    """SET-08, SNK-04."""
    a = table(spark, d, "nation").select(F.lit("nation").alias("side"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(table(spark, d, "region").select(F.lit("region").alias("side"), F.col("r_name").alias("name")), allowMissingColumns=True)


@register("text_normalize", r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain, length(text) AS n FROM conversations")
def text_normalize(spark, d):
    """STR-01..04, STR-12."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.alnum(F.col("text")).alias("plain"), F.length("text").cast("long").alias("n"))


@register("name_key", "SELECT c_custkey, regexp_replace(lower(strip_accents('É' || c_name)), '[^a-z0-9]+', '', 'g') AS key FROM customer")
def name_key(spark, d):
    """STR-05, UDF-04."""
    return table(spark, d, "customer").select("c_custkey", X.name_key(F.concat(F.lit("É"), "c_name")).alias("key"))


@register("given_first", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Jr., ' ELSE '' END || substr(c_name, 10) || ' ' || substr(c_name, 1, 8) AS name FROM customer")
def given_first(spark, d):
    """STR-06."""
    more = F.when(F.col("c_custkey") % 2 == 0, F.lit("Jr., ")).otherwise(F.lit(""))  # what follows the first comma may hold another
    flipped = F.concat(F.substring("c_name", 1, 8), F.lit(" ,  "), more, F.substring("c_name", 10, 100))
    return table(spark, d, "customer").select("c_custkey", X.given_first(flipped).alias("name"))


@register("laterality", r"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(the)([^a-z0-9]|$)') THEN 'left' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(de|der)([^a-z0-9]|$)') THEN 'right' END AS side FROM documents")
def laterality(spark, d):
    """REG-01/03: terms bounded by letters and digits."""
    t = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.when(X.token(t, "the"), "left").when(X.token(t, "de", "der"), "right").alias("side"))


_OPENINGS = "|".join(rules.NON_INJURY_OPENINGS).replace("'", "''")


@register("clause_split", rf"""WITH h AS (SELECT conv_id, turn, string_split(regexp_replace(text, '(?i)\s*[,/;&(]\s*((?:on\s+)?(?:{_OPENINGS})\b)', chr(1) || '\1'), chr(1)) AS halves FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(list_concat(regexp_split_to_array(halves[1], '\s*[,/]\s*'), halves[2:2]), lambda x: trim(x, ' -;()')), lambda x: x <> '') AS parts FROM h)
SELECT conv_id, turn, i::INTEGER AS clause, parts[i] AS text FROM p, unnest(range(1, len(parts) + 1)) AS u(i)""")
def clause_split(spark, d):
    """REG-08, CND-04, ARR-01, UDF-02: one row a clause."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.clauses(F.col("text"))).alias("i", "text")).select("conv_id", "turn", (F.col("i") + 1).alias("clause"), "text")


@register("multi_date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day FROM orders")
def multi_date_parse(spark, d):
    """DAT-01/08."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 2, F.date_format("o_orderdate", "MMM d, yyyy")).otherwise(F.lit("soon"))
    return o.select("o_orderkey", dates.parse(text, "yyyy-M-d", "M/d/yyyy", "MMM d, yyyy").alias("day"))


@register("url_times", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN ts::DATE + to_hours(event_id % 24) + to_minutes(CASE WHEN event_id % 7 = 0 THEN 45 ELSE 30 END) END AS published FROM events")
def url_times(spark, d):
    """REG-04/05, DAT-05: time of day in a file name."""
    h, k = F.col("event_id") % 24, F.col("event_id") % 5
    half = F.when(h < 12, F.when(k == 1, "am").otherwise("AM")).otherwise(F.when(k == 1, "pm").otherwise("PM"))
    end = F.when(k == 3, "?v=1").when(k == 4, "/index").otherwise("")  # no report's own address
    name = F.concat(F.lit("https://example.com/Injury-Report_"), F.to_date("ts").cast("string"), F.lit("_"), F.lpad(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), 2, "0"), F.when(F.col("event_id") % 7 == 0, "_45").otherwise(""), half, F.lit(".pdf"), end)
    return table(spark, d, "events").select("event_id", dates.url_time(name).cast("timestamp_ntz").alias("published"))


@register("url_canonical", r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages WHERE starts_with(url, 'https://')")
def url_canonical(spark, d):
    """STR-15, REG-09, SRC-13."""
    return table(spark, d, "pages").where(F.startswith("url", F.lit("https://"))).select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))


@register("row_identity", """SELECT c_custkey, sha256('["v1","' || c_name || '","' || c_mktsegment || '"]') AS key FROM customer""")
def row_identity(spark, d):
    """HSH-01/02."""
    return table(spark, d, "customer").select("c_custkey", X.row_identity(F.lit("v1"), F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@register("json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    """JSN-01, SRC-25."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("html_outline", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '<a[ >]'))::INTEGER AS links FROM pages""")
def html_outline(spark, d):
    """SRC-19, UDF-10."""
    return layout.outline(table(spark, d, "pages")).select("page_id", "title", "links")


@register("upsert_change_detect", """WITH a AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(b.segment, a.segment) AS segment, CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'inserted' WHEN a.segment = b.segment THEN 'skipped' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.k = b.k""")
def upsert_change_detect(spark, d):
    """DML-02..05."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    incoming = c.where("k % 2 = 0").withColumn("segment", F.when(F.col("k") % 5 == 0, "NEW").otherwise(F.col("segment")))
    return upsert.upsert(c.where("k % 3 <> 0"), incoming, ["k"], keep=("name",))


@register("insert_absent", "SELECT k, name FROM (SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation) UNION ALL SELECT k, min(name) FROM (SELECT c_custkey % 50 AS k, c_name AS name FROM customer) WHERE k >= 25 GROUP BY k")
def insert_absent(spark, d):
    """DML-02, SNK-01: first of a batch wins."""
    existing = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return upsert.insert_absent(existing, table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("k"), F.col("c_name").alias("name"), F.col("c_name").alias("n")), ["k"], "n").select("k", "name")


@register("supersede_latest", """WITH e AS (SELECT user_id, event_id, ts::DATE AS day, event_type, ts::DATE + to_hours(hour(ts) // 6 * 6) AS published FROM events), m AS (SELECT user_id, day, max(published) AS top FROM e GROUP BY ALL) SELECT e.user_id, e.day, event_id, event_type, published FROM e JOIN m ON e.user_id = m.user_id AND e.day = m.day AND published = top""")
def supersede_latest(spark, d):
    """STA-02..04: newer publications win by subject, late ones are ignored."""
    at = (F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.floor(F.hour("ts") / 6) * 6)).alias("published")
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type", at)
    return upsert.supersede(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "day"], ["event_id"], "published")


@register("stale_versions", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 1 ORDER BY doc_id")
def stale_versions(spark, d):
    """STA-05/06: rows whose recorded version is not the current one."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").where(~F.col("quality").eqNullSafe(1)).select("doc_id")


@register("episodes_gap", "SELECT user_id, event_type, episode, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::BIGINT AS episode FROM (SELECT *, CASE WHEN date_diff('day', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::DATE, ts::DATE) <= 1 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL")
def episodes_gap(spark, d):
    """STA-01 reduced: same reason, gaps of a day at most."""
    e = latest.episodes_by_gap(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 1)
    return e.groupBy("user_id", "event_type", "episode").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _observations(spark, d):
    e = table(spark, d, "events")
    part = F.element_at(F.array(*map(F.lit, ("knee", "ankle", "back"))), (F.col("user_id") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("soreness", "sprain", "injury", "pain"))), (F.col("event_id") % 4 + 1).cast("int"))
    side = F.when(F.col("event_id") % 3 == 0, "left").when(F.col("event_id") % 3 == 1, "right")
    status = F.when(F.col("event_type") == "purchase", "Available").otherwise("Out")
    return e.select(F.col("user_id").alias("entity"), F.lit(1).cast("long").alias("team"), F.to_date("ts").alias("day"), F.to_date("ts").alias("report_day"), micros("ts").alias("report_time"), F.col("event_id").alias("source"), F.col("event_id").alias("condition"), status.alias("status"), part.alias("part"), side.alias("laterality"), kind.alias("kind"), F.concat_ws(" ", side, part, kind).alias("reason"))


@register("episodes_scored", rule_sql.episodes_sql("""SELECT *, NULL::VARCHAR AS structure, concat_ws(' ', laterality, part, kind) AS reason FROM (SELECT user_id AS entity, 1::BIGINT AS team, ts::DATE AS day, ts::DATE AS report_day, ts AS report_time, event_id AS source,
CASE WHEN event_type = 'purchase' THEN 'Available' ELSE 'Out' END AS status, ['knee', 'ankle', 'back'][user_id % 3 + 1] AS part, CASE event_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS laterality, ['soreness', 'sprain', 'injury', 'pain'][event_id % 4 + 1] AS kind FROM events)"""))
def episodes_scored(spark, d):
    """STA-01, UDF-07, CND-07/08."""
    return episodes.build_episodes(_observations(spark, d))


@register("optimal_match")
def optimal_match(spark, d):
    """JON-16, SIM-01, RPT-08, UDF-05/08, CND-09."""
    o = _observations(spark, d).select(F.col("entity").alias("key"), F.col("source").alias("id"), "day", "part", "kind", "laterality", "reason", "status")
    return matching.optimal_match(o.where("status = 'Available'").drop("status"), o.where("status = 'Out'").drop("status"))


@register("match_summary", """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, event_type = 'purchase' AS is_left FROM events),
s AS (SELECT key, list(day ORDER BY day, id) FILTER (is_left) AS l, list(day ORDER BY day, id) FILTER (NOT is_left) AS r FROM e GROUP BY key HAVING count(*) FILTER (is_left) > 0 AND count(*) FILTER (NOT is_left) > 0),
-- best[j]: a million for each pair less its days apart, of the left rows from i on and the right rows from j on.
f AS (SELECT key, l, r, len(l) AS i, list_transform(range(len(r) + 1), lambda j: 0::BIGINT) AS best FROM s
UNION ALL SELECT key, l, r, i - 1, list_transform(range(1, len(r) + 2), lambda j: list_max(list_transform(range(j, len(r) + 2), lambda k: greatest(best[k], CASE WHEN k <= len(r) AND abs(l[i] - r[k]) <= 7 THEN best[k + 1] + 1000000 - abs(l[i] - r[k]) ELSE 0 END)))) FROM f WHERE i > 0),
t AS (SELECT key, best[1] AS v FROM f WHERE i = 0 AND best[1] > 0)
SELECT key, (v + 999999) // 1000000 AS pairs, (v + 999999) // 1000000 * 1000000 - v AS days_apart FROM t""")
def match_summary(spark, d):
    """JON-16, CND-09, RPT-08, UDF-05: how many pairs a key's best matching has, and how many days they lie apart."""
    return matching.match_summary(optimal_match(spark, d))


@register("classify_reasons", rule_sql.reasons_sql())
def classify_reasons(spark, d):
    """CND-01..03, UDF-01: classify distinct reasons once, then join back."""
    e = table(spark, d, "events").select("event_id", rule_sql.drawn_reason(F.col("event_id") % rule_sql.DRAWN).alias("reason"))
    known = e.select("reason").distinct().withColumn("c", X.classify(F.col("reason")))
    return e.join(known, "reason").select("event_id", "c.body_part", "c.laterality", "c.injury_type", "c.is_injury")


@register("classify_notes", rule_sql.notes_sql())
def classify_notes(spark, d):
    """CND-05/06, UDF-03: the same for notes."""
    e = table(spark, d, "events").select("event_id", rule_sql.NOTES.column(F.col("event_id") % rule_sql.DRAWN).alias("note"))
    known = e.select("note").distinct().withColumn("c", X.classify_note(F.col("note")))
    return e.join(known, "note").select("event_id", "c.body_part", "c.injury_type")
