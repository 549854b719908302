"""Reference operators on their edge cases, and every registered query against its SQL."""

import datetime
import math
import os
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from snapfold import queries
from snapfold.functions import dates, rules
from snapfold.functions import text as X
from snapfold.operators import admission, episodes, latest, lookup, matching, upsert, window_dedup
from snapfold.plans import serve
from snapfold.sources import files, layout
from snapfold.streaming import supersede_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def day(text):
    return datetime.date.fromisoformat(text)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name in queries.ORACLE_SQL:
        found = duck.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    else:
        assert got


# --- classification


@pytest.mark.parametrize(
    "reason, category, part, side, kind, injury",
    [
        ("Injury/Illness - Left Knee; ACL Tear", None, "knee", "left", "ACL tear", True),
        ("Injury/Illness - Right Knee; ACL Surgery Recovery", None, "knee", "right", "recovery", True),
        ("Injury/Illness - N/A; Illness", None, "illness", None, "illness", True),
        ("Left and Right Ankle; Sprains", None, "ankle", "bilateral", "sprain", True),
        ("Rest", None, None, None, None, False),
        ("Injury Management", "Rest", None, None, "injury management", False),
        ("G League - On Assignment", None, None, None, None, False),
        ("Face; Mask", None, "face", None, "protective equipment", True),
        (None, None, None, None, None, False),
    ],
)
def test_classify(spark, reason, category, part, side, kind, injury):
    df = spark.createDataFrame([(reason, category)], "r string, c string")
    c = df.select(X.classify(F.col("r"), F.col("c")).alias("c")).first().c
    assert (c.body_part, c.laterality, c.injury_type, c.is_injury) == (part, side, kind, injury)


def test_classify_notes(spark):
    notes = [("placed on IL recovering from surgery on left knee", "knee", "recovery"), ("torn Achilles", "achilles", "tear"), ("corneal abrasion", None, "corneal abrasion"), ("scratched eye, abrasion", "eye", "corneal abrasion"), ("sick", "illness", "illness"), (None, None, None)]
    got = spark.createDataFrame([(n[0],) for n in notes], "n string").select(X.classify_note(F.col("n")).alias("c")).collect()
    assert [(r.c.body_part, r.c.injury_type) for r in got] == [n[1:] for n in notes]


def test_clauses(spark):
    got = spark.createDataFrame([("Left Knee; Sprain, Right Ankle; N/A and left hip / tib/fib",)], "r string").select(X.clauses(F.col("r")).alias("c")).first().c
    assert got == ["Left Knee; Sprain", "Right Ankle; N/A", "left hip", "tib/fib"]


def test_names_and_dates(spark):
    row = spark.sql("SELECT 'Dončić,  Luka' AS n, DATE '2020-10-05' AS d, 'https://x/Injury-Report_2024-01-02_05pm.pdf' AS u, 'left thumb and right toe' AS t")
    got = row.select(X.given_first(F.col("n")).alias("n"), X.name_key("n").alias("k"), dates.season(F.col("d")).alias("s"), dates.season(F.col("d"), late_2020=True).alias("l"), dates.url_time(F.col("u")).cast("string").alias("u"), X.laterality_for_matching(F.col("t")).alias("m"), X.laterality(F.col("t")).alias("c")).first()
    assert tuple(got) == ("Luka Dončić", "doncicluka", "2020-21", "2019-20", "2024-01-02 17:30:00", "bilateral", "left")
    more = spark.sql("SELECT explode(array('Porter, Jr., Michael', 'One', ' A ,B', ',x', null)) AS n").select(X.given_first(F.col("n"))).collect()
    assert [r[0] for r in more] == ["Jr., Michael Porter", "One", "B A", "x", None]
    urls = spark.sql("SELECT explode(array('/Injury-Report_2024-01-02_12_05AM.pdf', '/Injury-Report_2024-01-02_05PM.pdf?x', 'a/Report_2024-01-02_05PM.pdf', '/INJURY-report_2024-01-02_12pm.PDF', '/Injury-Report_2024-01-02_13PM.pdf')) AS u").select(dates.url_time(F.col("u")).cast("string")).collect()
    assert [r[0] for r in urls] == ["2024-01-02 00:05:00", None, None, "2024-01-02 12:30:00", None]
    times = spark.sql("SELECT explode(array('1:30', '1:30(ET)', '01:30  (ET)', '01:30 (ET)', '1:3 (ET)', '1:30 ET', 'at 1:30')) AS t").select(layout.is_time(F.col("t"))).collect()
    assert [r[0] for r in times] == [True] * 4 + [False] * 3


# --- folds


def test_window_dedup_boundaries(spark):
    rows = [("a", "knee", "2024-01-01", "sprain", 1), ("a", "knee", "2024-01-31", "sprain", 2), ("a", "knee", "2024-02-01", "sprain", 3), ("a", None, "2024-01-01", "sprain", 4), ("b", "achilles", "2020-01-01", "tear", 5), ("b", "achilles", "2022-01-01", "achilles injury", 6), ("c", "knee", "2020-01-01", "ACL tear", 7), ("c", "knee", "2020-06-01", "surgery", 8)]
    df = spark.createDataFrame(rows, "player string, part string, day string, kind string, id int").withColumn("day", F.to_date("day"))
    got = window_dedup.window_dedup(df, ["player", "part"], "day", "kind", "id", part="part")
    assert sorted(r.id for r in got.collect()) == [1, 3, 5, 7]


def plain_dedup(rows):
    """Kept ids of (player, part, day, kind, id) rows by the medical rules, one row after another."""
    kept, last = [], {}
    for player, part, d, kind, i in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[2], r[4])):
        if (player, part) in last:
            at, before = last[player, part]
            days = (d - at).days
            width = 365 if before in window_dedup.TEARS and part in ("knee", "achilles") else 180 if before == "surgery" else 90 if before in ("achilles injury", "fracture") else 30
            related = (before in window_dedup.TEARS and kind == "surgery" and days <= 180) or (before == "tear" and part == "achilles" and kind == "achilles injury" and days <= 750)
            related |= (before == kind == "achilles injury" and days <= 180) or (before == kind == "surgery" and days <= 365)
            if related or days <= width:
                continue
        last[player, part] = d, kind
        kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("most", [2, 40, 5000])
def test_window_dedup_by_fold_and_by_doubling(spark, most):
    import random

    rng = random.Random(most)
    kinds = [*window_dedup.TEARS, "surgery", "achilles injury", "fracture", "sprain", "other", None]
    rows = [(f"p{rng.randint(0, 2)}", rng.choice(["knee", "achilles", "back", None]), day("2010-01-01") + datetime.timedelta(rng.randint(0, 4000)), rng.choice(kinds), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "player string, part string, day date, kind string, id int")
    got = window_dedup.window_dedup(df, ["player", "part"], "day", "kind", "id", part="part", most=most)
    assert sorted(r.id for r in got.collect()) == plain_dedup(rows)
    assert window_dedup.window_dedup(df.limit(0), ["player", "part"], "day", "kind", "id", part="part", most=most).count() == 0


def test_window_dedup_of_one_dense_history(spark):
    """Many rows a day for years, and no gap: candidates are as many as days, not as rows."""
    rows = spark.range(400_000).select(F.lit("p").alias("player"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 2000).cast("int")).alias("day"), F.lit("sprain").alias("kind"), "id")
    got = window_dedup.window_dedup(rows, ["player"], "day", "kind", "id", follows=())
    assert sorted(r.id for r in got.collect()) == list(range(0, 2000, 31))


def observation(d, kind="sprain", part="ankle", side="left", team=1, source=None, status="Out", reason="left ankle sprain"):
    o = {"entity": 1, "team": team, "day": day(d), "report_day": day(d), "report_time": 0, "condition": 1, "status": status, "part": part, "laterality": side, "kind": kind, "reason": reason}
    return o | {"source": source if source is not None else hash((d, kind, side, team, status))}


OBSERVED = "entity long, team long, day date, report_day date, report_time long, source long, condition long, status string, part string, laterality string, kind string, reason string"


def observed(spark, rows):
    names = OBSERVED.replace(",", "").split()[::2]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], OBSERVED)


def test_episode_rules(spark):
    cases = [
        ([2], [observation("2024-01-01"), observation("2024-01-15")]),  # the same reason within 14 days
        ([1, 1], [observation("2024-01-01"), observation("2024-01-16")]),
        ([1, 1], [observation("2024-01-01"), observation("2024-01-05", side="right", reason="x")]),
        ([1, 1], [observation("2024-01-01"), observation("2024-01-02", team=2)]),
        ([1, 1], [observation("2024-01-01", source=1), observation("2024-01-01", source=1)]),
        ([1, 1], [observation("2024-01-01", status="Available"), observation("2024-01-02")]),
        ([3], [observation("2024-01-01", status="Available", source=1), observation("2024-01-01", status="Out", source=2), observation("2024-01-02")]),
        ([2], [observation("2024-01-01", kind="soreness", reason="a"), observation("2024-01-04", kind="pain", reason="b")]),
        ([1, 1], [observation("2024-01-01", kind="fracture", reason="a"), observation("2024-01-02", kind="pain", reason="b")]),
        ([2], [observation("2024-01-01", kind="fracture", reason="a"), observation("2024-01-02", kind="surgery", reason="b")]),
        ([2], [observation("2024-01-01", kind="fracture", reason="a"), observation("2024-01-02", kind="recovery", reason="b")]),
        ([1, 1], [observation("2024-01-01", kind="injury", reason="a"), observation("2024-01-05", kind="pain", reason="b")]),  # unspecific: 3 days
        ([2], [observation("2024-01-01", kind=None, part=None, side=None, reason="a"), observation("2024-01-03", kind=None, part=None, side=None, reason="b")]),
        ([1, 1], [observation("2024-01-01", kind="sprain", reason="acl sprain"), observation("2024-01-02", kind="sprain", reason="mcl sprain")]),  # other structures
        ([2], [observation("2024-01-01", kind="ACL injury", part="knee"), observation("2024-01-02", kind="ACL tear", part="knee")]),
    ]
    rows = [o | {"entity": i, "report_time": t} for i, (_, case) in enumerate(cases) for t, o in enumerate(case)]
    got = {}
    for r in episodes.build_episodes(observed(spark, rows)).orderBy("entity", "episode").collect():
        got.setdefault(r.entity, []).append(r)
    assert [[e.n for e in got[i]] for i in range(len(cases))] == [n for n, _ in cases]
    assert got[len(cases) - 1][0].kind == "ACL tear"


def test_episodes_of_cut_histories_equal_the_whole_fold(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(160):
        d = rng.randint(0, 400)
        rows.append(observation("2024-01-01", kind=rng.choice(["sprain", "pain", None]), part=rng.choice(["ankle", None]), side=rng.choice(["left", None]), source=i % 40, status=rng.choice(["Out", "Available"]), reason=rng.choice(["a", "b"])) | {"entity": i % 2, "report_day": day("2024-01-01") + datetime.timedelta(d), "day": day("2024-01-01") + datetime.timedelta(d - rng.randint(0, 3)), "condition": i, "report_time": i})
    df = observed(spark, rows)
    runs = latest.episodes_by_gap(df, ["entity"], "report_day", "report_time", episodes.REACH["reason"])
    assert runs.select("entity", "episode").distinct().count() > 5
    result = lambda **k: sorted(tuple(r) for r in episodes.build_episodes(df, **k).select("entity", "episode", "start", "last", "n").collect())
    assert result() == result(run_gap=10_000) and sum(r[4] for r in result()) == 160


def test_one_long_entity_folds_in_groups_of_bounded_size(spark):
    rows = [observation("2000-01-01", source=i) | {"report_time": i, "day": day("2000-01-01") + datetime.timedelta(15 * i), "report_day": day("2000-01-01") + datetime.timedelta(15 * i)} for i in range(300)]
    df = observed(spark, rows)
    assert latest.episodes_by_gap(df, ["entity"], "report_day", "report_time", 14).groupBy("episode").count().agg(F.max("count")).first()[0] == 1
    assert episodes.build_episodes(df).count() == 300


def brute_match(left, right, days=7):
    best = None
    for k in range(min(len(left), len(right)), -1, -1):
        for a in combinations(range(len(left)), k):
            for b in combinations(range(len(right)), k):
                pairs = list(zip(a, b, strict=True))
                if all(abs((left[i]["day"] - right[j]["day"]).days) <= days for i, j in pairs):
                    costs = [matching._cost(left[i], right[j]) for i, j in pairs]
                    key = (-k, tuple(map(sum, zip(*costs, strict=True))) if costs else (0,) * 5, [(left[i]["id"], right[j]["id"]) for i, j in pairs], pairs)
                    best = key if best is None else min(best, key)
        if best is not None:
            return best[3]
    return []


def test_matching_is_optimal():
    import random

    rng = random.Random(4)
    for _ in range(60):
        side = lambda: sorted(({"id": (i * 7 + 3) % 5, "day": day("2024-01-01") + datetime.timedelta(rng.randint(0, 25)), "part": rng.choice([None, "leg", "shin"]), "kind": rng.choice([None, "pain", "sprain"]), "laterality": rng.choice([None, "left"]), "reason": rng.choice(["a b", "a c"])} for i in range(rng.randint(0, 4))), key=lambda e: (e["day"], e["id"]))
        a, b = side(), side()
        assert matching.assign(a, b) == brute_match(a, b)


def test_optimal_match_query_offers_every_out_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").collect()
    out = {r.event_id for r in events if r.event_type != "purchase"}
    got = {r.right_id for r in queries.QUERIES["optimal_match"](spark, sf_dir).collect()}
    assert got <= out and any(i % 5 for i in got)


def test_optimal_match_in_runs_equals_the_whole_key(spark):
    import random

    rng = random.Random(8)
    schema = "key long, id long, day date, part string, kind string, laterality string, reason string"
    side = lambda: [(i % 3 or None, i, day("2024-01-01") + datetime.timedelta(rng.randint(0, 60)), rng.choice([None, "leg", "shin"]), rng.choice([None, "pain", "sprain"]), rng.choice([None, "left"]), rng.choice(["a b", "a c"])) for i in range(24)]
    a, b = side(), side()
    frame = lambda rows: spark.createDataFrame([*rows, (1, 99, None, None, None, None, None)], schema)
    got = {(r.key, r.left_id, r.right_id) for r in matching.optimal_match(frame(a), frame(b)).collect()}
    want = set()
    for key in (1, 2, None):
        x, y = (sorted((dict(zip(schema.replace(",", "").split()[::2], r, strict=True)) for r in rows if r[0] == key), key=lambda e: (e["day"], e["id"])) for rows in (a, b))
        want |= {(key, x[i]["id"], y[j]["id"]) for i, j in whole_match(x, y)}
    assert got == want


def whole_match(left, right, days=7):
    """The matching over all pairs of rows, without runs or bands."""
    none = (0, (0,) * 5, (), ())
    best = {}
    for i in range(len(left), -1, -1):
        for j in range(len(right), -1, -1):
            options = [best.get((i + 1, j), none), best.get((i, j + 1), none)]
            if i < len(left) and j < len(right) and abs((left[i]["day"] - right[j]["day"]).days) <= days:
                n, cost, ids, pairs = best.get((i + 1, j + 1), none)
                options.append((n - 1, tuple(map(sum, zip(cost, matching._cost(left[i], right[j]), strict=True))), ((left[i]["id"], right[j]["id"]), *ids), ((i, j), *pairs)))
            best[i, j] = min(options)
    return best[0, 0][3]


def test_matching_of_long_dense_sides_is_optimal():
    import random

    rng = random.Random(5)
    side = lambda n: sorted(({"id": (i * 7 + 3) % 31, "day": day("2024-01-01") + datetime.timedelta(rng.randint(0, 40)), "part": None, "kind": rng.choice(["pain", "sprain"]), "laterality": None, "reason": rng.choice(["a", "b", "a"])} for i in range(n)), key=lambda e: (e["day"], e["id"]))
    for _ in range(10):
        a, b = side(rng.randint(0, 30)), side(rng.randint(0, 30))
        assert matching.assign(a, b) == list(whole_match(a, b))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_in_blocks_equals_the_whole_history(spark, seed):
    """Histories of months without a gap, ids that rise with no day, many ties: block by block as in one piece."""
    import random

    rng = random.Random(seed)
    schema = "key long, id long, day date, part string, kind string, laterality string, reason string"
    side = lambda n: [(i % 2 or None, 1000 - i if i % 3 else i, day("2024-01-01") + datetime.timedelta(rng.randint(0, 70)), rng.choice([None, "leg", "shin"]), rng.choice(["pain", "sprain"]), None, rng.choice(["a b", "a c"])) for i in range(n)]
    a, b = side(160), side(130)
    got = {(r.key, r.left_id, r.right_id) for r in matching.optimal_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), most=20).collect()}
    want = set()
    for key in (1, None):
        x, y = (sorted((dict(zip(schema.replace(",", "").split()[::2], r, strict=True)) for r in rows if r[0] == key), key=lambda e: (e["day"], e["id"])) for rows in (a, b))
        want |= {(key, x[i]["id"], y[j]["id"]) for i, j in matching.assign(x, y)}
    assert got == want and len(got) > 80


# --- writes


def test_supersede_is_idempotent_and_rejects_late_rows(spark):
    schema = "game string, row int, at int, status string"
    old = spark.createDataFrame([("g1", 1, 5, "Out"), ("g1", 2, 5, "Out"), ("g2", 3, 9, "Out")], schema)
    new = spark.createDataFrame([("g1", 4, 6, "In"), ("g2", 5, 8, "In"), ("g3", 6, 1, "In")], schema)
    state = lambda df: sorted(map(tuple, df.collect()))
    once = upsert.supersede(old, new, ["game"], ["row"], "at")
    assert state(once) == [("g1", 4, 6, "In"), ("g2", 3, 9, "Out"), ("g3", 6, 1, "In")]
    assert state(upsert.supersede(once, new, ["game"], ["row"], "at")) == state(once)
    same = spark.createDataFrame([("g1", 4, 6, "Out"), ("g1", 7, 6, "Out")], schema)
    assert state(upsert.supersede(once, same, ["game"], ["row"], "at"))[:2] == [("g1", 4, 6, "Out"), ("g1", 7, 6, "Out")]


def test_stream_equals_batch(spark, tmp_path):
    schema = "game string, row int, at int, status string"
    source = f"{tmp_path}/in"
    batches = [[("g1", 1, 5, "Out"), ("g2", 3, 9, "Out")], [("g1", 4, 6, "In"), ("g2", 5, 8, "In")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = supersede_stream.supersede_stream(stream, f"{tmp_path}/state", f"{tmp_path}/ck", ["game"], ["row"], "at")
        assert query.awaitTermination(60)
    got = sorted(map(tuple, supersede_stream.current(spark, f"{tmp_path}/state", spark.createDataFrame([], schema).schema).collect()))
    assert got == [("g1", 4, 6, "In"), ("g2", 3, 9, "Out")]


def test_supersede_stream_rewrites_the_buckets_of_its_subjects_only(spark, tmp_path):
    schema = "game string, row long, at long, status string"
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    batches = [[(f"g{i}", i, 1, "Out") for i in range(40)], [("g3", 3, 2, "In")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert supersede_stream.supersede_stream(stream, state, f"{tmp_path}/ck", ["game"], ["row"], "at", buckets=8).awaitTermination(60)
    got = sorted(map(tuple, supersede_stream.current(spark, state, stream.schema).collect()))
    assert got == sorted([r for r in batches[0] if r[1] != 3] + batches[1])
    written = [sorted(os.listdir(f"{state}/{v}")) for v in ("v0", "v1")]
    assert [sum(name.startswith("_bucket=") for name in names) for names in written] == [8, 1]


def test_flag_verdict(spark):
    games = [("a", "playoffs", True), ("a", "regular", False), ("a", "play_in", True), ("b", "playoffs", True), ("b", "playoffs", False), ("b", "play_in", False), ("c", "play_in", None), ("c", "preseason", False), ("d", "regular", None)]
    df = spark.createDataFrame(games, "season string, kind string, flag boolean")
    got = {r.season: (r.flagged_kinds, r.plain_playoffs, r.reproducible) for r in admission.flag_verdict(df, ["season"], "kind", "flag").collect()}
    assert got == {"a": ("play_in", 0, False), "b": ("", 1, True), "c": ("", 0, False), "d": ("", 0, True)}


def test_serve_rejects_bad_parameters(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    with pytest.raises(ValueError):
        serve.page(df, [F.col("o_orderkey")], 0)
    with pytest.raises(ValueError):
        serve.page(df, [F.col("o_orderkey")], 1, 501)
    with pytest.raises(ValueError):
        serve.choices(["2031-32"], ["2024-25"])
    assert serve.choices([" Regular Season "], ["regular"], {"Regular Season": "regular"}) == ["regular"]
    a, b = (serve.page(df, [F.col("o_orderkey")], i, 50).collect() for i in (1, 2))
    assert len(a) == len(b) == 50 and not {r.o_orderkey for r in a} & {r.o_orderkey for r in b}


# --- sources


def test_transactions(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('Date,Team,Acquired,Relinquished,Notes\n2024-01-05,A,, • X ,"note, with comma"\n1/5/2024,A,, • X ,"note, with comma"\nsoon,A,,Y,n\n2024-01-06,A,B\n2024-01-07,A,B,C,D,E\n')
    rows, invalid = files.transactions(spark, path, "il")
    got = rows.collect()
    assert len(got) == 2 and len({r.source_row_key for r in got}) == 1 and got[0].acquired == "" and got[0].notes == "note, with comma"
    assert invalid.count() == 3


def test_games(spark):
    log = [("1", "AAA", "2024-01-01", "AAA @ BBB"), ("1", "BBB", "2024-01-01", "BBB vs. AAA"), ("2", "AAA", "2024-01-02", "AAA @ BBB"), ("3", "AAA", "2024-01-03", "AAA @ CCC"), ("3", "BBB", "2024-01-03", "BBB vs. AAA")]
    got = files.games(spark.createDataFrame(log, "GAME_ID string, TEAM_ABBREVIATION string, GAME_DATE string, MATCHUP string")).collect()
    assert [(r.game_id, r.matchup, r.season) for r in got if r.game_id != "3"] == [("1", "AAA@BBB", "2023-24")]


def test_url_inventory(spark):
    got = files.url_inventory(spark, "2025-12-21", "2025-12-22", "https://x/r_", "2025-12-22")
    assert {r.day.isoformat(): r["count"] for r in got.groupBy("day").count().collect()} == {"2025-12-21": 24, "2025-12-22": 96}


def test_layout(spark):
    words = [("d", 1, 10.0, 100.0, "Team"), ("d", 1, 60.0, 100.5, "Status"), ("d", 1, 11.0, 120.0, "A"), ("d", 1, 61.0, 121.0, "Out"), ("d", 1, 70.0, 121.9, "today"), ("d", 1, 61.0, 140.0, "In")]
    placed = layout.lines(spark.createDataFrame(words, "doc_id string, page int, x0 double, top double, text string"))
    headers = spark.createDataFrame([("d", [9.0, 59.0], ["team", "status"])], "doc_id string, starts array<double>, names array<string>")
    cells = layout.cells(placed, headers).where("line > 1")
    rows = cells.groupBy("doc_id", "page", "line").pivot("column", ["team", "status"]).agg(F.first("text"))
    got = layout.inherit(rows, ["team"]).orderBy("line").collect()
    assert [(r.team, r.status) for r in got] == [("A", "Out today"), ("A", "In")]


def test_outline_decodes_whole_references_only(spark):
    html = ["<title>a &amp;&amp;\n b&amp</title><a href=x>1</a><abbr>", "<title>t=&quot;1&quot; &lt;b&gt; &am</title><a href='n'>Next</a><a >", "<p>", None]
    got = layout.outline(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(0, "a && b&amp", 1, [], None), (1, "t=&quot;1&quot; <b> &am", 2, [], "n"), (2, "", 0, [], None), (3, None, None, [], None)]


def test_results_table(spark):
    good = "<table><tr><th>Date</th><th>Team</th></tr><tr><td>1</td><td>&nbsp;A <b>x</b></td></tr></table>"
    df = lambda h: spark.createDataFrame([(1, h)], "page_id long, html string")
    assert [tuple(r) for r in layout.results_table(df(good), ("Date", "Team")).collect()] == [(1, 0, "1", "A x")]
    with pytest.raises(Exception, match="unexpected table layout"):
        layout.results_table(df(good.replace("Date", "Day")), ("Date", "Team")).collect()


def test_phases(spark):
    days = ["2020-08-15", "2020-08-16", "2024-04-15", "2024-04-16", "2026-06-13"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select(lookup.season_phase(F.col("d")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in got] == [("2019-20", "play_in"), None, None, ("2023-24", "play_in"), ("2025-26", "playoffs")]


def test_latest_ties(spark):
    rows = [("a", 1, "2024-01-01 10:00:00", 9), ("a", 2, "2024-01-01 10:00:00", 3), ("b", 3, "2024-01-01 09:00:00", 1)]
    df = spark.createDataFrame(rows, "k string, v int, at string, tie int").withColumn("at", F.to_timestamp("at"))
    assert sorted((r.k, r.v) for r in latest.latest_per_key(df, ["k"], "at", "tie").collect()) == [("a", 2), ("b", 3)]
    assert os.path.isdir("/root/testdata")


@pytest.mark.parametrize(
    "reason, want",
    [
        ("Left Hip; Strain, Right Hip; Soreness", [("hip", "left", "strain"), ("hip", "right", "soreness")]),
        ("Right quadriceps soreness/Left hip contusion", [("quadriceps", "right", "soreness"), ("hip", "left", "contusion")]),
        ("Left Groin; Soreness / G League Assignment", [("groin", "left", "soreness"), (None, None, None)]),
        ("Right Foot; inflammation & not with team, self-isolating", [("foot", "right", "inflammation"), (None, None, None)]),
        ("N/A; Illness (G League - two way)", [("illness", None, "illness"), (None, None, None)]),
        ("Fractured Third Finger, Left Hand", [("hand", "left", "fracture")]),
        ("Right Foot/Ankle; Sprain", [("ankle", "right", "sprain")]),
        ("Illness/Infection", [("illness", None, "infection")]),
        ("Nasal; Fracture / Face Mask", [("face", None, "fracture")]),
        ("Right Knee ACL/MCL; Sprain", [("knee", "right", "ACL injury"), ("knee", "right", "MCL injury")]),
        ("Mask", [(None, None, "protective equipment")]),
        ("TOS", [(None, None, "thoracic outlet syndrome")]),
    ],
)
def test_conditions(spark, reason, want):
    c = spark.createDataFrame([(f"Injury/Illness - {reason}",)], "r string").select(X.conditions(F.col("r"), F.lit("Injury/Illness")).alias("c")).first().c
    assert [(x.body_part, x.laterality, x.injury_type) for x in c] == want


def test_two_digit_years(spark):
    got = spark.createDataFrame([("1/5/69",), ("1/5/68",), ("1/5/2024",)], "r string").select(dates.parse(F.col("r"), "M/d/yyyy", "M/d/yy").cast("string").alias("d")).collect()
    assert [r.d for r in got] == ["1969-01-05", "2068-01-05", "2024-01-05"]
