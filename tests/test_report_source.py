"""Report documents from positioned words: layouts, inherited context, wrapped cells and unreadable documents."""

import datetime

from snapfold.sources import report

LEGACY = {"Game Date": 20, "Game Time": 73, "Matchup": 126, "Team": 179, "Player Name": 269, "Category": 382, "Reason": 495, "Current Status": 607, "Previous Status": 720}
COMPACT = {"Game Date": 24, "Game Time": 120, "Matchup": 200, "Team": 265, "Player Name": 426, "Current Status": 587, "Reason": 667}


def document(spark, pages, doc="d"):
    """Words of pages of (x, top, text) cells, a word every 4.5 points a letter."""
    rows = []
    for p, cells in enumerate(pages, 1):
        for x, top, text in cells:
            for word in text.split():
                rows.append((doc, p, float(x), float(top), word))
                x += 4.5 * (len(word) + 1)
    return spark.createDataFrame(rows, "doc_id string, page int, x0 double, top double, text string")


def head(layout):
    return [(260, 40, "Injury Report: 12/23/18 01:30 PM"), *((x, 80, name) for name, x in layout.items())]


def test_categories_wrapped_teams_and_teams_without_players(spark):
    x = list(LEGACY.values())
    page = [
        *head(LEGACY),
        (x[0], 100, "12/23/2018"), (x[1], 100, "07:00 (ET)"), (x[2], 100, "AAA@BBB"), (x[3], 100, "Alpha Ants"), (x[4], 100, "One, Adam"), (x[5], 100, "Injury/Illness"), (x[6], 100, "Sore Knee"), (x[7], 100, "Out"), (x[8], 100, "-"),
        (x[3], 118, "Beta Bees"), (x[5], 118, "ALL PLAYERS AVAILABLE"),
        (x[1], 140, "08:30 (ET)"), (x[2], 140, "CCC@DDD"), (x[3], 140, "Gamma"), (x[4], 140, "Two, Ben"), (x[5], 140, "Rest"), (x[7], 140, "Doubtful"), (x[8], 140, "Out"),
        (x[3], 148, "Gnats"),
        (x[4], 160, "Three, Carl"), (x[5], 160, "Injury/Illness"), (x[6], 160, "Left"), (x[7], 160, "Out"), (x[8], 160, "-"),
        (x[6], 168, "Ankle Sprain"),
        (x[3], 190, "Delta Dogs"), (x[5], 190, "NOT YET SUBMITTED"),
    ]
    got = report.entries(document(spark, [page])).orderBy("row_number").collect()
    assert [(r.team, r.player_name, r.status, r.raw_reason, r.reason_category, r.entry_type) for r in got] == [
        ("Alpha Ants", "One, Adam", "Out", "Injury/Illness - Sore Knee", "Injury/Illness", "player"),
        ("Beta Bees", None, None, "ALL PLAYERS AVAILABLE", None, "all_available"),
        ("Gamma Gnats", "Two, Ben", "Doubtful", "Rest", "Rest", "player"),
        ("Gamma Gnats", "Three, Carl", "Out", "Injury/Illness - Left Ankle Sprain", "Injury/Illness", "player"),
        ("Delta Dogs", None, None, "NOT YET SUBMITTED", "NOT YET SUBMITTED", "not_submitted"),
    ]
    assert [(r.matchup, r.game_time) for r in got] == [("AAA@BBB", 25200)] * 2 + [("CCC@DDD", 30600)] * 3
    assert got[0].previous_status == "-" and got[2].previous_status == "Out" and {r.format_version for r in got} == {"legacy-category-v1"}
    assert got[3].raw_row_text == "Three, Carl Injury/Illness Left Out - Ankle Sprain" and got[2].raw_row_text.endswith("Out Gnats")


def test_pages_without_a_header_and_reasons_above_their_row(spark):
    x = list(COMPACT.values())
    first = [
        *head(COMPACT),
        (x[6], 98, "Injury/Illness - Right Toe;"), (x[0], 105, "04/12/2026"), (x[1], 105, "06:00 (ET)"), (x[2], 105, "AAA@BBB"), (x[3], 105, "Alpha Ants"), (x[4], 105, "One, Adam"), (x[5], 105, "Out"), (x[6], 112, "Sprain"),
        (x[4], 140, "Two, Ben"), (x[5], 140, "Available"), (x[6], 140, "G League - Two-Way"),
        (300, 560, "Page 1 of 2"),
    ]
    second = [
        (260, 40, "Injury Report: 12/23/18 01:30 PM"), (x[3], 100, "Beta Bees"), (x[4], 100, "Three, Carl"), (x[5], 100, "Questionable"), (x[6], 100, "Injury/Illness - Foot; Soreness"),
        (x[6], 125, "Injury/Illness - Left Ankle;"), (x[4], 130, "Four, Dan"), (x[5], 130, "Out"), (x[6], 135, "Sprain"),
    ]
    words = document(spark, [first, second])
    got = report.entries(words).orderBy("row_number").collect()
    assert [(r.page_number, r.team, r.player_name, r.reason_category, r.raw_reason) for r in got] == [
        (1, "Alpha Ants", "One, Adam", "Injury/Illness", "Injury/Illness - Right Toe; Sprain"),
        (1, "Alpha Ants", "Two, Ben", "G League", "G League - Two-Way"),
        (2, "Beta Bees", "Three, Carl", "Injury/Illness", "Injury/Illness - Foot; Soreness"),
        (2, "Beta Bees", "Four, Dan", "Injury/Illness", "Injury/Illness - Left Ankle; Sprain"),
    ]
    assert {r.format_version for r in got} == {"compact-v3"} and {str(r.game_date) for r in got} == {"2026-04-12"}
    assert report.date_matchups(words).count() == 1


def test_documents_say_what_is_wrong_with_them(spark):
    good = [*head(COMPACT), (24, 105, "04/12/2026"), (200, 105, "AAA@BBB"), (265, 105, "Ants"), (426, 105, "One, Adam"), (587, 105, "Out")]
    odd = [c if c[2] != "Out" else (587, 105, "Perhaps") for c in good]
    cut = [c for c in good if c[2] != "Matchup"]
    docs = {"good": [good], "odd": [odd], "cut": [cut], "late": [good[:1], good[1:]], "blank": [good[:8]]}
    words = None
    for name, pages in docs.items():
        words = document(spark, pages, name) if words is None else words.union(document(spark, pages, name))
    got = {r.doc_id: r for r in report.documents(words).collect()}
    assert {k: r.problem for k, r in got.items()} == {"good": None, "odd": "unknown status", "cut": "incomplete table header", "late": "no table header on the first page", "blank": "no entries"}
    assert got["good"].published == datetime.datetime(2018, 12, 23, 13, 30)


def test_every_layout_has_a_version(spark):
    names = "Game_Date Game_Time Matchup Team Player_Name".split()
    orders = {
        "standard-v2": ["Current_Status", "Reason"], "legacy-reason-first-v1c": ["Reason", "Current_Status", "Previous_Status"], "legacy-current-previous-v1d": ["Current_Status", "Reason", "Previous_Status"],
        "legacy-status-history-v1b": ["Current_Status", "Reason", "Previous_Status", "Previous_Reason"],
    }
    for version, rest in orders.items():
        cells = [(20 + 75 * i, 80, n.replace("_", " ")) for i, n in enumerate([*names, *rest])]
        words = document(spark, [[(260, 40, "Injury Report: 12/23/18 01:30 PM"), *cells]])
        assert report.documents(words).first().format_version == version
