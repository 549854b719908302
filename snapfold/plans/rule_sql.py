"""SQL written from the rule tables, and made-up reasons and notes that touch every rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapfold.functions import rules
from snapfold.operators import episodes

#: Different texts that the queries draw from.
DRAWN = 4096


def _terms(*tables: str) -> list[str]:
    """Every plain term of the tables; both halves of a joint one."""
    return [t for table in tables for _, terms in rules.lines(table) for t in (" ".join(re.split("[&+]", x)).strip("; ") for x in terms)]


_SIDES = ("", "Left ", "Right ", "Bilateral ", "Left and Right ")
_PLACES = ["N/A", "Head Office", *map(str.title, _terms(rules.ANATOMY))]
_STATES = ["", "mask", *_terms(rules.CONDITION_FIRST, rules.CONDITION_THEN), *rules.RECOVERY, *rules.PROCEDURE, "acl tear", "mcl", "pcl surgery", "mcl rehab"]
_OPENINGS = ("Injury/Illness - ", "", "Injury/Illness -  ")
_STARTS = ("placed on IL with ", "recovering from surgery on ", "")
_NOTED = ["left team", "acl", "mcl", "pcl", "achilles", "calf", *_terms(rules.NOTE_PARTS)]
_NOTED_STATES = ["", "torn ", "reconstructed ", *(f"{t} " for t in _terms(rules.NOTE_CONDITIONS))]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Draw:
    """One text of several lists by a number: as a Spark column, and as SQL of the same number ``n``."""

    def __init__(self, *parts: tuple[list[str] | tuple[str, ...], int, int]):
        self.parts = parts  # (texts, factor, divisor)

    def column(self, n: Column) -> Column:
        at = lambda texts, factor, by: (F.pmod(F.floor(n * factor / by), F.lit(len(texts))) + 1).cast("int")
        return F.concat(*(F.element_at(F.array(*map(F.lit, texts)), at(texts, factor, by)) for texts, factor, by in self.parts))

    def sql(self) -> str:
        return " || ".join(f"[{', '.join(map(_q, texts))}][n * {factor} // {by} % {len(texts)} + 1]" for texts, factor, by in self.parts)


REASONS = Draw((_OPENINGS, 1, 1), (_SIDES, 1, 3), (_PLACES, 1, 1), (("; ",), 1, 1), (_STATES, 1, 2))
OTHERS = Draw((("", "Injury/Illness - "), 1, 2), (rules.NON_INJURY + ("TOS", "Mask", "G League - Two-Way", ""), 1, 11))
NOTES = Draw((_STARTS, 1, 7), (("left ", ""), 1, 2), (_NOTED_STATES, 1, 2), (_NOTED, 1, 1))


def drawn_reason(n: Column) -> Column:
    return F.when(n % 11 == 0, OTHERS.column(n)).otherwise(REASONS.column(n))


def _holds(term: str, part: str) -> str:
    if "&" in term:
        return "(" + " AND ".join(f"contains(t, {_q(x)})" for x in term.split("&")) + ")"
    if "+" in term:
        text, place = term.split("+")
        return f"(contains(t, {_q(text)}) AND coalesce({part} = {_q(place)}, false))"
    return f"contains(t, {_q(term)})"


def _any(terms, part: str = "part") -> str:
    return "(" + " OR ".join(_holds(t, part) for t in terms) + ")"


def _token(terms) -> str:
    return "regexp_matches(t, " + _q("(^|[^a-z0-9])(" + "|".join(map(re.escape, terms)) + ")($|[^a-z0-9])") + ")"


def _whens(table: str, test) -> str:
    return " ".join(f"WHEN {test(terms)} THEN {_q(label)}" for label, terms in rules.lines(table))


def reasons_sql() -> str:
    recovery, procedure = _any(rules.RECOVERY), _any(rules.PROCEDURE)
    ligaments = " ".join(
        f"WHEN {_any(terms)} THEN CASE WHEN {recovery} THEN 'recovery' WHEN {procedure} THEN 'surgery' WHEN {_any(('tear', 'rupture'))} THEN '{name} tear' ELSE '{name} injury' END"
        for name, terms in rules.LIGAMENTS.items()
    )
    then = ""
    for label, terms in rules.lines(rules.CONDITION_THEN):
        also = [f"trim(t) = {_q(text)}" for text, name in rules.WHOLE_REASONS.items() if name == label]
        if label == "protective equipment":
            also.append(f"(coalesce(part = 'face', false) AND {_token(['mask'])})")
        then += f" WHEN {' OR '.join([_any(terms), *also])} THEN {_q(label)}"
    kind = f"CASE {ligaments} {_whens(rules.CONDITION_FIRST, _any)} WHEN {recovery} THEN 'recovery' WHEN {procedure} THEN 'surgery'{then} END"
    return rf"""WITH r AS (SELECT n, CASE WHEN n % 11 = 0 THEN {OTHERS.sql()} ELSE {REASONS.sql()} END AS reason FROM range({DRAWN}) AS x(n)),
l AS (SELECT n, replace(lower(trim(regexp_replace(reason, '\s+', ' ', 'g'))), 'n/a', 'unspecified') AS s FROM r),
d AS (SELECT n, contains(s, 'injury/illness') AS stated, regexp_replace(s, '^injury/illness\s*-\s*', '') AS t FROM l),
p AS (SELECT *, CASE {_whens(rules.ANATOMY, _token)} END AS part FROM d), k AS (SELECT *, {kind} AS kind FROM p),
c AS (SELECT n, coalesce(part, CASE WHEN kind = 'illness' THEN 'illness' END) AS body_part,
CASE WHEN regexp_matches(t, '\bbilateral\b|\bleft and right\b|\bright and left\b|\bboth\b') THEN 'bilateral' WHEN regexp_matches(t, '\bleft\b') THEN 'left' WHEN regexp_matches(t, '\bright\b') THEN 'right' END AS laterality,
kind AS injury_type, NOT {_token(rules.NON_INJURY)} AND (stated OR part IS NOT NULL OR kind IS NOT NULL) AS is_injury FROM k)
SELECT event_id, body_part, laterality, injury_type, is_injury FROM events JOIN c ON event_id % {DRAWN} = n"""


def notes_sql() -> str:
    torn = _any(("torn", "tear", "ruptured"))
    special = [("knee", rules.LIGAMENTS["ACL"], f"CASE WHEN {torn} OR {_any(['reconstruct'])} THEN 'ACL tear' ELSE 'ACL injury' END")]
    special += [("knee", rules.LIGAMENTS[x], f"CASE WHEN {torn} THEN '{x} tear' ELSE '{x} injury' END") for x in ("MCL", "PCL")]
    special += [("achilles", ("achilles",), f"CASE WHEN {torn} THEN 'tear' ELSE 'achilles injury' END")]
    calf = (("strain", ["strain"]), ("tear", ["tear", "torn"]), ("soreness", ["sore"]), ("sprain", ["sprain"]))
    special += [("calf", ("calf",), "CASE " + " ".join(f"WHEN {_any(terms)} THEN {_q(label)}" for label, terms in calf) + " ELSE 'injury' END")]
    recovery = _any(("recovering from surgery", "placed on il recovering from"))
    healed = " ".join(f"WHEN {_any(terms)} THEN {_q(name)}" for name, terms in (("achilles", ["achilles"]), ("knee", ["acl", "knee"]), ("calf", ["calf"])))
    parts = " ".join(f"WHEN {_any(terms)} THEN {_q(name)}" for name, terms, _ in special)
    types = " ".join(f"WHEN {_any(terms)} THEN {label}" for _, terms, label in special)
    return f"""WITH r AS (SELECT n, lower({NOTES.sql()}) AS t FROM range({DRAWN}) AS x(n)), p AS (SELECT *, CASE {_whens(rules.NOTE_PARTS, _any)} END AS part FROM r),
k AS (SELECT *, CASE {_whens(rules.NOTE_CONDITIONS, _any)} ELSE 'injury' END AS kind FROM p),
c AS (SELECT n, CASE WHEN {recovery} THEN CASE {healed} END {parts} WHEN kind = 'illness' THEN 'illness' ELSE part END AS body_part, CASE WHEN {recovery} THEN 'recovery' {types} ELSE kind END AS injury_type FROM k)
SELECT event_id, body_part, injury_type FROM events JOIN c ON event_id % {DRAWN} = n"""


def episodes_sql(observations: str) -> str:
    """Episodes of a query's observations: one recursive step for each report of an entity, over a list of its episodes."""
    vague = "(e.kind IS NULL OR o.kind IS NULL OR e.kind IN {0} OR o.kind IN {0})".format(episodes.UNSPECIFIC)
    pairs = ", ".join(f"{_q('|'.join(pair))}: {score}" for pair, score in episodes.pair_scores().items())
    finer = ", ".join(f"{_q(kind)}: [{', '.join(map(_q, kinds))}]" for kind, kinds in episodes.FINER.items())
    listed = f"coalesce(MAP {{{pairs}}}[least(e.kind, o.kind) || '|' || greatest(e.kind, o.kind)], CASE WHEN 'recovery' IN (e.kind, o.kind) THEN {episodes.RECOVERED} END)"
    score = f"CASE WHEN e.kind IS NOT DISTINCT FROM o.kind THEN {episodes.SAME} WHEN {vague} THEN {episodes.VAGUE} ELSE {listed} END"
    reach = episodes.REACH
    days = f"CASE WHEN {vague} AND e.kind IS DISTINCT FROM o.kind THEN {reach['unspecific']} ELSE {reach['kind']} END"
    gap = "(o.report_day - e.report_day)"
    agree = " AND ".join(f"coalesce(e.{c} = o.{c}, true)" for c in ("laterality", "team", "part", "structure"))
    likeness = f"""CASE WHEN {gap} < 0 OR {gap} > {reach["reason"]} OR list_contains(e.sources, o.source) OR NOT coalesce(o.day <= e.available, true) OR NOT ({agree}) THEN NULL
WHEN e.reason IS NOT DISTINCT FROM o.reason THEN 200 - {gap}
WHEN ({score}) IS NOT NULL AND {gap} <= ({days}) AND e.part = o.part THEN 100 + ({score}) + CASE WHEN e.laterality IS NOT DISTINCT FROM o.laterality THEN 20 ELSE 0 END - {gap}
WHEN e.part IS NULL AND o.part IS NULL AND e.kind IS NOT DISTINCT FROM o.kind AND {gap} <= {reach["unspecific"]} THEN 40 - {gap} END"""
    fields = ("team", "start", "last", "report_day", "part", "laterality", "structure", "kind", "reason", "status", "available", "sources", "n")
    struct = lambda values: "{" + ", ".join(f"'{f}': {values.get(f, f'o.{f}')}" for f in fields) + "}"
    back = "lower(coalesce(o.status, '')) = 'available'"
    begun = struct({"start": "o.day", "last": "o.day", "available": f"CASE WHEN {back} THEN o.day END", "sources": "[o.source]", "n": "1"})
    more = {c: f"coalesce(e.{c}, o.{c})" for c in ("part", "laterality", "structure")} | {c: f"e.{c}" for c in ("team", "start", "reason")}
    more |= {"kind": f"CASE WHEN e.kind IS NULL OR coalesce(list_contains(MAP {{{finer}}}[e.kind], o.kind), false) THEN coalesce(o.kind, e.kind) ELSE e.kind END", "last": "greatest(e.last, o.day)"}
    more |= {"available": f"CASE WHEN {back} THEN coalesce(e.available, o.day) WHEN e.available IS NOT DISTINCT FROM o.day THEN NULL ELSE e.available END"}
    joined = struct(more | {"sources": "list_append(e.sources, o.source)", "n": "e.n + 1"})
    return f"""WITH RECURSIVE x AS ({observations}),
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY report_day, report_time, day, source) AS k FROM x WHERE entity IS NOT NULL),
f AS (SELECT entity, k, [{begun}] AS es FROM o WHERE k = 1
UNION ALL SELECT o.entity, o.k, CASE WHEN best IS NULL THEN list_append(es, {begun}) ELSE list_transform(es, lambda e, i: CASE WHEN i = best THEN {joined} ELSE e END) END
FROM (SELECT *, CASE WHEN list_max(fits) IS NOT NULL THEN list_position(fits, list_max(fits)) END AS best
FROM (SELECT o, es, list_transform(es, lambda e: {likeness}) AS fits FROM f JOIN o ON o.entity = f.entity AND o.k = f.k + 1)) AS s)
SELECT entity, (i - 1)::INTEGER AS episode, es[i].team AS team, es[i].start AS start, es[i].last AS last, es[i].part AS part, es[i].laterality AS laterality, es[i].kind AS kind, es[i].reason AS reason, es[i].status AS status, es[i].available AS available, es[i].n AS n
FROM (SELECT entity, arg_max(es, k) AS es FROM f GROUP BY entity) AS z, unnest(range(1, len(es) + 1)) AS u(i)"""
