"""Text normalisation and rule ladders as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.functions import rules


def collapse(c: Column) -> Column:
    """Runs of white space (no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def alnum(c: Column) -> Column:
    """Lower-case letters and digits of ASCII, all else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def given_first(c: Column) -> Column:
    """'Surname, Given' as 'Given Surname': what follows the first comma goes first."""
    halves = F.split(c, ",", 2)
    return collapse(F.when(F.size(halves) > 1, F.concat_ws(" ", halves[1], halves[0])).otherwise(c))


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Letters and digits of a name without accents: there is no built-in decomposition."""
    plain = names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())
    return plain.map(lambda s: None if s is None else re.sub("[^a-z0-9]+", "", s))


def token(c: Column, *terms: str) -> Column:
    """Whether one of the terms stands in c with no letter or digit at its sides."""
    return c.rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, terms)) + ")(?![a-z0-9])")


def holds(c: Column, term: str, part: Column | None = None) -> Column:
    """A substring; 'a&b': both; 'a+p': a, and the part of the body is p."""
    if "&" in term:
        a, b = term.split("&")
        return F.contains(c, F.lit(a)) & F.contains(c, F.lit(b))
    if "+" in term:
        a, p = term.split("+")
        return F.contains(c, F.lit(a)) & part.eqNullSafe(F.lit(p))
    return F.contains(c, F.lit(term))


def any_of(c: Column, terms, part: Column | None = None) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | holds(c, t, part)
    return out


def ladder(table: str, test, otherwise: Column | None = None) -> Column:
    """First line of a table whose terms pass the test, as its label."""
    return F.coalesce(*(F.when(test(terms), F.lit(label)) for label, terms in rules.lines(table)), F.lit(None).cast("string") if otherwise is None else otherwise)


def laterality(c: Column) -> Column:
    """bilateral, left or right; left where both stand apart."""
    both = c.rlike(r"\bbilateral\b|\bleft and right\b|\bright and left\b|\bboth\b")
    return F.when(both, "bilateral").when(c.rlike(r"\bleft\b"), "left").when(c.rlike(r"\bright\b"), "right")


def laterality_for_matching(c: Column) -> Column:
    """The same over normalised text, but left and right together are bilateral."""
    n = alnum(F.coalesce(c, F.lit("")))
    left, right = n.rlike(r"\bleft\b"), n.rlike(r"\bright\b")
    both = n.rlike(r"\bbilateral\b|\bboth\b") | (left & right)
    return F.when(both, "bilateral").when(left, "left").when(right, "right")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def some(c: Column, terms) -> Column:
    """Whether one of the terms stands in c, as one test."""
    return c.rlike("|".join(map(re.escape, terms)))


def non_injury(c: Column) -> Column:
    """Whether a lowered text names what is no injury."""
    return token(c, *rules.NON_INJURY)


def _kind(detail: Column, part: Column) -> Column:
    """Type of the condition that a lowered reason states."""
    recovery, procedure = some(detail, rules.RECOVERY), some(detail, rules.PROCEDURE)
    ligament = [
        F.when(some(detail, terms), F.when(recovery, "recovery").when(procedure, "surgery").when(some(detail, ("tear", "rupture")), f"{name} tear").otherwise(f"{name} injury"))
        for name, terms in rules.LIGAMENTS.items()
    ]

    def test(terms):
        plain = [t for t in terms if "&" not in t and "+" not in t]
        return reduce(lambda x, y: x | y, [*([some(detail, plain)] if plain else []), *(holds(detail, t, part) for t in terms if t not in plain)])

    whole = lambda label: F.when(F.trim(detail).isin(*(term for term, name in rules.WHOLE_REASONS.items() if name == label)), label)
    mask = F.when(part.eqNullSafe(F.lit("face")) & token(detail, "mask"), "protective equipment")
    rungs = []
    for label, terms in rules.lines(rules.CONDITION_THEN):
        rungs += [F.when(test(terms), label), *([whole(label)] if label in rules.WHOLE_REASONS.values() else []), *([mask] if label == "protective equipment" else [])]
    return F.coalesce(*ligament, ladder(rules.CONDITION_FIRST, test), F.when(recovery, "recovery").when(procedure, "surgery"), *rungs, F.lit(None).cast("string"))


def classify(reason: Column, category: Column | None = None) -> Column:
    """struct(body_part, laterality, injury_type, normalized_reason, is_injury) of one reason."""
    lowered = F.replace(F.lower(collapse(F.coalesce(reason, F.lit("")))), F.lit("n/a"), F.lit("unspecified"))
    named = F.lower(collapse(F.coalesce(category, F.lit("")))) if category is not None else F.lit("")
    stated = F.contains(named, F.lit("injury/illness")) | F.contains(lowered, F.lit("injury/illness"))
    none_named = named.isin(*rules.NON_INJURY_CATEGORIES)

    def of(detail: Column, part: Column, kind: Column) -> Column:
        part = F.coalesce(part, F.when(kind == "illness", "illness"))
        injury = ~(none_named | non_injury(detail)) & (stated | part.isNotNull() | kind.isNotNull())
        return F.struct(part.alias("body_part"), laterality(detail).alias("laterality"), kind.alias("injury_type"), alnum(detail).alias("normalized_reason"), injury.alias("is_injury"))

    detail = F.regexp_replace(lowered, r"^injury/illness\s*-\s*", "")
    return let(detail, lambda t: let(ladder(rules.ANATOMY, lambda terms: token(t, *terms)), lambda part: let(_kind(t, part), lambda kind: of(t, part, kind))))


_SLASH = "\ue000"  # stands for a slash that separates nothing


def clauses(detail: Column) -> Column:
    """Parts of a compound reason: at commas, slashes (but for n/a, injury/illness, tib/fib), and 'and' before a side.

    A clause that opens with what is no injury ends the medical text: it and all behind it are one last part.
    """
    safe = F.regexp_replace(detail, r"(?i)\b(n|injury|tib)(\s*)/(\s*)(a|illness|fib)\b", f"$1$2{_SLASH}$3$4")
    boundary = r"(?i)\s*[,/;&(]\s*(?=(?:on\s+)?(?:" + "|".join(rules.NON_INJURY_OPENINGS) + r")\b)"

    def split(halves: Column) -> Column:
        medical = F.split(halves[0], r"(?i)\s*[,/]\s*|\s+and\s+(?=(?:left|right|bilateral)\b)")
        parts = F.when(F.size(halves) > 1, F.concat(medical, F.slice(halves, 2, 1))).otherwise(medical)
        cleaned = F.transform(parts, lambda p: F.btrim(F.replace(p, F.lit(_SLASH), F.lit("/")), F.lit(" -;()")))
        return F.filter(cleaned, lambda p: p != "")

    return let(F.split(safe, boundary, 2), split)


def _decide(whole: Column, parts: Column, found: Column) -> Column:
    """Which conditions a reason states: those of its parts (texts, and what each was found to be) or the one of the whole."""
    both = lambda c: c["body_part"].isNotNull() & c["injury_type"].isNotNull()
    distinct = lambda cs, *names: F.array_distinct(F.transform(cs, lambda c: F.struct(*(c[n].alias(n) for n in names))))
    mixed = F.exists(found, lambda c: c["is_injury"]) & F.exists(found, lambda c: ~c["is_injury"])
    outright = F.forall(F.zip_with(found, parts, lambda c, p: F.when(c["is_injury"], both(c)).otherwise(non_injury(F.lower(p)))), lambda ok: ok)
    sides = F.array_compact(F.array_distinct(F.transform(found, lambda c: c["laterality"])))
    only = lambda kinds: F.forall(found, lambda c: F.coalesce(c["injury_type"].isin(*kinds), F.lit(False)))
    apart = (F.size(distinct(found, "body_part")) > 1) | (F.size(sides) > 1) | only(rules.LIGAMENT_TYPES)
    differ = (F.size(distinct(found, "body_part", "laterality")) > 1) | (F.size(distinct(found, "body_part", "injury_type")) > 1)
    alone = (
        F.forall(found, lambda c: c["is_injury"] & both(c))
        & ~F.exists(found, lambda c: F.coalesce(c["injury_type"].isin("protective equipment", "immobilization"), F.lit(False)))
        & ~((F.size(sides) == 0) & only(("illness", "infection")))
        & apart
        & differ
    )
    side = F.when(F.size(sides) == 1, F.element_at(sides, 1))
    shared = F.transform(found, lambda c: c.withField("laterality", F.coalesce(c["laterality"], side)))
    return F.when(F.size(parts) < 2, whole).when(mixed, F.when(outright, found).otherwise(whole)).when(alone, shared).otherwise(whole)


def _detail(reason: Column) -> Column:
    return F.regexp_replace(collapse(F.coalesce(reason, F.lit(""))), r"(?i)^injury/illness\s*-\s*", "")


def conditions(reason: Column, category: Column | None = None) -> Column:
    """Array of ``classify``'s structs: one for each condition that a reason states by itself, else the one of the whole.

    Parts stand alone if all are injuries with a place and a type, more than synonyms of one illness or pieces of
    equipment, and different in place and side or in place and type; or if all injuries among them have both and the
    others say outright that they are none. One side that is named holds for the parts that name none.
    """
    whole = F.array(classify(reason, category))
    return let(clauses(_detail(reason)), lambda parts: let(F.transform(parts, lambda p: classify(p, category)), lambda found: _decide(whole, parts, found)))


def conditions_of(df: DataFrame, reason: str, category: str | None = None, out: str = "conditions") -> DataFrame:
    """(reason, category, out) of the distinct reasons of df, where out is what ``conditions`` gives.

    For tables: the rules are applied once, to the distinct texts of all reasons and their parts, and the parts that
    the results are put together from are few for each reason. Null reasons and categories are rows of their own.
    """
    named = [category] if category else []
    known = df.select(reason, *named).distinct()
    texts = F.concat(F.array(F.coalesce(F.col(reason), F.lit(""))), clauses(_detail(F.col(reason))))
    label = F.coalesce(F.col(category), F.lit("")) if category else F.lit("")
    pieces = known.select(reason, *named, label.alias("_label"), F.posexplode(texts).alias("_at", "_text"))
    found = pieces.select("_label", "_text").distinct().withColumn("_c", classify(F.col("_text"), F.col("_label")))
    rows = F.array_sort(F.collect_list(F.struct("_at", "_text", "_c")))  # of one reason
    per = pieces.join(found, ["_label", "_text"]).groupBy(reason, *named).agg(rows.alias("_rows"))
    whole, rest = F.array(F.col("_rows")[0]["_c"]), F.slice("_rows", 2, F.size("_rows"))
    return per.select(reason, *named, _decide(whole, F.transform(rest, lambda r: r["_text"]), F.transform(rest, lambda r: r["_c"])).alias(out))


def ambiguous(reason: Column, category: Column | None = None) -> Column:
    """Whether a reason of several parts names two places and still counts as one condition."""
    placed = F.filter(F.transform(clauses(_detail(reason)), lambda p: classify(p, category)["body_part"]), lambda x: x.isNotNull())
    return (F.size(placed) > 1) & (F.size(conditions(reason, category)) == 1)


def reason_parts(reason: Column, category: Column) -> Column:
    """struct(category, reason): a named category goes before the reason; without one, a known prefix is the category."""
    why, named = collapse(F.coalesce(reason, F.lit(""))), collapse(F.coalesce(category, F.lit("")))
    prefix = F.when(F.contains(why, F.lit(" - ")), F.split_part(why, F.lit(" - "), F.lit(1)))
    known = F.when(prefix.isin(*rules.REASON_PREFIXES), prefix)
    joined = F.when(why != "", F.concat_ws(" - ", named, why)).otherwise(named)
    return F.when(named != "", F.struct(named.alias("category"), joined.alias("reason"))).otherwise(F.struct(known.alias("category"), F.nullif(why, F.lit("")).alias("reason")))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_bullet(c: Column) -> Column:
    """A name without the bullet before it."""
    return strip(F.ltrim(strip(c), F.lit("•")))


def mask_password(url: Column) -> Column:
    return F.regexp_replace(url, r"(?<=://)([^:/?#@]*):[^/?#@]*@", "$1:***@")


def is_season(c: Column) -> Column:
    """'2023-24': two years that follow each other."""
    return c.rlike(r"^[0-9]{4}-[0-9]{2}$") & (F.pmod(F.substring(c, 1, 4).try_cast("int") + 1, F.lit(100)) == F.substring(c, 6, 2).try_cast("int"))


def classify_note(note: Column) -> Column:
    """struct(body_part, injury_type) of a transaction's note; nulls for a null note."""
    n = F.lower(note)
    has = lambda *terms: any_of(n, terms)
    recovery = has("recovering from surgery", "placed on il recovering from")
    torn = has("torn", "tear", "ruptured")
    special = [("knee", rules.LIGAMENTS["ACL"], F.when(torn | has("reconstruct"), "ACL tear").otherwise("ACL injury"))]
    special += [("knee", rules.LIGAMENTS[x], F.when(torn, f"{x} tear").otherwise(f"{x} injury")) for x in ("MCL", "PCL")]
    special += [("achilles", ("achilles",), F.when(torn, "tear").otherwise("achilles injury"))]
    calf = F.when(has("strain"), "strain").when(has("tear", "torn"), "tear").when(has("sore"), "soreness").when(has("sprain"), "sprain").otherwise("injury")
    special += [("calf", ("calf",), calf)]
    plain = ladder(rules.NOTE_PARTS, lambda terms: has(*terms))
    kind = ladder(rules.NOTE_CONDITIONS, lambda terms: any_of(n, terms, plain), F.lit("injury"))
    part = F.when(recovery, F.when(has("achilles"), "achilles").when(has("acl", "knee"), "knee").when(has("calf"), "calf"))
    type_ = F.when(recovery, F.lit("recovery"))
    for name, terms, label in special:
        part, type_ = part.when(has(*terms), F.lit(name)), type_.when(has(*terms), label)
    part = part.when(kind == "illness", "illness").otherwise(plain)
    type_ = type_.otherwise(kind)
    return F.struct(F.when(note.isNotNull(), part).alias("body_part"), F.when(note.isNotNull(), type_).alias("injury_type"))


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*rules.MISSING), c)


def row_identity(*columns: Column) -> Column:
    """SHA-256 over the compact JSON array of the columns' texts."""
    return F.sha2(F.to_json(F.array(*columns)), 256)
