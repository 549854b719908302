"""Personal data by bootstrapped contextual extraction, all in DataFrame operations.

Seeds are what plain patterns find. The words around a seed make lexical patterns of four shapes: the two words before
it, the word before it, the word behind it, and the words on both sides. A pattern's confidence is the mean belief of
the distinct identifiers that stand in it, an identifier's belief the noisy-or of its patterns' confidences. Both are
recomputed in turn, and identifiers that only trusted patterns point at are spans as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm import spans as S
from snapfold.llm.common import cut, spread

#: Trust of a pattern: confidence, and distinct seeds that it has seen.
CONFIDENCE, SUPPORT, ROUNDS = 0.8, 5, 3


def _luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c > 4, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(each, doubled), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _has(*any_of: str):
    return lambda t: F.greatest(*(F.instr(t, x) for x in any_of), F.lit(0)) > 0


def _digit(t: Column) -> Column:
    return t.rlike("[0-9]")


# Possessive forms of the plain patterns, with starts that a leftmost match can have: long runs cost no second look.
_MAIL = "A-Za-z0-9._%+-"
KINDS = {
    "email": S.Kind(rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _has("@"), lambda v: F.lit(True)),
    "ip": S.Kind(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _digit, lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}")),
    "card": S.Kind(r"[0-9](?:[\x20-]?[0-9])++", _digit, _luhn),
    "phone": S.Kind(r"\+[0-9][\x20().0-9-]+[0-9]", _has("+"), lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)),
}
NAMES = list(KINDS)
#: What may be an identifier: a token with a digit, an at sign, or one spelled out in brackets.
TOKEN = {"token": S.Kind(r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*?(?:[0-9@]|\[at\]|\(at\)))[^\x20\x09-\x0D]++", lambda t: t.rlike(r"[0-9@]|\[at\]|\(at\)"), lambda v: F.lit(True))}


def _patterns(two: Column, one: Column, after: Column) -> Column:
    """The patterns that a match stands in: words lowered, digits as 0, _ for the match."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")
    shapes = [(two, F.concat(plain(two), F.lit(" _"))), (one, F.concat(plain(one), F.lit(" _"))), (after, F.concat(F.lit("_ "), plain(after)))]
    both = F.when((one != "") & (after != ""), F.concat(plain(one), F.lit(" _ "), plain(after)))
    return F.array_compact(F.array(*(F.when(words != "", shape) for words, shape in shapes), both))


def discover(base: DataFrame, others: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, context) of the identifiers among ``others`` that trusted patterns point at.

    base: (kind, value, context); others: (value, context), a row for each pattern of a match. Counts run over distinct
    identifiers, so copies of a text add no trust. Rows of a frequent pattern are dealt over several parts of a join.
    """
    seeds = base.groupBy("context", "kind", "value").agg(F.count("*").alias("n"))
    loose = others.groupBy("context", "value").agg(F.count("*").alias("n"))
    seen = cut(seeds.groupBy("context", "kind").agg(F.count("*").alias("seeds")))
    # Only patterns with enough seeds can ever be trusted: the rest of the graph goes at once.
    strong = seen.where(F.col("seeds") >= support)
    strong = cut(strong.join(seen.groupBy("context").agg(F.sum("seeds").alias("any")), "context"))
    # (context, value, kind): edges once for each kind of their pattern.
    edges = cut(spread(cut(loose.select("context", "value")), "context")(strong.select("context", "kind")))
    trust = strong.join(edges.groupBy("context", "kind").agg(F.count("*").alias("loose")), ["context", "kind"], "left")
    trust = cut(trust.select("context", "kind", "seeds", (F.col("any") + F.coalesce("loose", F.lit(0))).alias("all")))
    believed = lambda: F.struct("value", "kind")
    by_value = spread(edges.select("context", "kind", believed().alias("believed")), "believed")  # an identifier may stand in many contexts
    by_context, mass = spread(edges, "context"), trust.select("context", "kind", F.lit(0.0).alias("mass"))
    for _ in range(rounds):
        sure = (F.col("seeds") + F.coalesce("mass", F.lit(0.0))) / F.col("all")
        pattern = cut(trust.join(mass, ["context", "kind"], "left").select("context", "kind", sure.alias("confidence")))
        by_kind = pattern.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("kind", "confidence"))).alias("by_kind"))  # a handful of kinds
        known = by_context(by_kind).select("context", "value", "kind", F.col("by_kind")[F.col("kind")].alias("confidence"))
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        belief = cut(known.groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("belief")))
        mass = by_value(belief.select(believed().alias("believed"), "belief")).groupBy("context", "kind").agg(F.sum("belief").alias("mass"))
    found = known.where(F.col("confidence") >= confidence).join(belief.where(F.col("belief") >= confidence), ["value", "kind"])
    return found.select("kind", "value", "context").distinct()


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans (doc_id, text_key, kind, start, end, base) of every whole text, one set per id and text.

    A null text counts as empty, rows that repeat an id and text have one set of spans, a null id is an id like others.
    An empty table gives an empty result; extra columns are ignored.
    """
    keys = ["doc_id", "text_key"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), S.text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    found = S.find(rows.where(F.col("text").rlike(r"[0-9@]|\[at\]|\(at\)")), KINDS | TOKEN, keys, context=True)
    patterns = _patterns(F.col("two"), F.col("one"), F.col("after")).alias("patterns")
    found = cut(found.where((F.col("kind") == "token") | S.valid(KINDS)).select(*keys, "kind", "start", "end", "value", patterns).distinct())
    base = found.where("kind != 'token'")
    # Tokens that touch no base span of their text: compared with the spans before and after them in order.
    in_order = W.partitionBy(*keys).orderBy("start", "end")
    is_base = F.col("kind") != "token"
    over = F.max(F.when(is_base, F.col("end"))).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    next_ = F.first(F.when(is_base, F.col("start")), ignorenulls=True).over(in_order.rowsBetween(W.currentRow, W.unboundedFollowing))
    free = found.withColumns({"over": over, "next": next_}).where((F.col("kind") == "token") & ~(F.coalesce(F.col("over") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))))
    # A token ends before the stops behind it, and stops are no part of what two tokens have in common.
    tail = F.length(F.regexp_extract(F.reverse("value"), r"\A[.,;:!?)]*+", 0))
    free = free.select(*keys, "start", (F.col("end") - tail).alias("end"), F.left("value", F.length("value") - tail).alias("value"), "patterns")
    free = cut(free.where("value != ''"))
    more = discover(base.select("kind", "value", F.explode("patterns").alias("context")), free.select("value", F.explode("patterns").alias("context")))
    pairs = free.select(*keys, "start", "end", "value", F.explode("patterns").alias("context")).select(*keys, "start", "end", F.struct("value", "context").alias("place"))
    added = spread(pairs, "place")(more.select(F.struct("value", "context").alias("place"), "kind")).select(*keys, "kind", "start", "end", F.lit(False).alias("base"))
    return base.select(*keys, "kind", "start", "end", F.lit(True).alias("base")).union(added.distinct())


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans by kind, base_sha256 and all spans."""
    return S.digest(docs, personal_data(docs, doc_id, text), NAMES, doc_id, text)
