"""Places of pattern matches in texts, as DataFrame operations.

Matches are fenced in by a mark, the text is split at the marks, and a running sum of the pieces' lengths gives each
match its place in code points. Only lengths and matches leave the texts' rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm.common import cut, spread

#: Stands on both sides of a match. Where a text holds it itself, another character no pattern knows takes its place.
MARK, STAND_IN = "\u0001", "�"

class Kind(NamedTuple):
    """A kind of span: a Java pattern, a cheap test that any text with a match passes, and a test of the match itself."""

    pattern: str
    gate: "callable"
    valid: "callable"


def text_key(text: Column) -> Column:
    """Tells apart rows of one id with different texts."""
    return F.xxhash64(F.lit(3), F.coalesce(text, F.lit("")))


def row_key(doc_id: str, key: Column | str) -> Column:
    """An id, null or not, and the key of its text as one value that equals itself."""
    key = F.col(key) if isinstance(key, str) else key
    return F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), key.alias("text"))


def pieces(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _last_words(text: Column, n: int) -> Column:
    """The last n words of a text with what stands between them; '' if there are fewer. Linear: read from the end."""
    word, gap = r"[^\x20\x09-\x0D]++", r"[\x20\x09-\x0D]"
    return F.reverse(F.regexp_extract(F.reverse(text), rf"\A{gap}*+({word}(?:{gap}++{word}){{{n - 1}}})", 1))


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"\A[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1)


def find(rows: DataFrame, kinds: Mapping[str, Kind], keys: list[str], text: str = "text", context: bool = False) -> DataFrame:
    """(keys, kind, start, end, value) of all matches, valid or not: leftmost, non-overlapping per kind.

    Rows may repeat a key: each is searched by itself and gives its own spans. start and end count code points, end
    exclusive. With ``context`` there are also two, one (the last words before the match) and after (the first word
    behind it) as they stand between this and the neighbouring matches of the kind; '' where there are too few.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    per_kind = [F.when(k.gate(t), F.struct(F.lit(name).alias("kind"), pieces(t, k.pattern).alias("pieces"))) for name, k in kinds.items()]
    each = rows.select(*keys, F.monotonically_increasing_id().alias("_row"), F.explode(F.array_compact(F.array(*per_kind))).alias("x")).where(F.size("x.pieces") > 1)
    each = each.select(*keys, "_row", "x.kind", F.posexplode("x.pieces").alias("at", "piece"))
    odd = F.col("at") % 2 == 1
    kept = [F.length("piece").alias("length"), F.when(odd, F.col("piece")).alias("value")]
    if context:
        kept.append(F.when(~odd, F.struct(_last_words(F.col("piece"), 2).alias("two"), _last_words(F.col("piece"), 1).alias("one"), _first_word(F.col("piece")).alias("first"))).alias("edges"))
    each = each.select(*keys, "_row", "kind", "at", *kept)
    in_order = W.partitionBy(*keys, "_row", "kind").orderBy("at")
    each = each.withColumn("end", F.sum("length").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    around = []
    if context:
        each = each.withColumns({"before": F.lag("edges").over(in_order), "behind": F.lead("edges").over(in_order)})
        around = [F.col("before.two").alias("two"), F.col("before.one").alias("one"), F.col("behind.first").alias("after")]
    out = each.where(F.col("value").isNotNull())
    return out.select(*keys, "kind", (F.col("end") - F.col("length")).alias("start"), "end", "value", *around)


def valid(kinds: Mapping[str, Kind]) -> Column:
    """Whether a found match passes its kind's own test."""
    test = F.lit(False)
    for name, k in kinds.items():
        test = F.when(F.col("kind") == name, k.valid(F.col("value"))).otherwise(test)
    return test


def order_of(names: list[str]) -> Column:
    """Place of a kind among the listed ones; others follow by name."""
    out = F.lit(len(names))
    for i, name in enumerate(names):
        out = F.when(F.col("kind") == name, F.lit(i)).otherwise(out)
    return out


def joined(only: Column, names: list[str]) -> Column:
    """Aggregate: kind:start:end of the rows where ``only``, by start and then kind as listed, comma-joined."""
    row = F.struct("start", order_of(names).alias("place"), "kind", "end")
    rows = F.array_sort(F.collect_list(F.when(only, row)))
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def digest(docs: DataFrame, spans: DataFrame, names: list[str], doc_id: str, text: str) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind>, base_sha256, spans. spans: (doc_id, text_key, kind, start, end, base)."""
    counts = [F.count_if((F.col("kind") == n) & F.col("base")).alias(f"n_{n}") for n in names]
    per = spans.groupBy("doc_id", "text_key").agg(*counts, joined(F.col("base"), names).alias("base_"), joined(F.lit(True), names).alias("spans"))
    per = per.select(row_key("doc_id", "text_key").alias("row_key"), *(f"n_{n}" for n in names), "base_", "spans")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text_key(F.col(text))).alias("row_key")))
    out = spread(rows, "row_key")(per, "left")  # rows equal in id and text may be a great part of all
    none = F.lit("")
    return out.select("doc_id", *(F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in names), F.sha2(F.coalesce("base_", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))
