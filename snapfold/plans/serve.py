"""Filtered, ordered and paged queries, and their exports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PER_PAGE = 500


def choices(values: Iterable[str] | None, allowed: Sequence[str], labels: dict[str, str] | None = None) -> list[str] | None:
    """Trimmed values, labels decoded; ValueError for one that is not allowed."""
    if values is None:
        return None
    out = [(labels or {}).get(v.strip(), v.strip()) for v in values]
    wrong = [v for v in out if v not in allowed]
    if wrong:
        raise ValueError(f"unknown: {', '.join(wrong)}; known: {', '.join(allowed)}")
    return out


def where(df: DataFrame, equal: dict | None = None, among: dict | None = None, between: dict | None = None, search: dict | None = None) -> DataFrame:
    """Conjunction of optional filters; a None value adds none.

    equal: column = value; among: column in a list (empty: no row); between: (first, last), both inclusive, either may
    be None; search: case-insensitive containment, in which % and _ keep their meaning.
    """
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c).isin(list(v)) if v else F.lit(False) for c, v in (among or {}).items() if v is not None]
    for c, (low, high) in (between or {}).items():
        tests += [F.col(c) >= F.lit(low)] if low is not None else []
        tests += [F.col(c) <= F.lit(high)] if high is not None else []
    tests += [F.col(c).ilike(f"%{v}%") for c, v in (search or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 100) -> DataFrame:
    """One page of a total order."""
    if number < 1 or not 1 <= size <= MOST_PER_PAGE:
        raise ValueError(f"pages start at 1 and hold 1 to {MOST_PER_PAGE} rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def export_csv(df: DataFrame, path: str, columns: Sequence[str], labels: dict[str, dict[str, str]] | None = None) -> None:
    """Write columns as CSV with a header; cells keep their blanks, null is empty, coded values get their labels."""
    shown = []
    for c in columns:
        codes = (labels or {}).get(c)
        out = F.col(c)
        if codes:
            out = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.col(c)), F.col(c))
        shown.append(out.alias(c))
    df.select(*shown).write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def export_json(df: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def dimension(df: DataFrame, key: str, name: str) -> DataFrame:
    """A dimension's members (id, name) by name."""
    return df.select(F.col(key).alias("id"), F.col(name).alias("name")).distinct().orderBy("name", "id")


def one(df: DataFrame, key: str, value) -> dict:
    """The row of a key as a dictionary; LookupError if there is none."""
    found = df.where(F.col(key) == F.lit(value)).limit(1).collect()
    if not found:
        raise LookupError(f"no {key} {value!r}")
    return found[0].asDict()
