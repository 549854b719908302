"""Interval candidates and optimal order-preserving matching of two event streams."""

from __future__ import annotations

import math
from datetime import timedelta
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.operators import latest
from snapfold.tables import cut

# Parts that count as one with a wider one.
FAMILY = {"lower leg": "leg", "shin": "leg", "forearm": "arm"}


def candidates(left: DataFrame, right: DataFrame, key: str, day: str, left_id: str, right_id: str, days: int = 7) -> DataFrame:
    """Pairs of one key at most ``days`` apart. Both sides are binned, so a long history meets its neighbourhood only."""
    width = days + 1
    bin_of = F.floor(F.unix_date(F.col(day).cast("date")) / width)
    a = left.select(key, left_id, F.col(day).cast("date").alias("left_day"), bin_of.alias("bin"))
    b = right.select(key, right_id, F.col(day).cast("date").alias("right_day"), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    return a.join(b, [key, "bin"]).where(F.abs(F.datediff("left_day", "right_day")) <= days).drop("bin")


@lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _cost(a: dict, b: dict) -> tuple:
    """What a pair adds: days apart, conflicts of part, kind and side (null is none), less similarity of reasons."""
    clash = lambda x, y: int(x is not None and y is not None and x != y)
    alike = round(_ratio(a["reason"] or "", b["reason"] or "") * 1_000_000)
    part = clash(FAMILY.get(a["part"], a["part"]), FAMILY.get(b["part"], b["part"]))
    return abs((a["day"] - b["day"]).days), part, clash(a["kind"], b["kind"]), clash(a["laterality"], b["laterality"]), -alike


def assign(left: list[dict], right: list[dict], days: int = 7) -> list[tuple[int, int]]:
    """Pairs (i, j), both rising, that are most in number, then least in summed cost, then of least ids.

    Both sides are in order of day, so each left row meets only the right rows from ``low`` to ``high``. A state is the
    number and summed cost of its pairs as one integer, the ids and places of its first pair, and the state after that
    pair. Equal first pairs have the same state after them, so the first pair alone settles ties.
    """
    base = max(days, 1_000_000) * min(len(left), len(right)) + 1
    best: list[tuple] = [(0, math.inf, math.inf, len(left), len(right), None)] * (len(right) + 1)
    low = high = len(right)
    for i in range(len(left) - 1, -1, -1):
        first, last = left[i]["day"] - timedelta(days), left[i]["day"] + timedelta(days)
        while high > 0 and right[high - 1]["day"] > last:
            high -= 1
        while low > 0 and right[low - 1]["day"] >= first:
            low -= 1
            best[low] = best[low + 1]
        after = best[high]
        for j in range(high - 1, low - 1, -1):
            value = -1
            for part in _cost(left[i], right[j]):
                value = value * base + part
            below = best[j]
            best[j] = min(below, best[j + 1], (after[0] + value, left[i]["id"], right[j]["id"], i, j, after))
            after = below
    pairs, state = [], best[low]
    while state[5] is not None:
        pairs.append(state[3:5])
        state = state[5]
    return pairs


def discrepancies() -> Column:
    """Array of what a matched pair disagrees in, from its columns day_difference, *_agrees, ambiguous and similarity."""
    # The labels.
    labels = {label: F.col(f"{name}_agrees") == F.lit(False) for name, label in (("part", "body_disagreement"), ("kind", "injury_type_disagreement"), ("laterality", "laterality_disagreement"))}
    unknown = F.col("part_agrees").isNull() & F.col("kind_agrees").isNull() & F.col("laterality_agrees").isNull()
    labels = {"date_timing_discrepancy": F.col("day_difference") != 0, **labels, "ambiguous_multiple_candidate_match": F.col("ambiguous"), "unresolved": unknown & (F.col("similarity") < 0.5)}
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in labels.items())))


SCHEMA = "key long, left_id long, right_id long, day_difference int, part_agrees boolean, kind_agrees boolean, laterality_agrees boolean, similarity double"
COLUMNS = ["key", "id", "day", "part", "kind", "laterality", "reason"]
#: Rows of a run that are matched in one task; longer runs are matched in blocks.
MOST = 2000


def optimal_match(left: DataFrame, right: DataFrame, days: int = 7, most: int = MOST) -> DataFrame:
    """Best matching per key of two streams (key, id, day, part, kind, laterality, reason); keys are single entities.

    No pair reaches over more than ``days`` days without a row of either stream, so a key's history is cut there, and
    the best matchings of the runs together are the best one of the key. Rows without a day have no pair. A run of more
    than ``most`` rows is matched in blocks of days (see ``blocked_match``).
    """
    both = left.select(*COLUMNS, F.lit(True).alias("is_left")).union(right.select(*COLUMNS, F.lit(False).alias("is_left")))
    runs = latest.episodes_by_gap(both.where("day is not null"), ["key"], "day", "id", days).withColumn("day", F.col("day").cast("date"))

    def match(group: pd.DataFrame) -> pd.DataFrame:
        x, y = _sides(group)
        return _as_pairs([(x[i], y[j]) for i, j in assign(x, y, days)])

    long_ = runs.groupBy("key", "episode").agg(F.count("*").alias("_n"), F.min("day").alias("first_day")).where(F.col("_n") > most)
    long_ = cut(long_.select("key", "episode", "first_day"))
    if long_.isEmpty():
        return runs.groupBy("key", "episode").applyInPandas(match, SCHEMA)
    short = runs.join(long_.drop("first_day"), ["key", "episode"], "left_anti").groupBy("key", "episode").applyInPandas(match, SCHEMA)
    return short.unionByName(blocked_match(runs.join(long_, ["key", "episode"]), days))


def _sides(group: pd.DataFrame) -> tuple[list[dict], list[dict]]:
    """The left and the right rows in order of day and id, nulls as None."""
    rows = group.sort_values(["day", "id"], kind="stable").astype(object)
    rows = rows.where(rows.notna(), None)
    x, y = (rows[rows.is_left == side].to_dict("records") for side in (True, False))
    return x, y


def _as_pairs(pairs: list[tuple[dict, dict]]) -> pd.DataFrame:
    agree = lambda x, y: None if x is None or y is None else x == y
    out = []
    for p, q in pairs:
        ratio = round(_ratio(p["reason"] or "", q["reason"] or ""), 6)
        part = agree(FAMILY.get(p["part"], p["part"]), FAMILY.get(q["part"], q["part"]))
        out.append((p["key"], p["id"], q["id"], (p["day"] - q["day"]).days, part, agree(p["kind"], q["kind"]), agree(p["laterality"], q["laterality"]), ratio))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


# --- long runs in blocks
#
# A value is eight numbers, the less the better: pairs (negative), the five parts of their cost, and the ids of the
# first pair (NONE without one). What a block can do to a matching depends on its surroundings only by which rows next
# to its ends pairs that reach over them have taken: as pairs keep order, all that reach over an end have their earlier
# row on the same side, so a state of an end is how many rows of one side behind it are taken, within ``days`` days.

NONE = 1 << 62
_FAR = 1 << 59


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two arrays of values, the better one at each place."""
    at = (a != b).argmax(-1)[..., None]
    return np.where(np.take_along_axis(a, at, -1) < np.take_along_axis(b, at, -1), a, b)


def _then(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Values of one stretch followed by another."""
    out = np.empty(np.broadcast_shapes(before.shape, after.shape), dtype=np.int64)
    out[..., :6] = np.minimum(before[..., :6] + after[..., :6], _FAR * 2)
    out[..., 6:] = np.where(before[..., :1] < 0, before[..., 6:], after[..., 6:])
    return out


class Block:
    """Rows of a block of days and the first ``days`` days behind it, both sides in order."""

    def __init__(self, group: pd.DataFrame, days: int):
        self.left, self.right = _sides(group)
        self.days = days
        first, last = group["first_day"].iloc[0], int(group["block"].iloc[0])
        begin = first + timedelta((days + 1) * last)
        self.end = begin + timedelta(days + 1)
        ahead = begin + timedelta(days)
        count = lambda rows, day: sum(r["day"] < day for r in rows)
        self.a, self.c = count(self.left, self.end), count(self.right, self.end)
        self.ins = self._states(0, 0, count(self.left, ahead), count(self.right, ahead))
        self.outs = self._states(self.a, self.c, len(self.left) - self.a, len(self.right) - self.c)

    @staticmethod
    def _states(i: int, j: int, more_left: int, more_right: int) -> list[tuple[int, int]]:
        return [(i, j + k) for k in range(more_right + 1)] + [(i + k, j) for k in range(1, more_left + 1)]

    def pair(self, i: int, j: int) -> np.ndarray | None:
        if i >= len(self.left) or j >= len(self.right):
            return None
        p, q = self.left[i], self.right[j]
        if abs((p["day"] - q["day"]).days) > self.days or min(p["day"], q["day"]) >= self.end:
            return None
        return np.array([-1, *_cost(p, q), p["id"], q["id"]], dtype=np.int64)

    def cells(self, ends: np.ndarray) -> list[dict[int, np.ndarray]]:
        """Best values from each place (i, j) to what ``ends`` (states, columns, 8) has at the end, by i and j."""
        at_end = {s: ends[k] for k, s in enumerate(self.outs)}
        rows: list[dict[int, np.ndarray]] = [{} for _ in range(len(self.left) + 1)]
        for i in range(len(self.left), -1, -1):
            for j in range(self.c if i > self.a else len(self.right), -1, -1):
                best = at_end.get((i, j))
                if best is None or (i < self.a or j < self.c):
                    options = [rows[i + 1][j]] if i < len(self.left) and j in rows[i + 1] else []
                    if j + 1 in rows[i]:
                        options.append(rows[i][j + 1])
                    cost = self.pair(i, j)
                    if cost is not None:
                        options.append(_then(cost[None], rows[i + 1][j + 1]))
                    for o in options:
                        best = o if best is None else _less(best, o)
                rows[i][j] = best
        return rows

    def table(self) -> np.ndarray:
        """(in-states, out-states, 8): the best values between each two."""
        n = len(self.outs)
        ends = np.zeros((n, n, 8), dtype=np.int64)
        ends[..., 0], ends[..., 6:] = _FAR, NONE
        ends[np.arange(n), np.arange(n), 0] = 0
        rows = self.cells(ends)
        return np.stack([rows[i][j] for i, j in self.ins])

    def trace(self, rows: list[dict[int, np.ndarray]], state: int) -> tuple[list[tuple[int, int]], int]:
        """The pairs of the best way from an in-state, and the out-state that it ends in. rows: cells of one column."""
        (i, j), pairs = self.ins[state], []
        place = {s: k for k, s in enumerate(self.outs)}
        while (i, j) not in place:
            here, cost = rows[i][j], self.pair(i, j)
            if cost is not None and (_then(cost[None], rows[i + 1][j + 1]) == here).all():
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif i < len(self.left) and j in rows[i + 1] and (rows[i + 1][j] == here).all():
                i += 1
            else:
                j += 1
        return pairs, place[i, j]


def _packed(values: np.ndarray) -> bytes:
    return np.array(values.shape, dtype=np.int64).tobytes() + values.tobytes()


def _unpacked(data: bytes, dims: int) -> np.ndarray:
    flat = np.frombuffer(data, dtype=np.int64)
    return flat[dims:].reshape(flat[:dims])


def blocked_match(runs: DataFrame, days: int = 7) -> DataFrame:
    """The best matching of runs (key, episode, first_day, rows) of any length, in blocks of ``days`` + 1 days.

    Every block makes the table of its best values between the states of its two ends. Tables of neighbours are
    combined in a tree, the values of what follows are handed down the tree to every block, and each block then knows
    its own best way from each state it may begin in. The states that the ways pass through are followed from block to
    block by their numbers alone. A task holds one block or two tables, never a run: what must fit is the rows of one
    block, and the square of those within ``days`` days.
    """
    node = ["key", "episode", "block"]
    own = F.floor(F.datediff("day", "first_day") / (days + 1)).cast("int")
    early = F.datediff("day", "first_day") - own * (days + 1) < days
    copies = cut(runs.select(*COLUMNS, "is_left", "episode", "first_day", F.explode(F.array_compact(F.array(own, F.when((own > 0) & early, own - 1)))).alias("block")))
    shape = "key long, episode long, block int"

    def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*node, *columns])

    def tables(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return frame([(*key, _packed(Block(group, days).table()))], ["value"])

    def combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(v, 3) for v in group.sort_values("block")["value"]]
        if len(parts) == 1:
            return frame([(*key, group["value"].iloc[0])], ["value"])
        a, b = parts
        best = None
        for k in range(a.shape[1]):  # the state between them
            way = _then(a[:, k, None], b[None, k])
            best = way if best is None else _less(best, way)
        return frame([(*key, _packed(best))], ["value"])

    levels = [cut(copies.groupBy(*node).applyInPandas(tables, f"{shape}, value binary"))]
    while levels[-1].agg(F.max("block")).first()[0]:
        up = levels[-1].groupBy("key", "episode", F.expr("block div 2").cast("int").alias("block"))
        levels.append(cut(up.applyInPandas(combine, f"{shape}, value binary")))

    end = np.zeros((1, 8), dtype=np.int64)
    end[:, 6:] = NONE
    ends = levels[-1].select(*node, F.lit(_packed(end)).alias("end"))
    for level in reversed(levels[:-1]):
        # The right one of two children has its parent's end; before the left one lies what the right one makes of it.
        def down(batches):
            for batch in batches:
                out = []
                for key, episode, block, end, value in zip(batch["key"], batch["episode"], batch["block"], batch["end"], batch["value"], strict=True):
                    before = end
                    if value is not None:
                        out.append((key, episode, 2 * block + 1, end))
                        table, after = _unpacked(value, 3), _unpacked(end, 2)
                        best = None
                        for k in range(table.shape[1]):
                            way = _then(table[:, k], after[None, k])
                            best = way if best is None else _less(best, way)
                        before = _packed(best)
                    out.append((key, episode, 2 * block, before))
                yield frame(out, ["end"])

        right = level.where("block % 2 = 1").select("key", "episode", F.expr("block div 2").cast("int").alias("block"), "value")
        ends = cut(ends.join(right, node, "left").mapInPandas(down, f"{shape}, end binary"))

    def ways(key: tuple, group: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        block = Block(group, days)
        rows = block.cells(_unpacked(after["end"].iloc[0], 2)[:, None])
        return frame([(*key, [block.trace(rows, s)[1] for s in range(len(block.ins))])], ["to"])

    to = copies.groupBy(*node).cogroup(ends.groupBy(*node)).applyInPandas(ways, f"{shape}, to array<int>")
    chain = F.array_sort(F.collect_list(F.struct("block", "to")))  # a few numbers for each block of a run
    step = lambda s, b: F.struct(F.get(b["to"], s["state"]).alias("state"), F.array_append(s["seen"], s["state"]).alias("seen"))
    start = F.struct(F.lit(0).alias("state"), F.expr("cast(array() as array<int>)").alias("seen"))
    states = to.groupBy("key", "episode").agg(chain.alias("chain")).select("key", "episode", F.posexplode(F.aggregate("chain", start, step)["seen"]).alias("block", "state"))
    ends = cut(ends.join(states, node))

    def pairs(key: tuple, group: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        block = Block(group, days)
        rows = block.cells(_unpacked(after["end"].iloc[0], 2)[:, None])
        return _as_pairs([(block.left[i], block.right[j]) for i, j in block.trace(rows, int(after["state"].iloc[0]))[0]])

    return copies.groupBy(*node).cogroup(ends.groupBy(*node)).applyInPandas(pairs, SCHEMA)


def match_summary(pairs: DataFrame, key: str = "key") -> DataFrame:
    """Pairs and summed days apart of each key: what a best matching fixes whatever the ties."""
    return pairs.groupBy(key).agg(F.count("*").alias("pairs"), F.sum(F.abs("day_difference")).alias("days_apart"))
