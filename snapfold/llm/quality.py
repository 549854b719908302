"""Document quality by a sparse rule ensemble.

Boosted trees over text statistics give candidate rules (their paths, conjunctions of comparisons); a logistic
regression with an L1 penalty keeps and weighs a few of them, and the kept rules become one Spark column expression.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm import trees
from snapfold.llm.common import words_of

#: Bound of the labelled sample that the rules are fitted on.
SAMPLE = 20_000
SYMBOLS = "#$%&*+<=>@[\\]^_`{|}~"


class Rule(NamedTuple):
    weight: float
    terms: tuple[tuple[str, bool, float], ...]  # (statistic, is greater, threshold)


class Model(NamedTuple):
    bias: float
    rules: tuple[Rule, ...]


def statistics(docs: DataFrame, text: str = "text", prefix: str = "st_") -> tuple[DataFrame, list[str]]:
    """docs with statistics of each whole text added (null counts as empty), and their names."""
    t, size = F.coalesce(F.col(text), F.lit("")), F.col(f"{prefix}chars")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    lines = F.split(t, "\n")
    words = F.col(f"{prefix}words_")
    per = lambda x, n: x / F.greatest(n, F.lit(1))
    n_words = F.col(f"{prefix}words")
    first = docs.withColumn(f"{prefix}words_", words_of(F.col(text))).withColumns({f"{prefix}chars": F.length(t).cast("double"), f"{prefix}words": F.size(f"{prefix}words_").cast("double")})
    found = {
        "symbol_share": per(size - without(SYMBOLS), size),
        "bang_share": per(size - without("!?"), size),
        "stop_share": per(size - without(".,;:"), size),
        "digit_share": per(size - without("0123456789"), size),
        "bar_share": per(size - without("|"), size),
        "quote_share": per(size - without("\"'()"), size),
        "upper_share": per(F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double"), size),
        "word_length": per(size, n_words),
        "distinct_words": per(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_by_root": per(F.size(F.array_distinct(words)).cast("double"), F.sqrt(n_words)),
        "repeats": per(F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++(?=\1(?![^\x20\x09-\x0D]))")).cast("double"), n_words),
        "line_words": per(n_words, F.size(lines)),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)),
        "sentence_words": per(n_words, F.regexp_count(t, F.lit(r"[.!?](?![^\x20\x09-\x0D])")).cast("double")),
    }
    out = first.withColumns({f"{prefix}{k}": v for k, v in found.items()}).drop(f"{prefix}words_")
    return out, [f"{prefix}chars", f"{prefix}words", *(f"{prefix}{k}" for k in found)]


def lasso(Z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the bias, by accelerated proximal gradient steps."""
    n, k = Z.shape
    A = np.column_stack([np.ones(n), Z])
    rate = 4 * n / max(1e-9, np.linalg.norm(A, 2) ** 2)
    w = v = np.zeros(k + 1)
    w[0] = math.log(max(1e-6, y.mean()) / max(1e-6, 1 - y.mean()))
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(A @ v, -40, 40)))
        new = v - rate * (A.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        v = new + i / (i + 3) * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(X: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 4e-4, n_trees: int = 40, depth: int = 3) -> Model:
    """Rules from the trees' paths, then sparse weights. Without both labels the model is a constant."""
    y = np.asarray(y, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0 if len(y) == 0 else math.copysign(3.0, y[0] - 0.5), ())
    _, grown = trees.boost(X, y, trees=n_trees, depth=depth, rate=0.3, least=max(0.5, min(5.0, len(y) / 200)))
    rules = list(dict.fromkeys(p for t in grown for p in trees.paths(t)))
    Z = np.empty((len(y), len(rules)))
    for i, terms in enumerate(rules):
        Z[:, i] = reduce(np.logical_and, [(X[:, f] > c) == greater for f, greater, c in terms])
    _, unique = np.unique(Z, axis=1, return_index=True)
    keep = np.sort(unique)
    Z, rules = Z[:, keep], [rules[i] for i in keep]
    bias, weights = lasso(Z, y, penalty)
    chosen = np.flatnonzero(np.abs(weights) > 1e-3)
    chosen = chosen[np.argsort(-np.abs(weights[chosen]), kind="stable")]
    return Model(bias, tuple(Rule(float(weights[i]), tuple((names[f], g, c) for f, g, c in rules[i])) for i in chosen))


def score_column(model: Model, prefix: str = "st_") -> Column:
    """The model as one column expression over the statistics, whose names start with ``prefix``: 0 to 1."""
    total = F.lit(model.bias)
    for rule in model.rules:
        holds = reduce(lambda a, b: a & b, [(F.col(prefix + n) > c) if greater else (F.col(prefix + n) <= c) for n, greater, c in rule.terms])
        total = total + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = SAMPLE) -> Model:
    """Fit on at most ``bound`` labelled documents, those of least hash; only their statistics reach the driver.

    labels has (doc_id, label); null labels and ids take no part. A document counts once: of several labels the largest
    holds, of several texts under one id the one least in its statistics.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64(doc_id), doc_id).limit(bound)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen.select(F.col(doc_id).alias("doc_id"), "y")), "doc_id")
    wide, names = statistics(named)
    one = wide.groupBy("doc_id").agg(F.min(F.struct("y", *names)).alias("x"))
    rows = one.select(F.xxhash64("doc_id").alias("h"), "doc_id", "x.*").toPandas().sort_values(["h", "doc_id"], kind="stable")
    return fit(rows[names].to_numpy(dtype=float), (rows["y"] > 0).to_numpy(), [n.removeprefix("st_") for n in names])


def score_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with column ``score``, which replaces one of that name; any other column stays.

    Null and empty texts get the score of their zero statistics. Rows are independent: repeated rows and ids get the
    score of their own text, an empty table stays empty.
    """
    prefix = "st_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"x{prefix}"
    wide, names = statistics(docs, text, prefix)
    return wide.withColumn(score, score_column(model, prefix)).drop(*names)
