"""Vector best-fit packing of documents into training sequences.

Documents become token ids; those longer than a sequence are cut into whole sequences and one shorter first piece.
Pieces are dealt into groups of bounded size, and each group is packed by itself, largest pieces first: every open bin
has residual capacities of tokens, documents and attention cost (the sum of squared lengths), and a piece goes where
it fits under every one of them and a weighted norm of what would be left is least (or a weighted dot product of its
demand with the residual is largest). A group leaves at most its last few bins partly filled.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.llm.common import cut, heavy_groups

LENGTH, END, GROUP = 2048, 0, 4096
#: Runs of white space over this length are beyond tiktoken (its pattern search runs out of stack at a million): such texts go to tokenizers.
#: Both read the same vocabulary, merges and pattern, so the ids are the same; only the time differs. Texts that hold the
#: string of a special token go to tokenizers as well, which reads it as that token.
SPACES = 50_000


class Capacity(NamedTuple):
    """What a sequence may hold; None: as much as its tokens allow at most."""

    tokens: int = LENGTH
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str, whole: str | None = None):
    """ids of one text, from a file of byte-pair ranks.

    whole: the same vocabulary as a file for tokenizers, slower, for texts with runs of white space over SPACES or with
    the string of a special token in them. Without it such strings are ordinary text.
    """
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    if whole is None:
        return fast
    slow, special = whole_encoder(whole)
    odd = lambda t: any(s in t for s in special) or len(t) > SPACES and max((m.end() - m.start() for m in re.finditer(r"\s{2,}", t)), default=0) > SPACES
    return lambda t: slow(t) if odd(t) else fast(t)


def whole_encoder(whole: str):
    """ids of one text by tokenizers, and the strings that it reads as one token wherever they stand."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(whole)
    added = [str(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids, added


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than a sequence."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pack(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece by vector best fit, in descending order of length; ties keep their order."""
    most = np.array([capacity.tokens, capacity.documents or capacity.tokens, capacity.attention or capacity.tokens**2], dtype=float)
    scale = np.sqrt(np.array(capacity.weights)) / most
    free = np.empty((len(lengths), 3))
    used, bins, offsets = 0, np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_ = np.empty(0, dtype=np.int64)  # bins that can still take the shortest piece
    least = lengths.min() if len(lengths) else 0
    stale = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        rest = free[open_] - need
        fits = np.flatnonzero((rest >= 0).all(1)) if len(open_) else open_
        if len(fits):
            left = rest[fits] * scale
            if capacity.rule == "dot":
                at = (free[open_[fits]] * scale * (need * scale)).sum(1).argmax()
            else:
                at = (left * left).sum(1).argmin()
            b = open_[fits[at]]
        else:
            b = used
            used += 1
            free[b] = most
            open_ = np.append(open_, b)
        bins[i], offsets[i] = b, int(most[0] - free[b, 0])
        free[b] -= need
        stale += free[b, 0] < least or free[b, 1] < 1
        if stale > 64:
            open_ = open_[(free[open_, 0] >= least) & (free[open_, 1] >= 1)]
            stale = 0
    return bins, offsets


def token_pieces(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's whole text: its ids, then the end id. Ids pass through untouched."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, None if ranks else public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(t), END] if t is not None else [END], dtype="<u4")
                rows += [(i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cuts(len(ids), length))]
            at, piece, *rest = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else [np.empty(0, dtype=np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), *map(pa.array, rest)], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), group: int = GROUP, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: its end id alone. Repeated rows and ids are documents of their own, null ids stay
    null. Every piece lies whole in one sequence; one that alone exceeds a capacity has a sequence to itself. Extra
    columns are ignored; an empty table gives an empty result. ids are those of the vocabulary's byte-level byte-pair
    encoding; ranks and pattern name another one.
    """
    pieces = cut(token_pieces(docs, ranks, pattern, capacity.tokens, doc_id, text))
    # Pieces that fill a sequence need no search; the others are dealt evenly by their place in the written table, so
    # equal rows spread as well. The deal is written before it is used: a task that is run again changes nothing.
    full = F.col("length") == capacity.tokens
    count = pieces.where(~full).count()
    groups = max(1, math.ceil(count / group))
    at = F.pmod(F.xxhash64(F.lit(17), F.monotonically_increasing_id()), F.lit(groups))
    dealt = cut(pieces.where(~full).withColumn("group", at))
    schema = dealt.drop("group").schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        bins, offsets = pack(rows.column("length").to_numpy(), capacity)
        out = rows.select(schema.names[:-2])
        return out.append_column("sequence_id", pa.array(2 * (bins * groups + key[0].as_py()))).append_column("offset", pa.array(offsets))

    packed = heavy_groups(dealt, groups, "group").applyInArrow(run, schema)
    # Odd numbers are sequences that one piece fills.
    whole = pieces.where(full).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)
