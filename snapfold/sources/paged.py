"""Paged sources: each partition is a chain of pages, each of which names the next.

Pages are files of a folder, {"rows": [...], "next": name or null}, one folder a partition; the first page of each is
FIRST. As a batch a partition is followed from its first page to its end; as a stream the pages that were read are
remembered by their number, so a query that is started again goes on behind them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from snapfold.tables import cut

FIRST = "0.json"
#: Pages of a partition after which a chain is taken to be endless.
MOST = 100_000


class PageError(RuntimeError):
    """A chain of pages that comes back to a page, or does not end."""


def _files(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _parts(folder: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    fs, inner = _files(folder)
    return sorted(i.base_name for i in fs.get_file_info(FileSelector(inner, allow_not_found=True)) if i.type == FileType.Directory)


def _page(folder: str, part: str, name: str) -> dict | None:
    from pyarrow.fs import FileType

    fs, inner = _files(folder)
    path = f"{inner}/{part}/{name}"
    if fs.get_file_info(path).type == FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return json.loads(f.read())


def chain(folder: str, part: str, most: int) -> Iterator[dict]:
    """The pages of a partition from its first to its end, or to one that is not there yet."""
    name, seen = FIRST, set()
    while name is not None:
        if name in seen:
            raise PageError(f"{part}: page {name} comes after itself")
        if len(seen) >= most:
            raise PageError(f"{part}: more than {most} pages")
        seen.add(name)
        page = _page(folder, part, name)
        if page is None:
            return
        yield page
        name = page["next"]


class _Chain(InputPartition):
    def __init__(self, part: str, start: int = 0, end: int | None = None):
        self.part, self.start, self.end = part, start, end


class _Base:
    def __init__(self, schema, options):
        self.folder, self.most, self.names = options["path"], int(options.get("most", MOST)), [f.name for f in schema]

    def rows(self, at: _Chain | None) -> Iterator[tuple]:
        if at is None:  # a folder without partitions
            return
        for k, page in enumerate(chain(self.folder, at.part, self.most)):
            if at.end is not None and k >= at.end:
                return
            if k >= at.start:
                for row in page["rows"]:
                    yield tuple(row.get(n) for n in self.names)


class PagedReader(_Base, DataSourceReader):
    def partitions(self):
        return [_Chain(p) for p in _parts(self.folder)]

    def read(self, partition):
        return self.rows(partition)


class PagedStreamReader(_Base, DataSourceStreamReader):
    """Offsets are the numbers of pages read of each partition."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: sum(1 for _ in chain(self.folder, p, self.most)) for p in _parts(self.folder)}

    def partitions(self, start: dict, end: dict):
        return [_Chain(p, start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, partition):
        return self.rows(partition)


class Paged(DataSource):
    """Format ``paged``: options path and most; the schema names what is taken of each row (strings, numbers, booleans)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        raise ValueError("name the columns: .schema(...)")

    def reader(self, schema):
        return PagedReader(schema, self.options)

    def streamReader(self, schema):
        return PagedStreamReader(schema, self.options)


def save(df: DataFrame, folder: str, parts: int, size: int, order: str, name: str = "") -> None:
    """Write df as chains of pages of ``size`` rows, dealt into ``parts`` partitions whose names begin with ``name``."""
    part = F.concat(F.lit(name), F.pmod(F.xxhash64(order), F.lit(parts)).cast("string"))
    placed = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"), part.alias("part"), F.col(order).alias("order"))
    placed = placed.withColumn("page", F.expr(f"(row_number() OVER (PARTITION BY part ORDER BY order) - 1) div {size}"))
    pages = placed.groupBy("part", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "row"))), lambda r: r["row"]), ",").alias("rows"))
    last = F.max("page").over(W.partitionBy("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = _files(folder)
        for batch in batches:
            for part, page, rows, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                fs.create_dir(f"{inner}/{part}", recursive=True)
                follows = "null" if page == end else f'"{page + 1}.json"'
                with fs.open_output_stream(f"{inner}/{part}/{page}.json") as f:  # the same page again if a task runs twice
                    f.write(f'{{"rows": [{rows}], "next": {follows}}}'.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    cut(pages.select("part", "page", "rows", last.alias("last")).mapInArrow(run, "n long"))
