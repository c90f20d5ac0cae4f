"""Shared helpers: table access and bounded pieces of Arrow batches."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.session import delete_folders, work_folder

# the bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return;
# exactly what bytes.split() splits on
SPACE = b" \t\n\x0b\x0c\r"

# ids sent to every task at most (32 MB); more are joined by a shuffle
BROADCAST_IDS = 1 << 22

# text handled at once in a Python worker; only a single longer text exceeds it
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_sizes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets) if len(column) else np.zeros(0, np.int32)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on and serves other stages and queries."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = SLICE_BYTES, max_rows: int = 20_000
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``max_bytes`` of text."""
    for batch in batches:
        ends = np.cumsum(text_sizes(batch.column(text_col)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_rows)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null text is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def int_lists(lists: pa.ListArray) -> list[list[int]]:
    """Lists of integers as Python lists; a null list is empty."""
    bounds, values = np.asarray(lists.offsets, np.int64), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def expand(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places ``begin[i]`` to ``begin[i] + counts[i]`` of all ``i``, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(begin - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Scratch:
    """Tables an operator writes to the shared folder on its way; ``clear`` deletes those its result does not read."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.base = spark, work_folder(spark, label)
        self.paths: list[str] = []

    def __call__(self, df: DataFrame, name: str, parts: float | None = None) -> DataFrame:
        """Write ``df``, cut its lineage there, and go on from the files.

        ``parts`` is how many files its rows can fill at most; it must follow
        the data (a count over rows a file), or large tables would be written by few.
        """
        path = f"{self.base}/{len(self.paths)}-{name}"
        self.paths.append(path)
        (df if parts is None else df.coalesce(max(1, math.ceil(parts)))).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *kept: str) -> None:
        """Delete all tables but those named."""
        delete_folders(self.spark, [p for p in self.paths if p.rsplit("-", 1)[-1] not in kept])
        self.paths = [p for p in self.paths if p.rsplit("-", 1)[-1] in kept]


def among(df: DataFrame, ids: DataFrame, key: str, keep: bool = True, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids`` (``keep``) or is not. ``ids`` is a written table.

    The ids are counted: up to ``most`` are sent to every task and the rows
    stay where they are, beyond that both sides are shuffled.
    """
    how = "left_semi" if keep else "left_anti"
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` with the columns that are called like one of ``names``, in any case, called otherwise."""
    names = {n.lower() for n in names}
    taken = {c.lower() for c in df.columns} | names
    out = []
    for c in df.columns:
        new = c
        while new.lower() in names or (new != c and new.lower() in taken):
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return df.toDF(*out)
