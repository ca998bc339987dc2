"""What the text operators share: work folders, staged tables and reading of inputs."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: later steps neither recompute it nor depend on executors that may be lost."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run meanwhile pass at most ``rows`` rows at a time to Python: of long texts, Spark's 10,000 are tens of megabytes on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, under fixed names. Null text is empty; a row without an id can't be named in a result and is left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")


def give_back() -> None:
    """Free memory goes back to the system: a worker outlives its task, and the next one may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What workers remember from task to task: (whose it is, how to forget it).
REMEMBERED: list[tuple[str, Callable[[], None]]] = []


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, which gives free memory back when a task's batches are done, and before that what the worker remembers for others than ``owner``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whose, forget in REMEMBERED:
            if whose != owner:
                forget()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], chars: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in runs of about ``chars`` characters, so that memory doesn't follow the size of Arrow's batches."""
    ids: list = []
    out: list[str] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            ids.append(i)
            out.append(t)
            held += len(t) + 64
            if held >= chars:
                yield ids, out
                ids, out, held = [], [], 0
    if ids:
        yield ids, out


def cut_batch(batch: pa.RecordBatch, column: int | str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices with about ``size`` bytes in the string ``column``; a longer text is a slice of its own."""
    ends = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(ends.searchsorted(before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_arrays(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) as :func:`slices` gives them, but as arrays of about ``size`` bytes."""
    ids: list[pa.Array] = []
    held: list[pa.Array] = []
    total = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
        at = 0
        ends = lengths.cumsum()
        while at < len(ends):
            stop = max(at + 1, int(ends.searchsorted(ends[at] - lengths[at] + size - total)))
            ids.append(batch.column(0)[at:stop])
            held.append(batch.column(1)[at:stop].fill_null(""))
            total += int(ends[stop - 1] - ends[at] + lengths[at])
            if total >= size:
                yield pa.concat_arrays(ids), pa.concat_arrays(held)
                ids, held, total = [], [], 0
            at = stop
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(held)


def put(uri: str, raw: bytes) -> None:
    """A file, whole or not at all; a repeated task writes the same bytes under the same name."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(raw)
    fs.move(part, path)


def fetch(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


#: Words of 64 bits in a filter of numbers, from few to very many numbers. A filter may let more through than it was made of, never less.
FILTER_LEAST, FILTER_MOST = 1 << 14, 1 << 24


def number_filter(rows: DataFrame, value: str, uri: str, expected: int | None = None) -> str:
    """Write the filter of the column ``value`` (long) to ``uri``, with 16 bits or more for each row up to 2^26 rows. Rows are counted unless their number is ``expected``, which is
    for rows that cost much to work out twice."""
    size = FILTER_LEAST
    need = (rows.count() if expected is None else expected) // 4
    while size < min(need, FILTER_MOST):
        size *= 2
    word = F.shiftrightunsigned(F.col(value), 6).bitwiseAND(size - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(value).bitwiseAND(63).cast("int"))
    got = rows.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits = np.zeros(size, dtype=np.int64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
    put(uri, bits.astype("<i8").tobytes())
    return uri


@lru_cache(maxsize=2)
def _bits(uri: str) -> np.ndarray:
    return np.frombuffer(fetch(uri), dtype="<u8")


def passing(uri: str, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` (64-bit) may be in the filter."""
    bits, values = _bits(uri), values.view(np.uint64)
    one = np.uint64
    return (bits[((values >> one(6)) & one(len(bits) - 1)).astype(np.int64)] >> (values & one(63)) & one(1)).astype(bool)
