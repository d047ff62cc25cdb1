"""Whole texts in Arrow batches: small slices of rows, words as bytes, hashed word windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4_000_000  # of text handled at once in a Python worker; one longer text counts alone
BATCH_ROWS = 1_000


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_BYTES of text; every row is in exactly one."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(run)], strict=True):
        yield batch.slice(int(a), int(b - a))


def with_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields`` appended, computed over slices of rows.

    ``make`` runs once in a task and gives the function from a slice to the new columns' values.
    New fields replace columns of the same names.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    own = {f.name for f in fields}
    stay = [f for f in df.schema.fields if f.name not in own and (keep is None or f.name in keep)]
    names = [f.name for f in stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                got = work(part)
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + new, names=names + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(stay + fields))


def texts_of(part: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The rows' texts in UTF-8; null counts as empty."""
    return [x or b"" for x in part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words in a row, and each text's first (one more at the end)."""
    each = [t.split() for t in texts]  # bytes.split() cuts at \x20 and \x09-\x0D alone
    starts = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) for x in each], out=starts[1:])
    return [w for x in each for w in x], starts


def hashed(words: list[bytes]) -> np.ndarray:
    """Python's 64-bit hash of each word: equal within a process, not between processes."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive codes (len(codes) - n + 1 of them, or none)."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + count]
        out ^= out >> np.uint64(29)
    return out


def window_starts(starts: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of n words: those within one text, and the text each is in."""
    count = max(total - n + 1, 0)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:count]
    ok = np.flatnonzero(np.arange(count) + n <= starts[1:][text]) if count else np.zeros(0, np.int64)
    return ok, text[ok] if count else ok


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of n places that starts in ``at``."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + n, total), -1)
    return np.cumsum(steps[:-1]) > 0
