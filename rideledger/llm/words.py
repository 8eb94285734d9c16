"""Words, lines and labels that several operators read alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(text: object) -> bytes:
    """UTF-8 of a text; nothing for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def words(text: object) -> list[bytes]:
    """The words of a text as UTF-8. ``bytes.split`` parts at exactly the six ASCII white space characters."""
    return utf8(text).split()


def lower_words(text: object) -> list[bytes]:
    """The words with A-Z in lower case; ``bytes.lower`` leaves everything else alone."""
    return utf8(text).lower().split()


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ids(values: pd.Series) -> list[int | None]:
    """Integer ids from a pandas column in which null may have turned numbers into floats."""
    return [None if pd.isna(value) else int(value) for value in values]


def portions(batch: pa.RecordBatch, column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and about ``size`` bytes of a column; a larger value is a slice of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(sizes, before + size, side="right"))))
        yield batch.slice(start, end - start)
        start = end
