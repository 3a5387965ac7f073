"""Word and batch helpers of the text operators.

A word is a run of anything but ASCII white space, ``[^\\x20\\x09-\\x0D]+``;
``bytes.split()`` cuts UTF-8 at exactly those characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The same words for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python step turns into Python objects at once.
ROWS = 256


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def n_words(text: Column | str) -> Column:
    """Number of words, JVM-side; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def batches(it: Iterator[pa.RecordBatch], f: Callable[[list[dict[str, list]]], pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Apply ``f(columns)`` to slices of at most ``rows`` rows, so that a batch of
    very long texts is never held as Python objects in full."""
    for b in it:
        for k in range(0, b.num_rows, rows):
            yield f(b.slice(k, rows).to_pydict())


def map_texts(df: DataFrame, f: Callable[[dict[str, list]], pa.RecordBatch], schema: str, rows: int = ROWS) -> DataFrame:
    return df.mapInArrow(lambda it: batches(it, f, rows), schema)


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as make it differ from all columns."""
    have = {c.lower() for c in columns}
    while (name := "_" + name).lower() in have:
        pass
    return name


def quoted(columns: list[str]) -> list[Column]:
    """Columns by name, whatever characters it has."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with other names for columns whose own has a dot or a backtick, which steps in Python
    cannot take; as it is where there are none. :func:`renamed` gives the old names back."""
    out: list[str] = []
    for c in df.columns:
        out.append(free_name([*df.columns, *out], "column") if "." in c or "`" in c else c)
    return renamed(df, out)


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df if df.columns == names else df.toDF(*names)
