"""Helpers that several operators share: Arrow batches, word lists, staged tables."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.sources.stores import staged

__all__ = ["staged", "settled", "table", "pick", "texts", "type_of", "batch_of", "partitions", "latin_words", "space_words", "compressed", "unpacked", "LATIN", "LATIN_WORD", "SPACE_WORD", "merged", "lean", "lean_group", "lean_pair"]

#: A word of the benchmark rule, after A-Z became a-z: digits, a-z and everything beyond ASCII.
LATIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A word between ASCII white space.
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes with A-Z as a-z, and every byte outside a Latin word as a blank.
LATIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names, so that others cannot clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def texts(column: pa.Array, at_once: int = 128) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, null as empty; only a few are Python objects at a time."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    for at in range(0, len(column), at_once):
        for value in column.slice(at, at_once).to_pylist():
            yield value or b""


def given_back() -> None:
    """What Arrow and the C library hold in reserve goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function of ``mapInArrow``, giving memory back at its end: workers outlive tasks and take turns, so what each keeps adds up."""
    def through(batches):
        try:
            yield from run(batches)
        finally:
            given_back()

    return through


def lean_group(run: Callable[[tuple, pa.Table], pa.Table]):
    """The same of ``applyInArrow``, after every group."""
    def through(key, table):
        try:
            return run(key, table)
        finally:
            given_back()

    return through


def lean_pair(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]):
    """The same of ``applyInArrow`` on two tables."""
    def through(key, left, right):
        try:
            return run(key, left, right)
        finally:
            given_back()

    return through


def compressed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and ``data``, the text's bytes compressed for their way between stages; null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compressor.compress(t) for t in texts(batch.column(1))], pa.binary())], names=[id_col, "data"])

    return rows.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {type_of(rows, id_col)}, data binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """The bytes behind compressed values, null as empty."""
    decompressor = zstandard.ZstdDecompressor()
    for data in texts(column):
        yield decompressor.decompress(data) if data else b""


def settled(df: DataFrame) -> DataFrame:
    """A staged table; shuffle files of the steps before it go now, and not when the driver happens to collect its garbage."""
    out = staged(df)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def latin_words(text: bytes) -> list[bytes]:
    """Words as LATIN_WORD finds them in the text with A-Z in lower case."""
    return text.translate(LATIN).split()


def space_words(text: bytes) -> list[bytes]:
    """Words as SPACE_WORD finds them in the text with A-Z in lower case."""
    return text.lower().split()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted half-open ranges with touching or overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def sha_of(parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", parts), 256)
