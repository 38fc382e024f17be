"""What several corpus operators use: the documents table, byte-level word scanning in numpy, Arrow batch helpers.

Word scanning works on whole buffers of many documents at once, so that Python runs per block of text and not per word.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that one numpy step takes; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators read; a NULL text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, 1 << 16), base, U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:size]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each row begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets in these bytes) of about ``limit`` bytes each."""
    raw, at = column_bytes(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, rows)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes that are neither blank nor 0x09 to 0x0D."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True  # a word ends with its document
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    codes = (_LOWER_CODES if lower else _CODES)[data]
    codes *= powers(_BASE, len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(codes, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal wherever the spans hold equal bytes."""
    if not len(start):
        return np.zeros(0, U)
    value = (sums[end] - sums[start]) * powers(_INVERSE, int(start.max()) + 1)[start]
    return mix(value + (end - start).astype(U) * U(0xA24BAED4963EE407))


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``size`` words, A-Z lower-cased; a document with fewer words is one run."""
    start, end, doc = words_of(data, at)
    word = span_hashes(prefix_sums(data, lower=True), start, end)
    n = len(word)
    short = np.bincount(doc, minlength=len(at) - 1)
    short = (short > 0) & (short < size)
    out, owner = np.zeros(0, U), np.zeros(0, np.int64)
    if n >= size:
        whole = doc[: n - size + 1] == doc[size - 1 :]
        value = np.zeros(n - size + 1, U)
        for k in range(size):
            value = value * U(_BASE) + word[k : n - size + 1 + k]
        out, owner = mix(value[whole] + U(size)), doc[: n - size + 1][whole]
    if short.any():
        few = short[doc]
        place = np.arange(n) - np.searchsorted(doc, doc, "left")
        value = np.zeros(len(at) - 1, U)
        np.add.at(value, doc[few], word[few] * powers(_BASE, size + 1)[place[few] + 1])
        count = np.bincount(doc, minlength=len(at) - 1).astype(U)
        docs = np.flatnonzero(short)
        out = np.concatenate([out, mix(value[docs] ^ (count[docs] * U(0xC2B2AE3D27D4EB4F)))])
        owner = np.concatenate([owner, docs])
    return out, owner


def distinct_per_document(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each document, sorted and without repeats."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if _shipped.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="shoptrace-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as package:
        for file in sorted(root.rglob("*.py")):
            package.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped["application"] = context.applicationId


_shipped: dict[str, str] = {}
