"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs, a paragraph that of its sentences, and a sentence of more than ``LONG`` characters that
of pieces that end where a hash of the last ``WINDOW`` characters says so: an edit there changes the piece it falls into, not
the others. Each unit is hashed to a wide vector; a fingerprint is the sum of the vectors modulo powers of two. So the order of
paragraphs and sentences does not matter, adding or deleting a unit adds or subtracts its vector, and equal multisets are equal vectors.

Lanes, all little-endian in one byte string:

* a count of units modulo 2**32,
* ``WIDE`` dense lanes modulo 2**64, which every unit enters: for equality,
* ``LEVELS`` x ``CELLS`` sparse lanes modulo 2**16: a unit enters one cell on each level up to its own, half as many units reach
  each next level: for likeness. Zero bytes at the end are not written. The last levels are sparse for any text that Spark can hold.

Likeness of two fingerprints estimates the share of different units that occur equally often in both, among those in either.
Cells that differ give the number of units that do not, cells used in either give the number of all: a share x of touched cells
means -CELLS * ln(1 - x) units on that level. Each number is read on the first level where at most ``FILLED`` of the cells are
touched. It is 1 for equal fingerprints.

The edited text keeps the first three quarters of a document and ends with the beginning of the next one by doc_id. Its
fingerprint is made incrementally: units of the old ending are taken away, units of the new ending added.

Neighbours are found without one global window: ranges of (doc_id, hash of the text) are dealt to partitions and sorted there, and
the first row of each range also goes, once, to the range before it. A doc_id with many rows, NULL included, takes several
ranges; only rows equal in both columns stay together.

Defined results: a NULL text is empty. Rows with equal doc_id follow in the order of a hash of the text; repeated rows are
neighbours. Rows without a doc_id come first. A single row is its own next document. No rows give no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrace.llm.shared import U, id_and_text, mix

WIDE = 16
LEVELS = 26
CELLS = 64
FILLED = 0.6
#: A paragraph is taken as its sentences: cut after a stop and blanks, or a full-width stop. A sentence has some characters
#: before its stop, so that "!! " after every word makes no units; the look-behind never leaves the sentence.
#: It begins with one set of characters, so that it is tried there only.
UNIT = re.compile(
    r"[\n 。！？｡](?:(?<=\n)\n*|(?<=[.!?] )(?<=[^.!?。！？｡\n]{12}..) *|(?<=[^.!?。！？｡\n]{6}(?P<stop>[。！？｡])) *)"
)
#: Longer units are cut after one of ``PIECE`` windows on average.
LONG, WINDOW, PIECE = 64, 8, 32
#: Characters whose window hashes are taken at once.
STEP = 1 << 20
_BASE = U(0xD6E8FEB86659FD93)
_SEEDS = mix(np.arange(1, WIDE + 1, dtype=U) * U(0x9E3779B97F4A7C15))
BYTES = 4 + 8 * WIDE + 2 * LEVELS * CELLS


def _window_ends(text: str) -> np.ndarray:
    """Places in ``text`` after a window whose hash allows a cut."""
    found = []
    for at in range(0, len(text) - WINDOW + 1, STEP):
        points = np.frombuffer(text[at : at + STEP + WINDOW - 1].encode("utf-32-le"), np.uint32).astype(U)
        value = np.zeros(len(points) - WINDOW + 1, U)
        for k in range(WINDOW):
            value = value * _BASE + points[k : len(value) + k]
        found.append(np.flatnonzero(mix(value) % U(PIECE) == 0) + at + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def units(text: str) -> list[str]:
    """The units of a text: paragraphs or sentences, long ones in pieces; windows do not reach over the ends of a sentence."""
    starts, ends = [0], []
    for cut in UNIT.finditer(text):
        ends.append(cut.start() + (cut["stop"] is not None))
        starts.append(cut.end())
    ends.append(len(text))
    first, last = np.array(starts), np.array(ends)
    if (last - first).max() > LONG:
        cuts = _window_ends(text)
        of = np.searchsorted(first, cuts, "right") - 1
        inside = (last[of] - first[of] > LONG) & (first[of] + WINDOW <= cuts) & (cuts < last[of])
        starts, ends = np.sort(np.concatenate([first, cuts[inside]])).tolist(), np.sort(np.concatenate([last, cuts[inside]])).tolist()
    return [text[a:b] for a, b in zip(starts, ends, strict=True) if a < b]


class Sums:
    """Fingerprints of several unit multisets as lane arrays; rows can be added and subtracted."""

    def __init__(self, texts: list[list[str]]):
        n = len(texts)
        owner = np.repeat(np.arange(n), [len(t) for t in texts])
        seed = np.array([xxhash.xxh3_64_intdigest(u) for t in texts for u in t], U)
        self.count = np.bincount(owner, minlength=n).astype(np.uint32)
        self.dense = np.zeros((n, WIDE), U)
        self.sparse = np.zeros((n, LEVELS * CELLS), np.uint16)
        if not len(seed):
            return
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for k in range(WIDE):
            self.dense[owner[starts], k] = np.add.reduceat(mix(seed ^ _SEEDS[k]), starts)
        drawn = mix(seed + U(0xA0761D6478BD642F))
        cell = (drawn & U(CELLS - 1)).astype(np.int64)
        worth = (drawn >> U(8)).astype(np.uint16) | np.uint16(1)
        rank = (drawn >> U(24)).astype(np.int64) & ((1 << LEVELS) - 1)
        for level in range(LEVELS):
            reach = (rank & ((1 << level) - 1)) == 0
            owner, cell, worth, rank = owner[reach], cell[reach], worth[reach], rank[reach]
            if not len(rank):
                break
            np.add.at(self.sparse, (owner, level * CELLS + cell), worth)

    def changed(self, removed: Sums, added: Sums) -> Sums:
        out = Sums.__new__(Sums)
        out.count = self.count - removed.count + added.count
        out.dense = self.dense - removed.dense + added.dense
        out.sparse = self.sparse - removed.sparse + added.sparse
        return out

    def rows(self, first: int, last: int) -> Sums:
        out = Sums.__new__(Sums)
        out.count, out.dense, out.sparse = self.count[first:last], self.dense[first:last], self.sparse[first:last]
        return out

    def strings(self) -> list[str]:
        packed = np.concatenate([x.view(np.uint8).reshape(len(self.count), -1) for x in (self.count, self.dense, self.sparse)], axis=1)
        return [base64.b64encode(row.tobytes().rstrip(b"\0")).decode() for row in packed]


def _touched(cells: np.ndarray) -> np.ndarray:
    """Estimated number of units that touch the cells marked in each row."""
    share = cells.reshape(len(cells), LEVELS, CELLS).mean(axis=2)
    level = np.argmax(share <= FILLED, axis=1)  # the last level of any text is sparse
    at = np.take_along_axis(share, level[:, None], 1)[:, 0]
    return -np.log1p(-np.minimum(at, 1 - 0.5 / CELLS)) * np.exp2(level)


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """Likeness of the rows of ``a`` to those of ``b``, from the lanes alone."""
    differ, used = _touched(a.sparse != b.sparse), _touched((a.sparse != 0) | (b.sparse != 0))
    share = np.clip(1 - differ / np.maximum(used, 1e-9), 0, 1)
    equal = (a.count == b.count) & (a.dense == b.dense).all(axis=1)
    return np.where(equal, 1.0, share)


def parse(fingerprint: str) -> Sums:
    """The lanes of one fingerprint string."""
    raw = np.frombuffer(base64.b64decode(fingerprint).ljust(BYTES, b"\0"), np.uint8)
    out = Sums.__new__(Sums)
    out.count = raw[:4].view(np.uint32)
    out.dense = raw[4 : 4 + 8 * WIDE].copy().view(U)[None]
    out.sparse = raw[4 + 8 * WIDE :].copy().view(np.uint16)[None]
    return out


def fingerprint_texts(texts: list[str]) -> list[str]:
    return Sums([units(t) for t in texts]).strings()


def _tail_units(text: str, keep: int) -> tuple[list[str], int]:
    """Units of ``text`` from the sentence that ``keep`` falls into or follows on, and where that sentence begins."""
    begin = 0
    for cut in UNIT.finditer(text):
        if cut.end() >= keep:
            break
        begin = cut.end()
    return units(text[begin:]), begin


#: Rows worked on at once, and the characters of text after which a chunk is closed.
CHUNK_ROWS, CHUNK_CHARS = 1024, 4_000_000
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(rows: list[tuple], own: Sums) -> pa.RecordBatch:
    """``rows`` and one row more, the next of the last; ``own`` holds the fingerprints of them all."""
    n = len(rows) - 1
    old_tails, new_tails, digests = [], [], []
    for (_, text), (_, after) in zip(rows[:-1], rows[1:], strict=True):
        drop = len(text) // 4
        keep = len(text) - drop
        edited = text[:keep] + after[:drop]
        old, begin = _tail_units(text, keep)
        old_tails.append(old)
        new_tails.append(units(edited[begin:]))
        digests.append(hashlib.sha256(edited.encode()).hexdigest())
    mine, following = own.rows(0, n), own.rows(1, n + 1)
    changed = mine.changed(Sums(old_tails), Sums(new_tails))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(r[1]) for r in rows[:-1]], pa.int64()), pa.array(digests, pa.string()),
            pa.array(mine.strings(), pa.string()), pa.array(changed.strings(), pa.string()),
            pa.array(likeness(mine, changed), pa.float64()), pa.array(likeness(mine, following), pa.float64()),
        ],
        names=[c.split()[0] for c in _COLUMNS.split(", ")],
    )


def _in_order(batches):
    """Rows sorted by (part, order); each part ends with the first row of the following one, which gets no row itself."""
    held: list[tuple] = []
    part, size = None, 0

    def close():
        return _edited(held, Sums([units(t) for _, t in held]))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))
        for p, guest, doc_id, text in zip(*columns, strict=True):
            if guest and part != p:
                continue  # a part without rows of its own
            if not guest and p != part:
                held, part, size = [], p, 0
            held.append((doc_id, text))
            size += len(text)
            if guest:
                if len(held) > 1:
                    yield close()
                held, part, size = [], None, 0
            elif len(held) > CHUNK_ROWS or (size > CHUNK_CHARS and len(held) > 1):
                yield close()
                held, size = held[-1:], len(text)


def range_bounds(quantiles: list[float]) -> list[tuple[int, int]]:
    """Lower bounds (key, hash) of ranges; a key that is several quantiles is cut as often, at even distances of the hash."""
    keys = sorted(min(int(q), (1 << 63) - 1) for q in quantiles)
    return [(k, i * (1 << 64) // n - (1 << 63)) for k, n in sorted(Counter(keys).items()) for i in range(n)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses."""
    spark = docs.sparkSession
    narrow = id_and_text(docs)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(low))
    found = narrow.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    h = F.xxhash64("text")
    bounds = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(t).alias("h")) for k, t in range_bounds(found or [])))
    # no bounds at all: the empty array has no type to compare with
    part = F.size(F.filter(bounds, lambda c: c <= F.struct(key.alias("key"), h.alias("h")))) if found else F.lit(0)
    keyed = narrow.select(key.alias("key"), h.alias("h"), part.alias("part"), "doc_id", "text")
    heads = keyed.groupBy("part").agg(F.min(F.struct("key", "h")).alias("first")).orderBy("part").collect()  # one row per range
    if not heads:
        return spark.createDataFrame([], _COLUMNS)
    following = {heads[i]["first"]: heads[i - 1]["part"] for i in range(len(heads))}
    rows = [(f["key"], f["h"], p) for f, p in following.items()]
    guests = spark.createDataFrame(rows, "head_key long, head_h long, before int")
    joined = keyed.join(F.broadcast(guests), F.expr("key = head_key AND h = head_h"), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    extra = F.struct(F.col("before").alias("part"), F.lit(True).alias("guest"))
    spread = joined.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    spread = spread.select("at.part", "at.guest", "key", "h", "doc_id", "text")
    order = spread.repartitionByRange(parts, "part").sortWithinPartitions("part", "guest", "key", "h")
    return order.select("part", "guest", "doc_id", "text").mapInArrow(_in_order, _COLUMNS)
