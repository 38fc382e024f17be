"""Exact removal of repeated 200-byte strings by external induced sorting.

Only sampled suffixes are sorted; all other positions take their order from them.

1. *Sample.* In every window of 200 bytes the 32-byte string with the least hash is the sample; equal windows have equal
   samples at equal offsets. A sample serves a short span of window starts. Strings that only one sample has are dropped: they
   begin no repeat.
2. *Name.* Samples whose whole span of windows is equal are one; where there are several, every window of the span is a
   repeat. Only one of them goes on, for comparison with others.
3. *Sort.* What is left is dealt by sample string and sorted by the bytes behind it. The sorted queue is Spark's external
   sort, which spills to disk, so a shard may be far larger than memory. A task reads it as a stream of sample classes.
4. *Induce.* Step d moves each suffix one byte to the left: tuples (class, preceding byte, rank) are put in order, and the
   common prefix of new neighbours is the least common prefix between their old places. A window d bytes before its sample is a
   repeat if it has a neighbour with the same d bytes before it and a common prefix of 200 - d bytes behind. Suffixes
   whose neighbours have become too different leave the queue; most leave after a few steps.

Steps 2 to 4 recur on a class with more different spans than ``CLASS_SPANS``, such as the edge of a passage that a third of all
documents share. Its tuples are dealt by bands of d: windows of one band that are equal agree in the bytes between the band's
ends, so these name a smaller class, and the spans are cut to the band. Bands narrow by a factor of four (64, 16, 4, 1) until a
class fits a task; at one window a band all spans of a class are equal, so the recursion ends. The text itself is shuffled once,
for both the spans that need sorting and the final cut.

Defined results: a NULL text has no bytes. Texts under 200 bytes lose nothing. Repeated rows are occurrences of their own, so a
repeated row of 200 bytes or more is removed wholly. A NULL doc_id stays NULL. A row is addressed by
doc_id and a 64-bit hash of its text; rows equal in both share this key, and each of them is an occurrence. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrace.llm.shared import U, column_bytes, id_and_text, mix
from shoptrace.sources.tables import materialise

WIDTH = 200
SAMPLE = 32
#: Spans of one class that one task sorts; a task holds about 400 bytes for each.
CLASS_SPANS = 20_000
BATCH_SPANS = 8_192
#: Widths of the bands that a larger class is parted into, as powers of two, level by level.
BAND_BITS = (6, 4, 2, 0)
_NULL_ID = -(1 << 63)
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def sample_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SAMPLE`` bytes from each position on, by doubling."""
    value, factor, step = _BYTE[data], 0xD6E8FEB86659FD93, 1
    while step < SAMPLE:
        value = value[:-step] * U(factor) + value[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    return mix(value)


def samples(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sample hash, position, first and last window start it serves) in one run of bytes, leftmost sample first."""
    grams = width - SAMPLE + 1
    value = sample_hashes(data)
    low, size = value, 1
    while size * 2 <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if grams > size:
        low = np.minimum(low[: len(low) - (grams - size)], low[grams - size :])
    begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    end = np.concatenate([begin[1:], [len(low)]]) - 1
    where = np.empty(len(begin), np.int64)
    for i in range(0, len(begin), 4096):
        part = begin[i : i + 4096]
        where[i : i + 4096] = part + (value[part[:, None] + np.arange(grams)] == low[part][:, None]).argmax(axis=1)
    # the least value may stand at several places: each window takes the leftmost one it holds
    cut = where < end
    if cut.any():
        parts = []
        for b, e, w in zip(begin[cut].tolist(), end[cut].tolist(), where[cut].tolist(), strict=True):
            start = b
            for place in (w + np.flatnonzero(value[w : e + grams] == value[w])).tolist():
                if start <= min(place, e):
                    parts.append((start, min(place, e), place))
                    start = place + 1
        extra = np.array(parts, np.int64).T
        begin, end, where = (np.concatenate([x[~cut], y]) for x, y in zip((begin, end, where), extra, strict=True))
    return value[where], where, begin, end


def _runs(batches):
    """(doc_id, tag, bytes of the text) with texts of a window or more."""
    for batch in batches:
        ids, tags = batch.column("doc_id").to_numpy(False), batch.column("tag").to_numpy(False)
        raw, at = column_bytes(batch.column("text"))
        for i in np.flatnonzero(np.diff(at) >= WIDTH).tolist():
            yield ids[i], tags[i], raw[at[i] : at[i + 1]]


def _chunks(rows, names: list[str], kinds: list):
    held, size = [[] for _ in names], 0
    for parts in rows:
        for column, part in zip(held, parts, strict=True):
            column.append(part)
        size += len(parts[0])
        if size >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(held, kinds, strict=True)], names=names)
            held, size = [[] for _ in names], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(held, kinds, strict=True)], names=names)


def _sample_names(batches):
    def rows():
        for _, _, data in _runs(batches):
            yield (samples(data)[0].view(np.int64),)

    yield from _chunks(rows(), ["sample"], [pa.int64()])


def pack_place(position: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Position, and how far the farthest and nearest window start lie before it, in 64 bits."""
    return (position << 16) | (most << 8) | least


def _sample_rows(batches):
    def rows():
        for doc, tag, data in _runs(batches):
            name, at, begin, end = samples(data)
            raw = data.tobytes()
            hashed = [xxhash.xxh3_64_intdigest(raw[b : e + WIDTH]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            place = pack_place(at, at - begin, at - end)
            yield name.view(np.int64), np.array(hashed, U).view(np.int64), np.full(len(at), doc), np.full(len(at), tag), place

    yield from _chunks(rows(), ["sample", "span", "doc", "tag", "place"], [pa.int64()] * 5)


def _spans_of_docs(batches):
    """Bytes of each wanted span: behind the sample, and before it read backwards."""
    for batch in batches:
        raw, at = column_bytes(batch.column("text"))
        column = batch.column("wanted")
        rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        flat = column.flatten()
        sample, place = (flat.field(k).to_numpy(False) for k in (0, 1))
        position, most, least = place >> 16, (place >> 8) & 255, place & 255
        start = at[rows] + position
        behind = [raw[s : s + WIDTH - d].tobytes() for s, d in zip(start.tolist(), least.tolist(), strict=True)]
        before = [raw[s - m : s][::-1].tobytes() for s, m in zip(start.tolist(), most.tolist(), strict=True)]
        doc, tag = (batch.column(c).to_numpy(False)[rows] for c in ("key", "tag"))
        for i in range(0, len(rows), 20_000):
            part = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[part]) for c in (sample, doc, tag, place)), pa.array(behind[part], pa.binary()), pa.array(before[part], pa.binary())],
                names=["sample", "doc", "tag", "place", "behind", "before"],
            )


def _matrix(column: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.uint8)
    for i, b in enumerate(column):
        out[i, : len(b)] = np.frombuffer(b, np.uint8)
    return out


class _Least:
    """Least value of ranges of an array, by tables of doubling width."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """min(values[first : last + 1]) for first <= last."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        return out


def induce(group: np.ndarray, behind: list[bytes], before: list[bytes], most: np.ndarray, least: np.ndarray, width: int = WIDTH):
    """(row, d) of every window that has an equal one; rows come sorted by (group, behind)."""
    n = len(group)
    right, left = _matrix(behind, width), _matrix(before, int(most.max()) + 1 if n else 1)
    size = np.array([len(b) for b in behind])
    common = np.zeros(n, np.int64)  # with the row above, 0 at the head of a group
    if n > 1:
        different = right[1:] != right[:-1]
        same = np.where(different.any(axis=1), different.argmax(axis=1), width)
        same = np.minimum(same, np.minimum(size[1:], size[:-1]))
        common[1:] = np.where(group[1:] == group[:-1], same, 0)
    rows = np.arange(n)
    cell = group
    found_row, found_d = [], []
    d = 0
    while len(rows) > 1:
        below = np.append(common[1:], 0)
        near = np.maximum(common, below)
        hit = (least[rows] <= d) & (near >= width - d)
        found_row.append(rows[hit])
        found_d.append(np.full(int(hit.sum()), d))
        d += 1
        stay = np.flatnonzero((most[rows] >= d) & (near >= width - most[rows]))
        if len(stay) < 2:
            break
        ranges = _Least(common)
        char = left[rows[stay], d - 1].astype(np.int64)
        _, dense = np.unique(cell[stay], return_inverse=True)
        key = dense * 256 + char
        order = np.argsort(key, kind="stable")
        place = stay[order]
        cell = key[order]
        rows = rows[place]
        common = np.zeros(len(rows), np.int64)
        linked = np.flatnonzero(cell[1:] == cell[:-1]) + 1
        if not len(linked):
            break
        common[linked] = ranges.between(place[linked - 1] + 1, place[linked])
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_d)


def _repeated_bytes(spans: pa.Table) -> pa.RecordBatch:
    """(doc, tag, begin, end) of the bytes that repeated windows cover; ``spans`` holds whole classes in order."""
    sample, doc, tag, place = (spans.column(c).to_numpy() for c in ("sample", "doc", "tag", "place"))
    position, most, least = place >> 16, (place >> 8) & 255, place & 255
    group = np.cumsum(np.concatenate([[0], sample[1:] != sample[:-1]]))
    row, d = induce(group, spans.column("behind").to_pylist(), spans.column("before").to_pylist(), most, least)
    order = np.lexsort((-d, row))
    row = row[order]
    start = position[row] - d[order]
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row[first]]), pa.array(tag[row[first]]), pa.array(start[first]), pa.array(start[last] + WIDTH)],
        names=["doc", "tag", "begin", "end"],
    )


def _repeated_windows(batches):
    """Read the sorted queue; whole classes of about ``BATCH_SPANS`` spans are worked on at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < BATCH_SPANS:
            continue
        queue = pa.Table.from_batches(held)
        sample = queue.column("sample").to_numpy()
        changes = np.flatnonzero(sample[1:] != sample[:-1]) + 1
        if len(changes):
            complete = int(changes[-1])
            yield _repeated_bytes(queue.slice(0, complete))
            held = queue.slice(complete).combine_chunks().to_batches()
    if sum(map(len, held)):
        yield _repeated_bytes(pa.Table.from_batches(held))


SPAN_SCHEMA = "sample long, doc long, tag long, place long, behind binary, before binary"
_SPAN_BYTES = [("sample", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("place", pa.int64()), ("behind", pa.binary()), ("before", pa.binary())]


def bands(sample: int, position: int, most: int, least: int, behind: bytes, before: bytes, bits: int):
    """The parts of one span, for each band of 2**bits distances that it meets: (class, span, place, behind, before)."""
    for low in range(least >> bits << bits, most + 1, 1 << bits):
        high = min(low + (1 << bits) - 1, WIDTH - SAMPLE)
        far, near = min(most, high), max(least, low)
        left, right = before[:far], behind[: WIDTH - near]
        name = xxhash.xxh3_64_intdigest(b"%d,%d," % (sample, low) + left[:low] + right[: WIDTH - high])
        span = xxhash.xxh3_64_intdigest(left + right, far << 8 | near)
        yield name, span, position << 16 | far << 8 | near, right, left


def _banded(bits: int):
    def part(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c, _ in _SPAN_BYTES)
            rows = []
            for sample, doc, tag, place, behind, before in zip(*columns, strict=True):
                for name, span, where, right, left in bands(sample, place >> 16, place >> 8 & 255, place & 255, behind, before, bits):
                    rows.append((name, doc, tag, where, right, left, span))
            fields = list(zip(*rows, strict=True)) if rows else [()] * 7
            named = np.array(fields[0], U).view(np.int64), *fields[1:6], np.array(fields[6], U).view(np.int64)
            kinds = [*_SPAN_BYTES, ("span", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(named, kinds, strict=True)], names=[n for n, _ in kinds])

    return part


def refined(rows: DataFrame, class_spans: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Part classes of more than ``class_spans`` spans: tables of spans of smaller classes, and (doc, tag, begin, end) of equal spans.

    ``rows`` holds ``sample doc tag place behind before`` and is read once for each level. A hot class or span is combined in
    the tasks that read it; no level brings it together.
    """
    most, least, position = F.expr("shiftright(place, 8) & 255"), F.expr("place & 255"), F.shiftright("place", 16)
    names = [n for n, _ in _SPAN_BYTES]
    small, equal = [], []
    for bits in BAND_BITS:
        parts = materialise(rows.mapInArrow(_banded(bits), f"{SPAN_SCHEMA}, span long"), "bands")
        spans = parts.groupBy("sample", "span").agg(F.count("*").alias("n"), F.min(F.struct(*names[1:])).alias("first"))
        spans = materialise(spans, "band-spans")
        copies = spans.filter("n > 1").select("sample", "span")
        whole = parts.join(copies, ["sample", "span"])
        equal.append(whole.select("doc", "tag", (position - most).alias("begin"), (position - least + WIDTH).alias("end")))
        sizes = spans.groupBy("sample").agg(F.count("*").alias("n_spans")).filter("n_spans > 1")
        unlike = spans.join(sizes, "sample").select("n_spans", "sample", "first.*")
        fits = F.col("n_spans") <= class_spans if bits else F.lit(True)
        small.append(unlike.filter(fits).select(names))
        large = unlike.filter(~fits)
        if not bits or not large.limit(1).count():
            break
        rows = materialise(large.select(names), "hot-bands")
    return small, equal


def _cut(batches):
    for batch in batches:
        raw, at = column_bytes(batch.column("text"))
        spans = batch.column("removed")
        ends = spans.offsets.to_numpy()
        flat = spans.flatten()
        begin, end = (flat.field(k).to_numpy(False) for k in (0, 1))
        out = []
        for i in range(len(batch)):
            data = raw[at[i] : at[i + 1]]
            cuts: list[list[int]] = []
            for b, e in sorted(zip(begin[ends[i] : ends[i + 1]].tolist(), end[ends[i] : ends[i + 1]].tolist(), strict=True)):
                if cuts and b <= cuts[-1][1]:
                    cuts[-1][1] = max(cuts[-1][1], e)
                else:
                    cuts.append([b, e])
            kept, place = hashlib.sha256(), 0
            for b, e in cuts:
                kept.update(data[place:b])
                place = e
            kept.update(data[place:])
            spelled = ",".join(f"{b}:{e}" for b, e in cuts)
            out.append((len(data), sum(e - b for b, e in cuts), len(cuts), kept.hexdigest(), spelled))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans"],
        )


def repeated_strings(docs: DataFrame, class_spans: int = CLASS_SPANS) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, SHA-256 of what is left, and the runs as ``begin:end``."""
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(_NULL_ID)).alias("key")
    narrow = id_and_text(docs).select(key, F.xxhash64("text").alias("tag"), "text")
    scanned = narrow.withColumnRenamed("key", "doc_id")

    # 1. samples whose string occurs again
    names = scanned.mapInArrow(_sample_names, "sample long").groupBy("sample").agg(F.count("*").alias("n"))
    again = materialise(names.filter("n > 1").select("sample"), "again")  # written, so that the join below can split hot samples
    found = scanned.mapInArrow(_sample_rows, "sample long, span long, doc long, tag long, place long").join(again, "sample")
    found = materialise(found, "samples")

    # 2. equal spans are one
    spans = found.groupBy("sample", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tag", "place")).alias("first"))
    spans = materialise(spans, "spans")
    copies = spans.filter("n > 1").select("sample", "span")
    most, least = F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    position = F.shiftright("place", 16)
    whole = found.join(copies, ["sample", "span"]).select(
        "doc", "tag", (position - most).alias("begin"), (position - least + WIDTH).alias("end")
    )

    # 3. and 4. different spans of one sample
    classes = spans.groupBy("sample").agg(F.count("*").alias("n_spans")).filter("n_spans > 1")
    wanted = spans.join(classes, "sample").select(
        "sample", "first.doc", "first.tag", "first.place", (F.col("n_spans") > class_spans).alias("hot")
    )
    of_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("sample", "place", "hot")).alias("wanted"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartition(parts, "key", "tag")
    with_spans = dealt.join(of_doc.withColumnsRenamed({"doc": "_doc", "tag": "_tag"}), F.expr("key = _doc AND tag = _tag"))

    def bytes_of(rows: DataFrame, hot: bool) -> DataFrame:
        chosen = rows.withColumn("wanted", F.filter("wanted", lambda x: x["hot"] == F.lit(hot)))
        return chosen.filter(F.size("wanted") > 0).select("key", "tag", "text", "wanted").mapInArrow(_spans_of_docs, SPAN_SCHEMA)

    queues, pieces = [bytes_of(with_spans, False)], [whole]
    if wanted.filter("hot").limit(1).count():
        smaller, equal = refined(materialise(bytes_of(with_spans, True), "hot"), class_spans)
        queues, pieces = queues + smaller, pieces + equal
    queue = reduce(DataFrame.unionByName, queues).repartition(parts, "sample").sortWithinPartitions("sample", "behind")
    pieces.append(queue.mapInArrow(_repeated_windows, "doc long, tag long, begin long, end long"))
    removed = reduce(DataFrame.unionByName, pieces)
    removed = removed.groupBy("doc", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("removed"))
    removed = removed.withColumnsRenamed({"doc": "_doc", "tag": "_tag"})
    cut = dealt.join(removed, F.expr("key = _doc AND tag = _tag"), "left")
    doc_id = F.when(F.col("key") != _NULL_ID, F.col("key")).alias("doc_id")
    cut = cut.select(doc_id, "text", F.coalesce("removed", F.array().cast("array<struct<begin:long,end:long>>")).alias("removed"))
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans string")
