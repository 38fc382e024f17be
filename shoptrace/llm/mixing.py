"""Mix sources to target weights by Pfair scheduling.

Documents of a source form blocks. A slot takes one block. While all sources have blocks left, source s with weight w (of a sum of
one) is due w blocks a slot; when one has run out, the others share its slots in proportion to their weights. That is a fluid
schedule whose rates always add up to one. Block j is released at the slot in which the fluid schedule begins it and due before
the slot in which it ends it (floor(j / w) and ceil((j + 1) / w) until a source has run out). Among the released blocks the one
with the earliest deadline goes first. No deadline is missed, so at any slot each source has sent less than one block more or
less than the fluid schedule, that is, than its exact weight asks while all have blocks. There is no period and no least share.

Slots are given in segments, one task each. The order at a slot depends only on blocks pending there, and a run that begins
earlier with any pending blocks of the right number meets the true one as soon as all blocks pending at its beginning are due:
for any deadline from then on, equally many earlier ones are pending. So each segment begins that much earlier and drops
the slots before its own. The rarest source sets this lead; where leads would cost more than the slots themselves, segments get longer.

No source is sorted in one task: documents are ranked within buckets of hashes, of bounded size, and bucket counts give offsets.

``interleave`` shuffles whole rows once, at any size. Ranks and slots are found on (doc_id, source, hash of the text). The slots are cut
into parts of the result; within a source a part is an interval of keys, so each row finds its part by its own key and goes there
directly. There its number among the rows of its source gives its slot. Only copies of one key that a cut divides are counted out first.

Defined results: every row gets a slot, repeated rows each their own place. A NULL source is a source of its own. Order within a
source is by a hash of doc_id and text, then doc_id, then a hash of the text. A table without rows gives no rows. Extra columns are kept by
``interleave``; columns named ``slot``, ``block`` and the like in the input do not matter, the work columns have other names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoptrace.sources.tables import materialise

#: Slots that one task gives, if the lead of the rarest source allows it, and slots whose blocks it holds at a time.
SEGMENT_SLOTS = 50_000
STEP_SLOTS = 1 << 16
BLOCK_DOCUMENTS = 32
BUCKET_DOCUMENTS = 20_000
#: Intervals of keys (sources times parts, and no more than blocks) that are broadcast; of more, Spark chooses the join.
BROADCAST_INTERVALS = 1_000_000
#: Weights follow source sizes to this power unless they are given: 1 keeps the natural mix, 0 makes all sources equal.
TEMPERATURE = 0.5


class Fluid:
    """The fluid schedule: when each source's blocks begin and end, in slots."""

    def __init__(self, weights: np.ndarray, blocks: np.ndarray):
        if not (np.isfinite(weights) & (weights > 0)).all():
            raise ValueError("every source needs a finite weight above zero")
        self.weights, self.blocks = weights / weights.sum(), blocks.astype(np.int64)
        self.total = int(self.blocks.sum())
        ends = self.blocks / self.weights  # time without exhausted sources' slots being shared out
        order = np.argsort(ends, kind="stable")
        self.ends = ends[order]
        self.gone = np.concatenate([[0], np.cumsum(self.blocks[order])])
        self.rate = np.concatenate([np.cumsum(self.weights[order][::-1])[::-1], [0.0]])
        self.end_slots = self.gone[1:] + self.ends * self.rate[1:]

    def _slots(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """When source ``i`` has sent ``j`` blocks; a whole slot where only rounding parts them."""
        at = j / self.weights[i]
        run_out = np.searchsorted(self.ends, at, "left")
        slot = self.gone[run_out] + at * self.rate[run_out]
        near = np.rint(slot)
        return np.where(np.abs(slot - near) < 1e-7 + 1e-13 * slot, near, slot)

    def release(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.floor(self._slots(i, j)).astype(np.int64)

    def due(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.ceil(self._slots(i, j + 1)).astype(np.int64)

    def released(self, slot: int) -> np.ndarray:
        """Blocks of each source that are released before ``slot``."""
        run_out = int(np.searchsorted(self.end_slots, slot, "right"))
        if slot >= self.total or run_out == len(self.blocks):
            return self.blocks.copy()
        at = (slot - self.gone[run_out]) / self.rate[run_out]
        out = np.clip(np.ceil(self.weights * at), 0, self.blocks).astype(np.int64)
        every = np.arange(len(out))
        while len(over := every[out > 0][self.release(every[out > 0], out[out > 0] - 1) >= slot]):
            out[over] -= 1
        while len(under := every[out < self.blocks][self.release(every[out < self.blocks], out[out < self.blocks]) < slot]):
            out[under] += 1
        return out

    def pending(self, slot: int) -> list[tuple[int, int, int]]:
        """(deadline, source, block) of as many blocks as are released and not sent at ``slot``, the latest deadlines."""
        out = self.released(slot)
        n = int(out.sum()) - slot
        some = np.flatnonzero(out)
        due = self.due(some, out[some] - 1)
        last = np.lexsort((some, due))[len(some) - n :]
        return list(zip(due[last].tolist(), some[last].tolist(), (out[some[last]] - 1).tolist(), strict=True))

    def lead(self, slot: int) -> int:
        """A slot from which a run has met the true schedule by ``slot``."""
        back = 64
        while back < slot:
            if max((due for due, _, _ in self.pending(slot - back)), default=0) <= slot:
                return slot - back
            back *= 2
        return 0

    def segments(self, size: int) -> list[tuple[int, int, int]]:
        """(slot to begin at, first slot, slot after the last) of each task; leads together take no more than all slots."""
        n = max(1, -(-self.total // size))
        while True:
            cuts = [self.total * k // n for k in range(n + 1)]
            begins = [0]
            for first in cuts[1:-1]:
                begins.append(self.lead(first))
                if sum(cuts[: len(begins)]) - sum(begins) > self.total:
                    break
            else:
                return list(zip(begins, cuts[:-1], cuts[1:], strict=True))
            n = -(-n // 2)

    def order(self, begin: int, first: int, last: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """(sources, blocks, slots) of the slots from ``first`` to before ``last``, simulated from ``begin`` on."""
        ready = self.pending(begin) if begin else []
        heapq.heapify(ready)
        before = self.released(begin)
        for at in range(begin, last, STEP_SLOTS):
            end = min(at + STEP_SLOTS, last)
            upto = self.released(end)
            n = upto - before
            i = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - before, n)
            release, due, before = self.release(i, j), self.due(i, j), upto
            by_release = np.argsort(release, kind="stable")
            coming = zip(*(x[by_release].tolist() for x in (release, due, i, j)), strict=True)
            following = next(coming, None)
            sent: tuple[list[int], list[int], list[int]] = ([], [], [])
            for slot in range(at, end):
                while following and following[0] <= slot:
                    heapq.heappush(ready, following[1:])
                    following = next(coming, None)
                due_at, source, block = heapq.heappop(ready)
                if slot >= first:
                    if due_at <= slot:
                        raise AssertionError("a block missed its deadline")
                    for column, value in zip(sent, (source, block, slot), strict=True):
                        column.append(value)
            yield sent


def natural_weights(counts: Mapping[str | None, int], temperature: float = TEMPERATURE) -> dict[str | None, float]:
    return {s: float(n) ** temperature for s, n in counts.items()}


def slot_table(spark: SparkSession, fluid: Fluid) -> DataFrame:
    """``_id`` (of the source), ``_block``, ``_slot`` of every block, written once."""
    tasks = fluid.segments(SEGMENT_SLOTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                for source, block, slot in fluid.order(*tasks[k]):
                    yield pd.DataFrame({"_id": source, "_block": block, "_slot": slot})

    numbers = spark.range(0, len(tasks), 1, len(tasks))
    return materialise(numbers.mapInPandas(run, "_id long, _block long, _slot long"), "slots")


def hash_range(value: Column, n: Column) -> Column:
    """Which of ``n`` equal ranges of 64-bit hashes, from 0 on, ``value`` lies in."""
    return F.shiftright((F.shiftright(value, 33) + F.lit(1 << 30)) * n, 31)


def keyed(docs: DataFrame) -> DataFrame:
    """With ``_hash``, which orders a source together with doc_id and text_hash; many rows of one doc_id, or of none, spread as well."""
    return docs.withColumn("_hash", F.xxhash64("doc_id", "text_hash"))


def scheduled(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_documents: int = BLOCK_DOCUMENTS
) -> tuple[DataFrame, int]:
    """``docs(doc_id, source, text_hash)`` with ``_hash``, ``_block`` (within its source), ``_place`` (within the block), ``_slot`` and
    ``_share`` of each row; and the number of slots.

    Without ``weights`` they come from the source sizes; with them every source present must have one.
    """
    spark = docs.sparkSession
    found = docs.groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in sorted(found, key=lambda r: (r["source"] is not None, r["source"] or ""))}
    given = natural_weights(counts) if weights is None else {s: weights[s] for s in counts}
    blocks = -(-np.array(list(counts.values()), np.int64) // block_documents)
    fluid = Fluid(np.array(list(given.values()), np.float64), blocks)
    slots = slot_table(spark, fluid)
    numbered = [pa.array(list(counts), pa.string()), pa.array(np.arange(len(counts))), pa.array(fluid.weights)]
    of_source = spark.createDataFrame(pa.table(numbered, names=["_of", "_id", "_share"]))

    buckets = max(1, -(-sum(counts.values()) // BUCKET_DOCUMENTS))
    rows = keyed(docs).withColumn("_bucket", hash_range(F.col("_hash"), F.lit(buckets)))
    sizes = rows.groupBy(F.col("source").alias("_source"), F.col("_bucket").alias("_in")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_in", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # written, so that the join below knows its size before the rows are shuffled for it
    offsets = materialise(offsets.join(of_source, F.expr("_source <=> _of")).drop("_of"), "offsets")
    order = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "text_hash")
    ranked = rows.withColumn("_row", F.row_number().over(order))
    ranked = ranked.join(offsets, F.expr("source <=> _source AND _bucket = _in"))
    rank = F.col("_offset") + F.col("_row") - 1
    ranked = ranked.withColumn("_block", F.floor(rank / block_documents)).withColumn("_place", rank % block_documents)
    ranked = ranked.drop("_source", "_in", "_offset", "_row", "_bucket")
    return ranked.join(slots, ["_id", "_block"]).drop("_id"), fluid.total


def schedule(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, source, block, place, slot, share`` (the exact weight of its source, of a sum of one)."""
    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return scheduled(narrow, **options)[0].select(
        "doc_id", "source", *(F.col(f"_{c}").alias(c) for c in ("block", "place", "slot")), F.col("_share").alias("share")
    )


KEY = ("_hash", "doc_id", "text_hash")


def key_intervals(cuts: DataFrame) -> DataFrame:
    """The keys of each part of a source: from ``_first`` to before ``_until`` (NULL: to the end), one row per range ``_in`` of ``_ranges`` hash ranges.

    ``_divided``: ``_first`` also ends an earlier part, that is, some of its copies belong there.
    """
    own, parts = Window.partitionBy("source"), Window.partitionBy("source").orderBy("_part")
    told = cuts.select(
        F.col("source").alias("_source"), "_part", "_first", F.lead("_first").over(parts).alias("_until"),
        F.coalesce(F.lag("_last").over(parts) == F.col("_first"), F.lit(False)).alias("_divided"), F.count("*").over(own).alias("_ranges"),
    )
    begin = hash_range(F.col("_first._hash"), F.col("_ranges"))
    end = F.coalesce(hash_range(F.col("_until._hash"), F.col("_ranges")), F.col("_ranges") - 1)
    return told.withColumn("_in", F.explode(F.sequence(begin, end)))


def dealt_copies(copies: DataFrame, placed: DataFrame) -> DataFrame:
    """``copies`` of keys that a cut divides, with the ``_part`` of each: as many to every part as ``placed`` has there."""
    same = Window.partitionBy("source", *KEY)
    keys = copies.select("source", *KEY).distinct()
    equal = lambda a, b: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in ("source", *KEY)))
    here = placed.alias("p").join(keys.alias("k"), equal("p", "k"), "left_semi")
    each = here.groupBy("source", *KEY, "_part").agg(F.count("*").alias("_n"))
    each = each.withColumn("_upto", F.sum("_n").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    numbered = copies.drop("_part").withColumn("_copy", F.row_number().over(same.orderBy("_hash")))
    mine = equal("c", "e") & F.expr("_copy <= _upto AND _copy > _upto - _n")
    return numbered.alias("c").join(each.alias("e"), mine).select("c.*", "_part")


def interleave(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """All rows of ``docs`` in mixed order: the parts of the result, read one after the other, follow the slots."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    placed, slots = scheduled(narrow, weights, block_documents)
    placed = placed.withColumn("_part", F.expr(f"CAST(_slot * {parts} DIV {max(1, slots)} AS INT)"))
    begins = F.when(F.col("_place") == 0, F.col("_slot"))  # one row of each block
    cuts = placed.groupBy("source", "_part").agg(
        F.min(F.struct(*KEY)).alias("_first"), F.max(F.struct(*KEY)).alias("_last"), F.sort_array(F.collect_list(begins)).alias("_slots")
    )
    cuts = materialise(cuts, "cuts")
    intervals = materialise(key_intervals(cuts), "intervals")
    seen = intervals.agg(F.count("*").alias("n"), F.coalesce(F.max("_divided"), F.lit(False)).alias("divided")).first()
    sent = F.broadcast if seen["n"] <= BROADCAST_INTERVALS else lambda table: table

    # the rows travel as one struct, so none of their columns can clash with those of the work
    rows = keyed(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("_doc")))
    ranges = intervals.select(F.col("_source").alias("_of"), F.col("_ranges").alias("_n")).distinct()
    rows = rows.join(sent(ranges), F.expr("source <=> _of")).withColumn("_range", hash_range(F.col("_hash"), F.col("_n")))
    key = F.struct(*KEY)
    within = F.expr("source <=> _source AND _range = _in") & (key >= F.col("_first")) & (F.col("_until").isNull() | (key < F.col("_until")))
    rows = rows.join(sent(intervals), within)
    columns = ["source", *KEY, "_doc", "_part"]
    if seen["divided"]:
        copy = F.col("_divided") & (key == F.col("_first"))
        rows = rows.filter(~copy).select(columns).union(dealt_copies(rows.filter(copy).select(columns), placed).select(columns))

    # one row with the slots of each source goes before its rows in every part
    both = rows.select(columns).unionByName(cuts.select("source", "_part", "_slots"), allowMissingColumns=True)
    both = both.withColumn("_after", F.col("_slots").isNull()).repartitionById(parts, "_part")
    own = Window.partitionBy("_part", "source").orderBy("_after", *KEY).rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("_doc", "_after", (F.count("*").over(own) - 2).alias("_row"), F.first("_slots").over(own).alias("_slots"))
    slot = F.get("_slots", F.expr(f"CAST(_row DIV {int(block_documents)} AS INT)"))
    both = both.filter("_after").select(slot.alias("_slot"), "_row", "_doc")
    return both.sortWithinPartitions("_slot", "_row").select("_doc.*")
