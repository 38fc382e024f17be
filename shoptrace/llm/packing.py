"""Variable-capacity best-fit packing.

Lengths are tokens of a public vocabulary. Documents longer than the longest permitted sequence are cut into pieces of that length.
Pieces go, longest first, into the open bin with the least room that still holds them. Where none does, a bin is opened. For
each permitted capacity the pieces still to come are laid into it on trial, longest first; the capacity whose contents cost least
per token, as a bin shrunk to them, is opened. At the end each bin shrinks to the smallest permitted capacity that holds its contents.

Pieces are dealt into packing groups of bounded size, each packed in one task: by hash, or, if the documents come with an order, as
runs of consecutive pieces. A group wastes at most a few bins, so the loss over one global packing vanishes with group size. In an
order, groups are numbered and leave in it, so from group to group the sequences keep the mix of the order; within a group of
20,000 pieces best-fit decides.

Defined results: every token is in exactly one piece. An empty or NULL text gives one row without a bin. Repeated rows are packed
each. Ties go by doc_id, then piece. A table without rows gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from operator import neg

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrace.llm.quality_rules import vocabulary_folder
from shoptrace.llm.token_counts import VOCABULARY, WHOLE, encoding, token_count
from shoptrace.operators.ordering import global_positions
from shoptrace.sources.tables import materialise

CAPACITIES = (512, 1024, 2048, 4096)
GROUP_PIECES = 20_000
SCHEMA = (
    "doc_id long, piece long, start long, length long, bin long, place long, opened_capacity long, capacity long"
)


def sequence_cost(capacity: int) -> float:
    """Cost of training on one sequence: linear work, attention work, and a fixed part."""
    return capacity * (1 + capacity / 16_384) + 128


def trial_fill(lengths: Sequence[int], at: int, capacity: int) -> int:
    """What a bin of ``capacity`` holds if piece ``at`` and the longest fitting ones after it go in; lengths come longest first."""
    left = capacity - lengths[at]
    at += 1
    while left > 0 and (at := bisect_left(lengths, -left, at, key=neg)) < len(lengths):
        left -= lengths[at]
        at += 1
    return capacity - left


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost):
    """Bin, offset in the bin and the bin's opened and final capacity for each length; lengths come longest first."""
    sizes = sorted(capacities)

    def cost_per_token(at: int, capacity: int) -> float:
        fill = trial_fill(lengths, at, capacity)
        return cost(sizes[bisect_left(sizes, fill)]) / fill

    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    opened: list[int] = []
    used: list[int] = []
    out: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            fitting = [c for c in sizes if c >= n]
            if not fitting:
                raise ValueError(f"length {n} exceeds the largest capacity {sizes[-1]}")
            free = min(fitting, key=lambda c: (cost_per_token(i, c), -c))
            number = len(opened)
            opened.append(free)
            used.append(0)
        out.append((number, used[number]))
        used[number] += n
        if free > n:
            insort(room, (free - n, number))
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return [(b, place, opened[b], final[b]) for b, place in out]


def token_lengths(docs: DataFrame, keep: Sequence[str] = (), folder: str | None = None, file: str = VOCABULARY) -> DataFrame:
    """``doc_id, length`` in tokens and the columns ``keep`` of each document, which have other names."""
    if {"doc_id", "length"} & set(keep):
        raise ValueError("doc_id and length are columns of the result, keep others")
    place = folder or vocabulary_folder()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("length"), *keep)

    def run(batches):
        encoders = encoding(place, file), encoding(place, file, WHOLE)
        for batch in batches:
            lengths = [token_count(t, *encoders) if t else 0 for t in batch.column("length").to_pylist()]
            columns = [pa.array(np.array(lengths, np.int64)) if c == "length" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {'long' if f.name == 'length' else f.dataType.simpleString()}" for f in narrow.schema)
    return narrow.mapInArrow(run, schema)


def pack_documents(
    lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost,
    group_pieces: int = GROUP_PIECES, order: Sequence[str] = (),
) -> DataFrame:
    """Place every document of ``lengths(doc_id, length)``; a place is a bin, an offset and the tokens it takes there.

    ``order`` names columns of ``lengths`` that are different in every row; without it groups are dealt by hash.
    """
    longest = max(capacities)
    lengths = materialise(lengths.select("doc_id", "length", *order), "lengths")
    pieces_of = F.greatest(F.ceil(F.col("length") / longest), F.lit(1))
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces_of - 1))).select(
        *order, "doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * longest).cast("long").alias("start"),
        F.least(F.lit(longest), F.col("length") - F.col("piece") * longest).cast("long").alias("length"),
    )
    total = lengths.agg(F.coalesce(F.sum(pieces_of), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_pieces))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        found = pd.DataFrame(
            pack(group["length"].tolist(), capacities, cost), columns=["bin", "place", "opened_capacity", "capacity"], index=group.index
        )
        group = group.drop(columns="group").join(found)
        group["bin"] += int(key[0]) << 32
        return group[[c.split()[0] for c in SCHEMA.split(", ")]]

    if order:
        placed = global_positions(pieces.filter("length > 0"), [F.col(c) for c in (*order, "piece")])
        dealt = placed.withColumn("group", F.floor(F.col("position") / group_pieces)).drop("position", *order)
        dealt = dealt.repartitionByRange("group")  # groupBy keeps it: parts of the result follow the groups
    else:
        dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))).filter("length > 0")
    packed = dealt.groupBy("group").applyInPandas(run, SCHEMA)
    empty = pieces.filter("length <= 0").select("doc_id", "piece", "start", "length", *(F.lit(None).cast("long").alias(c) for c in ("bin", "place", "opened_capacity", "capacity")))
    return packed.unionByName(empty)
