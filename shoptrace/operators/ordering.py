"""Whole-table order statistics without an unbounded single-task sort.

* ``global_positions`` numbers rows through range partitions; nothing but one count per partition is brought together.
* ``with_cumulative`` runs sums over a table of distinct values in blocks whose number is bounded by the double format.
* ``rows_at_ranks`` finds the rows at given ranks by counting rows per range, finer with each pass; ``with_ntiles`` and
  ``first_rows`` need nothing else.

There is one path for every size, and sort keys keep their own types.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, LongType

from shoptrace.functions.rules import as_col
from shoptrace.sources.tables import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
_BLOCKS_PER_DOUBLING = 64
_HASH_HEX = 16


def global_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``position``, the 0-based place of a row in the total order.

    The order should end in a unique column: it makes the result repeatable and lets the range partitioner split a block of
    equal leading keys. Rows are range-partitioned, sorted inside partitions, tagged and written once, so the tags cannot
    change when a task is retried; then only one start per partition (a count bounded by the partition count) is broadcast.
    """
    tagged = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_tag", F.monotonically_increasing_id()),
        "ordered",
    ).select(
        "*",
        F.shiftright("_tag", _ROW_BITS).alias("_part"),
        F.col("_tag").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    sizes = tagged.groupBy("_part").agg((F.max("_row") + 1).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    return tagged.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_row") + F.col("_start")).alias("position")
    )


def first_rows(df: DataFrame, key: Column, unique: str, k: int) -> DataFrame:
    """The first k rows by ``key``, then ``unique``, in that order. Only they are sorted: the k-th is found by ``rows_at_ranks``."""
    n = df.count()
    if k <= 0:
        return df.limit(0)
    near = df
    if k < n:
        last = rows_at_ranks(df, {"key": key}, unique, {"key": [k - 1]})["key"][0]
        near = df.where(~_beyond(key, unique, last))
    return near.orderBy(key, unique)


def with_ntiles(df: DataFrame, tiles: Mapping[str, Column], unique: str, k: int) -> DataFrame:
    """Add one NTILE(k) column per entry of ``tiles`` (name -> key, ascending; ties broken by ``unique``).

    ``df`` should be a written table: it is counted, read a few times for the last row of each tile, and again for the result, in which
    the tile of a row follows from comparing it with these rows. The table is neither shuffled nor written.
    """
    n = df.count()
    size, extra = divmod(n, k)
    ends = sorted({size * t + min(t, extra) - 1 for t in range(1, k)} & set(range(n)))
    if not ends:
        return df.withColumns({name: F.lit(1).cast("bigint") for name in tiles})
    lasts = rows_at_ranks(df, tiles, unique, {name: ends for name in tiles})
    beyond = {name: sum((_beyond(tiles[name], unique, last).cast("bigint") for last in lasts[name]), F.lit(1).cast("bigint")) for name in tiles}
    return df.withColumns(beyond)


def _beyond(key: Column, unique: str, row: tuple) -> Column:
    """Whether a row comes after ``row`` = (key, unique)."""
    return (key > row[0]) | ((key == row[0]) & (F.col(unique) > row[1]))


#: Rows of one range that a task may sort, and the sub-ranges that a larger one is cut into.
SETTLED, SUBRANGES = 100_000, 65_536


def rows_at_ranks(df: DataFrame, keys: Mapping[str, Column], unique: str, ranks: Mapping[str, Sequence[int]]) -> dict[str, list[tuple]]:
    """(key, unique) of the rows at the given 0-based ranks, per key, the order being (key, unique).

    No sort of the table: rows are counted per range of the key, which tells the range a rank lies in; that range is cut finer,
    and so on, all keys and ranks in the same pass, until it holds few enough rows to be sorted (``SETTLED``) or one key alone. Rows of one
    key are then told apart by ranges of ``unique`` in the same way. A pass reads ``df`` and sends one count per range and task.

    Keys and ``unique`` are numbers (not decimals) and not NULL; a NULL raises. Ranges start as ``value_block``, of some 1% of a value.
    """
    parts = {name: [_number(df, key), _number(df, F.col(unique))] for name, key in keys.items()}
    open_ = {(name, rank): _Range(name, rank) for name, wanted in ranks.items() for rank in wanted}
    done: dict[tuple[str, int], tuple] = {}
    while open_:
        settled = {at: r for at, r in open_.items() if r.rows is not None and r.rows <= SETTLED}
        if settled:
            done |= _sorted_out(df, parts, settled)
            open_ = {at: r for at, r in open_.items() if at not in settled}
            continue
        open_ = _finer(df, parts, open_)
        for at, r in list(open_.items()):
            if r.known is not None:  # copies of one row
                done[at] = r.known
                del open_[at]
    return {name: [done[(name, rank)] for rank in wanted] for name, wanted in ranks.items()}


@dataclass(frozen=True)
class _Range:
    """Where a rank lies: part 0 is the key, 1 the unique column (then ``key`` is given); ``rank`` counts inside the range."""

    name: str
    rank: int
    part: int = 0
    key: int | float | None = None
    low: int | float | None = None
    high: int | float | None = None
    rows: int | None = None
    known: tuple | None = None

    def inside(self, parts: Sequence[Column]) -> Column:
        here = parts[self.part]
        bounds = F.lit(True) if self.low is None else here.between(F.lit(self.low), F.lit(self.high))
        return bounds if self.part == 0 else (parts[0] == F.lit(self.key)) & bounds

    def subrange(self, parts: Sequence[Column]) -> Column:
        here = parts[self.part]
        if self.low is None:
            return value_block(here)
        if isinstance(self.low, int):
            return F.floor((here - self.low) / F.lit(float((self.high - self.low) // SUBRANGES + 1))).cast("bigint")
        return F.least(F.floor((here - self.low) / (self.high - self.low) * SUBRANGES), F.lit(SUBRANGES - 1)).cast("bigint")

    def narrowed(self, rank: int, rows: int, low, high) -> _Range:
        if low != high:
            return _Range(self.name, rank, self.part, self.key, low, high, rows)
        if self.part == 0:  # one key; its rows, if many, are told apart by the unique column
            return _Range(self.name, rank, 1, low, rows=rows)
        return _Range(self.name, rank, 1, self.key, low, high, rows, (self.key, low))


def _number(df: DataFrame, key: Column) -> Column:
    """The key in its own type, as BIGINT or DOUBLE."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    if not isinstance(kind, (IntegralType, DoubleType, FloatType)):
        raise TypeError(f"rows are ranked by numbers, not {kind.simpleString()}")
    given = F.when(key.isNull(), F.raise_error(F.lit("rows are ranked by keys that are not NULL")).cast(kind)).otherwise(key)
    return given.cast("bigint" if isinstance(kind, IntegralType) else "double")


def _finer(df: DataFrame, parts: Mapping[str, Sequence[Column]], open_: dict) -> dict:
    """Each open rank with the sub-range it lies in."""
    ranges = list({(r.name, r.part, r.key, r.low, r.high): r for r in open_.values()}.values())
    number = {(r.name, r.part, r.key, r.low, r.high): i for i, r in enumerate(ranges)}
    entries = []
    for i, r in enumerate(ranges):
        here, whole = parts[r.name][r.part], isinstance(_kind(df, parts[r.name][r.part]), LongType)
        as_long, as_double = (here if whole else F.lit(None)).cast("bigint"), (F.lit(None) if whole else here).cast("double")
        entry = F.struct(F.lit(i).alias("range"), r.subrange(parts[r.name]).alias("sub"), as_long.alias("i"), as_double.alias("f"))
        entries.append(F.when(r.inside(parts[r.name]), entry))
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")
    ends = [f(c).alias(f"{name}_{c}") for c in ("i", "f") for name, f in (("low", F.min), ("high", F.max))]
    counted = rows.groupBy("range", "sub").agg(F.count(F.lit(1)).alias("n"), *ends)
    before = Window.partitionBy("range").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranks = {at: (number[(r.name, r.part, r.key, r.low, r.high)], r.rank) for at, r in open_.items()}
    holds = [(F.col("range") == i) & (F.col("before") <= rank) & (F.col("before") + F.col("n") > rank) for i, rank in set(ranks.values())]
    found = placed.where(reduce(Column.__or__, holds)).collect()  # at most one row per rank
    out = {}
    for at, (i, rank) in ranks.items():
        row = next(x for x in found if x["range"] == i and x["before"] <= rank < x["before"] + x["n"])
        low, high = (row["low_i"], row["high_i"]) if row["low_i"] is not None else (row["low_f"], row["high_f"])
        out[at] = open_[at].narrowed(rank - row["before"], row["n"], low, high)
    return out


def _kind(df: DataFrame, column: Column):
    return df.select(column.alias("k")).schema["k"].dataType


def _sorted_out(df: DataFrame, parts: Mapping[str, Sequence[Column]], settled: dict) -> dict:
    """The rows at the ranks of small ranges; each range is sorted by a task of its own."""
    numbered = list(settled.items())
    done = {}
    for name in {r.name for r in settled.values()}:
        own = [(i, r) for i, (_, r) in enumerate(numbered) if r.name == name]
        key, unique = parts[name]
        each = F.array(*[F.when(r.inside(parts[name]), F.lit(i)) for i, r in own])
        rows = df.select(F.explode(each).alias("range"), key.alias("key"), unique.alias("id")).where(F.col("range").isNotNull())
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("key", "id")) - 1)
        wanted = [(F.col("range") == i) & (F.col("rank") == r.rank) for i, r in own]
        for row in ranked.where(reduce(Column.__or__, wanted)).collect():
            done[numbered[row["range"]][0]] = (row["key"], row["id"])
    return done


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value: the pre-aggregated form the order statistics work on. Columns: by, value, n."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def value_block(value: Column | str) -> Column:
    """A monotone block number for a double.

    At most 131,072 blocks exist. A block spans about 1% of its values, so for amounts in cents it holds few distinct ones.
    """
    v = as_col(value).cast("double")
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * _BLOCKS_PER_DOUBLING)).cast("bigint")


def with_cumulative(counts: DataFrame, value: str, weights: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each weight w add ``w_before`` (sum of w over smaller values) and ``w_total``.

    ``counts`` has one row per (by, value) and should be a written table, as it is read twice. Sums run inside blocks; the
    only windows over a whole group see one row per block.
    """
    blocked = counts.withColumn("_block", value_block(value))
    per_block = blocked.groupBy(*by, "_block").agg(*[F.sum(w).alias(w) for w in weights])
    group = Window.partitionBy(*by)
    earlier_blocks = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(
        *by,
        "_block",
        *[F.coalesce(F.sum(w).over(earlier_blocks), F.lit(0)).alias(f"_{w}_start") for w in weights],
        *[F.sum(w).over(group).alias(f"{w}_total") for w in weights],
    )
    smaller = Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(starts, [*by, "_block"]).select(
        *counts.columns,
        *[(F.coalesce(F.sum(w).over(smaller), F.lit(0)) + F.col(f"_{w}_start")).alias(f"{w}_before") for w in weights],
        *[f"{w}_total" for w in weights],
    )


def quantile(q: float, value: str, weight: str = "n") -> Column:
    """Aggregate expression over ``with_cumulative`` rows: the continuous (linearly interpolated) quantile."""
    before, here = F.col(f"{weight}_before"), F.col(weight)
    place = F.lit(float(q)) * (F.col(f"{weight}_total") - 1)

    def value_at(index: Column) -> Column:
        return F.max(F.when((before <= index) & (index < before + here), F.col(value).cast("double")))

    low, high = value_at(F.floor(place)), value_at(F.ceil(place))
    return low + (high - low) * F.max(place - F.floor(place))


def histogram(counts: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the greatest value, empty bins included, the last bin closed.

    ``counts`` (value, n) should be a written table. Columns: bin (from 0), bin_start, bin_end, n.
    """
    ends = counts.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    pad = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    span = ends.select(F.struct((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi")).alias("span"))
    lo, hi = F.col("span.lo"), F.col("span.hi")
    place = F.floor((F.col(value).cast("double") - lo) / (hi - lo) * bins)
    filled = (
        counts.withColumn("span", span.scalar())
        .select(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"), "n")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    frame = counts.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("span", span.scalar())
    edge = lambda i: (lo + i * (hi - lo) / F.lit(float(bins))).cast("decimal(18,6)").cast("double")
    return (
        frame.join(F.broadcast(filled), "bin", "left")  # at most `bins` rows
        .select(
            "bin",
            edge(F.col("bin")).alias("bin_start"),
            edge(F.col("bin") + 1).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def hash_text(value: Column) -> Column:
    """A uniform 64-bit hash as 16 hexadecimal digits, whose text order is its numeric order."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, _HASH_HEX)
