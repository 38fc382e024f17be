"""Fixed-size samples without writing or sorting the sampled table.

Every row (or key) has a uniform 64-bit hash of its own; a sample of n are the n smallest. How many rows there are is counted first, by
a narrow pass; that gives a bound below which somewhat more than n hashes are to be expected, and a second pass keeps only those.
They are some n rows, written and cut to exactly n. Should a bound have been too low, it is raised and the pass repeated. No
task holds more than its part of these rows, however many rows, groups or copies there are, and the result does not depend on how the
data lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.operators.ordering import hash_text
from shoptrace.sources.tables import materialise, release, written

#: Copies of one row that one task hashes; more are dealt out.
COPIES = 1 << 20
#: Expected rows below the bound, in n; and how far a bound that was too low is raised.
MARGIN, RAISE = 1.1, 4.0


def place(h: Column) -> Column:
    """A hash as a number in [0, 1), by its first 48 bits."""
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def _wanted(n: int) -> float:
    return MARGIN * n + 8 * math.sqrt(n) + 16


def sample_n(df: DataFrame, n: int, seed: int = 0, spelled: Column | None = None) -> DataFrame:
    """Exactly n rows drawn without replacement, each row (copies counted singly) equally likely; all rows when fewer.

    Filter first, then sample. A row is drawn by the hash of seed, row and copy number, so the same rows come out for any layout
    of the data. ``spelled`` is the row as text (JSON unless given). Copies are told apart by numbering them, for which equal rows are
    brought together, folded to one in the scan tasks; where a key is known, ``sample_by_key`` needs no shuffle at all.
    """
    return _drawn(df, (), n, seed, spelled)


def sample_per_group(df: DataFrame, by: Sequence[str], n: int, seed: int = 0, spelled: Column | None = None) -> DataFrame:
    """A stratified sample: n rows of every group (all rows of a smaller one), drawn as by ``sample_n`` within each.

    All groups are drawn in the same pass, a hot one with a bound as much lower as it is larger. NULL is a group.
    """
    if not by:
        raise ValueError("sample_per_group needs the columns of the groups")
    return _drawn(df, tuple(by), n, seed, spelled)


def sample_by_key(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows with the smallest salted hashes of a unique key: a uniform sample that is the same on every run and layout."""
    return _least(lambda share: _near(df, key, seed, share), df.count(), n).drop("_h")


def sample_groups(df: DataFrame, key: str, n: int, grouped: Callable[[DataFrame], DataFrame], seed: int = 0) -> DataFrame:
    """n rows of ``grouped(df)``, which has one row per ``key``: the same as ``sample_by_key(grouped(df), key, n, seed)``.

    Keys are drawn before their rows are brought together, so rows of other keys are never shuffled. How many keys there are is
    estimated by a sketch in a narrow pass.
    """
    keys = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    return _least(lambda share: _with_hash(grouped(_near(df, key, seed, share).drop("_h")), key, seed), keys * 0.9, n).drop("_h")


def _with_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_h", hash_text(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def _near(df: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    return _with_hash(df, key, seed).where(place(F.col("_h")) < share)


def _least(near: Callable[[float], DataFrame], rows: float, n: int) -> DataFrame:
    """The n rows with the smallest ``_h`` of a table of about ``rows`` rows, given those below a share of all hashes."""
    share = _wanted(n) / max(rows, 1.0)
    while True:
        found, path = written(near(share), "drawn")
        if share >= 1 or found.count() >= n:
            return found.orderBy("_h").limit(n)
        release(found.sparkSession, path)
        share *= RAISE


def _drawn(df: DataFrame, by: tuple[str, ...], n: int, seed: int, spelled: Column | None) -> DataFrame:
    spark = df.sparkSession
    row = F.to_json(F.struct(*df.columns)) if spelled is None else spelled
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))

    def hashed(bounded: DataFrame) -> DataFrame:
        copies = _copies(bounded.withColumn("_row", row))
        h = hash_text(F.concat_ws(":", F.lit(str(seed)), "_copy", "_row"))
        return copies.withColumn("_h", h).where(place(F.col("_h")) < F.col("_share")).select(*df.columns, "_h")

    if not by:
        return _least(lambda share: hashed(counted.withColumn("_share", F.lit(share))), df.count(), n).drop("_h")
    sizes = materialise(df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    wanted = _wanted(n)
    while True:
        bounds = sizes.withColumn("_share", F.lit(wanted) / F.col("_rows"))
        near, path = written(hashed(counted.join(bounds, same)), "drawn")
        found = near.groupBy(*by).agg(F.count(F.lit(1)).alias("_found"))
        short = (F.coalesce("_found", F.lit(0)) < F.least(F.lit(n), "_rows")) & (F.col("_rows") > wanted)
        if sizes.join(found, same, "left").where(short).limit(1).count() == 0:
            break
        release(spark, path)
        wanted *= RAISE
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))  # sees some n rows of a group
    return near.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_h", "_rank")


def _copies(counted: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1. A row with very many copies is dealt to several tasks in ranges of numbers."""
    each = counted.withColumn("_first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"), F.lit(COPIES).cast("bigint"))))
    many = F.col("_copies") > COPIES
    dealt = each.where(~many).unionByName(each.where(many).repartition("_row", "_first"))
    last = F.least(F.col("_first") + (COPIES - 1), F.col("_copies"))
    return dealt.withColumn("_copy", F.explode(F.sequence(F.col("_first"), last)))
