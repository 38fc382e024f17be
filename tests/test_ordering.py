from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoptrace.operators import ordering
from shoptrace.operators.ordering import (
    first_rows,
    global_positions,
    hash_text,
    histogram,
    quantile,
    value_counts,
    with_cumulative,
    with_ntiles,
)
from shoptrace.operators import sampling
from shoptrace.operators.sampling import sample_by_key, sample_groups, sample_n, sample_per_group
from shoptrace.sources.tables import materialise


def plain_ntile(values, k):
    """Tile per position of an ordered list."""
    n = len(values)
    size, extra = divmod(n, k)
    out = []
    for tile in range(1, k + 1):
        out += [tile] * (size + (tile <= extra))
    return out[:n]


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 10, 1498, 6003])
def test_ntiles(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 % 100003, rng.choice([1, 1, 1, 2, 3]), round(rng.uniform(-5, 50), 2)) for i in range(n)]
    users = materialise(spark.createDataFrame(rows, "user bigint, often int, spend double").repartition(5))
    got = with_ntiles(users, {"often_tile": F.col("often"), "spend_tile": F.col("spend")}, "user", 5).collect()
    assert len(got) == n
    for name, key in (("often_tile", "often"), ("spend_tile", "spend")):
        ordered = sorted(got, key=lambda r: (r[key], r["user"]))
        assert [r[name] for r in ordered] == plain_ntile(ordered, 5)


def test_positions_with_one_hot_key(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"), F.col("id").alias("user")
    )
    got = global_positions(rows, [F.col("key"), F.col("user")]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(30_000))
    pairs = [(r["key"], r["user"]) for r in got]
    assert pairs == sorted(pairs)


def test_positions_do_not_meet_in_one_task(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("key"), F.col("id").alias("user"))
    spread = rows.repartitionByRange(4, "key", "user").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 20_000


def test_first_rows(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(500)], "user int, spend int")
    expected = sorted(((i % 7, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    for k in (0, 1, 123, 500, 600):
        got = [(r["spend"], r["user"]) for r in first_rows(rows, -F.col("spend"), "user", k).collect()]
        assert got == expected[:k]


@pytest.mark.parametrize("settled, subranges", [(1, 2), (1, 7), (3, 64), (10**6, 64)])
def test_rows_at_ranks_by_ever_finer_ranges(spark, monkeypatch, settled, subranges):
    """Ranges that are cut in two, hot keys, copies of rows, keys that doubles cannot tell apart, far ends of both types."""
    monkeypatch.setattr(ordering, "SETTLED", settled)
    monkeypatch.setattr(ordering, "SUBRANGES", subranges)
    rng = random.Random(settled * subranges)
    whole = [-(2**62), 2**62, *[2**53 + i for i in range(6)], *[5] * 40, -1, 0, 1]
    parts = [-1e300, 1e300, 1e-300, 0.1, 0.2, 0.30000000000000004, *[7.25] * 30]
    rows = [(rng.choice(whole), rng.choice(parts), i * 10**9) for i in range(90)] + [(5, 7.25, 3)] * 4
    df = materialise(spark.createDataFrame(rows, "k long, v double, id long").repartition(3))
    wanted = [0, 1, 20, 46, 47, 60, len(rows) - 1]
    found = ordering.rows_at_ranks(df, {"k": F.col("k"), "v": F.col("v")}, "id", {"k": wanted, "v": wanted})
    by_k, by_v = sorted((k, i) for k, _, i in rows), sorted((v, i) for _, v, i in rows)
    assert found == {"k": [by_k[r] for r in wanted], "v": [by_v[r] for r in wanted]}


def test_ranks_need_numbers_without_nulls(spark):
    text = spark.createDataFrame([("a", 1)], "k string, id int")
    with pytest.raises(TypeError):
        ordering.rows_at_ranks(text, {"k": F.col("k")}, "id", {"k": [0]})
    holes = spark.createDataFrame([(1, 1), (None, 2), (3, 3)], "k int, id int")
    with pytest.raises(Exception, match="not NULL"):
        ordering.rows_at_ranks(holes, {"k": F.col("k")}, "id", {"k": [0]})


def test_ntiles_neither_sort_nor_write_the_table(spark, monkeypatch):
    users = materialise(spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("k")))
    monkeypatch.setattr(ordering, "materialise", None)
    plan = with_ntiles(users, {"t": F.col("k")}, "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("n", [1, 2, 9, 1000])
def test_quantiles_match_linear_interpolation(spark, n):
    rng = random.Random(n)
    values = [round(rng.choice([5.0, 5.0, rng.uniform(-20, 2000)]), 2) for _ in range(n)]
    counts = materialise(value_counts(spark.createDataFrame([(v,) for v in values], "v double"), "v"))
    qs = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    row = with_cumulative(counts, "v", ["n"]).agg(*[quantile(q, "v").alias(f"q{i}") for i, q in enumerate(qs)]).first()
    assert list(row) == pytest.approx(list(np.quantile(values, qs)), rel=1e-12, abs=1e-12)


def test_cumulative_by_group(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", -3.0), ("b", 0.0), ("b", 900.5), ("b", 900.5)]
    counts = materialise(value_counts(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]))
    got = {(r["g"], r["v"]): (r["n_before"], r["n_total"]) for r in with_cumulative(counts, "v", ["n"], ["g"]).collect()}
    assert got == {
        ("a", 1.0): (0, 3), ("a", 2.0): (1, 3), ("b", -3.0): (0, 4), ("b", 0.0): (1, 4), ("b", 900.5): (2, 4),
    }


def test_blocks_are_monotone_and_bounded(spark):
    values = sorted([0.0, -0.01, 0.01, 1e-300, -1e308, 1e308, 1.0, 2.0, 2.01, -2.01, 999.99, 1000.0, 123456.78])
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    blocks = [r["b"] for r in frame.select("v", ordering.value_block("v").alias("b")).orderBy("v").collect()]
    assert blocks == sorted(blocks)
    assert max(abs(b) for b in blocks) <= 65_536


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 10.0], [3.0, 3.0], [float(i % 17) for i in range(200)]])
def test_histogram_matches_numpy(spark, values):
    counts = materialise(value_counts(spark.createDataFrame([(v,) for v in values], "v double"), "v"))
    got = histogram(counts, "v", 8).orderBy("bin").collect()
    heights, edges = np.histogram(values, bins=8)
    assert [r["n"] for r in got] == list(heights)
    assert [r["bin_start"] for r in got] + [got[-1]["bin_end"]] == pytest.approx(list(edges), abs=1e-6)


def test_sample_by_key_does_not_depend_on_layout(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("s"))
    one = {r["s"] for r in sample_by_key(rows.repartition(1), "s", 100, seed=3).collect()}
    other = {r["s"] for r in sample_by_key(rows.repartition(7), "s", 100, seed=3).collect()}
    assert len(one) == 100 and one == other
    assert one != {r["s"] for r in sample_by_key(rows, "s", 100, seed=4).collect()}


def test_sample_n_is_exact_and_keeps_copies_in_proportion(spark):
    # a third of the rows are copies of one row
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    got = [r["v"] for r in sample_n(rows, 3000, seed=11).collect()]
    assert len(got) == 3000
    assert 0.28 < got.count(-1) / 3000 < 0.39
    singles = [v for v in got if v != -1]
    assert len(set(singles)) == len(singles)


def test_sample_n_of_fewer_rows_is_everything(spark):
    assert sample_n(spark.range(10), 20).count() == 10


def test_ntiles_keep_whole_number_keys_apart(spark):
    """Doubles cannot tell these keys apart."""
    keys = [2**53 + i for i in range(10)]
    df = materialise(spark.createDataFrame([(10 - i, k) for i, k in enumerate(keys)], "id long, k long"))
    found = {r.k: r.t for r in with_ntiles(df, {"t": F.col("k"), "back": -F.col("k")}, "id", 5).collect()}
    assert [found[k] for k in keys] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_sample_does_not_depend_on_layout(spark):
    rows = [(i % 7, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b double")
    first, second = (sorted(map(tuple, sample_n(d, 60, 3).collect())) for d in (df.repartition(1), df.repartition(6, "b")))
    assert first == second and len(first) == 60


def drawn_by(rows, n, seed, spell):
    """The rows with the n least hashes, every copy numbered."""
    copies = {}
    for r in rows:
        copies.setdefault(r, []).append(len(copies.get(r, [])) + 1)
    hashed = [(hashlib.sha256(f"{seed}:{c}:{spell(r)}".encode()).hexdigest()[:16], r) for r, cs in copies.items() for c in cs]
    return [r for _, r in sorted(hashed, key=lambda x: x[0])[:n]]


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_samples_are_the_least_hashes(spark, monkeypatch, chunk):
    monkeypatch.setattr(sampling, "COPIES", chunk)
    rows = [(i % 3 if i % 2 else 9, i % 40) for i in range(3000)] + [(None, 1)] * 30 + [(None, 2), (8, 8)]
    df = spark.createDataFrame(rows, "g int, v int")
    spelled = F.concat_ws("|", F.coalesce(F.col("g").cast("string"), F.lit("-")), "v")
    spell = lambda r: f"{'-' if r[0] is None else r[0]}|{r[1]}"
    assert sorted((tuple(r) for r in sample_n(df, 200, 5, spelled).collect()), key=str) == sorted(drawn_by(rows, 200, 5, spell), key=str)
    for frame in (df, df.coalesce(1)):
        got = [tuple(r) for r in sample_per_group(frame, ["g"], 50, 5, spelled).collect()]
        for g in (0, 1, 2, 9, 8, None):
            own = [r for r in rows if r[0] == g]
            assert sorted((r for r in got if r[0] == g), key=str) == sorted(drawn_by(own, 50, 5, spell), key=str)
    with pytest.raises(ValueError):
        sample_per_group(df, [], 5)


def test_a_bound_that_is_too_low_is_raised(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_wanted", lambda n: n / 40)
    rows = spark.range(20_000).select((F.col("id") % 2000).cast("string").alias("s"), (F.col("id") % 5).alias("g"))
    assert sample_by_key(rows.select("s").distinct(), "s", 300).count() == 300
    assert sample_n(rows, 500).count() == 500
    counts = {r["g"]: r["count"] for r in sample_per_group(rows, ["g"], 300).groupBy("g").count().collect()}
    assert counts == dict.fromkeys(range(5), 300)


def test_groups_are_drawn_before_they_are_built(spark):
    rows = materialise(spark.range(30_000).select((F.col("id") % 4000).cast("string").alias("s"), F.col("id").alias("v")))
    build = lambda d: d.groupBy("s").agg(F.sum("v").alias("v"))
    early = sample_groups(rows, "s", 100, build, seed=2).collect()
    late = sample_by_key(build(rows), "s", 100, seed=2).collect()
    assert sorted(map(tuple, early)) == sorted(map(tuple, late)) and len(early) == 100
    assert sample_groups(rows, "s", 9999, build).count() == 4000 and sample_groups(rows.where("false"), "s", 5, build).count() == 0
