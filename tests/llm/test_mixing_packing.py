from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoptrace.llm import mixing, packing


def test_schedule(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 16)
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(300)] + [(7, "t7", "en", "big"), (None, None, None, None)]
    found = mixing.schedule(make_docs(rows), block_documents=4).collect()
    assert len(found) == len(rows)
    assert len({(r.slot, r.place) for r in found}) == len(rows)
    for source in ("big", "small", None):
        own = sorted((r.block, r.place) for r in found if r.source == source)
        assert own == [(i // 4, i % 4) for i in range(len(own))]
        slots = sorted({(r.block, r.slot) for r in found if r.source == source})
        assert slots == sorted(slots, key=lambda x: x[1])
    docs = make_docs(rows)
    mixed = mixing.interleave(docs, block_documents=4)
    place = {(r.doc_id, r.slot, r.place) for r in found}
    assert mixed.columns == docs.columns and mixed.count() == len(rows) and len(place) == len(rows)
    order = [r.doc_id for r in mixed.coalesce(1).collect()]
    slot = {r.doc_id: r.slot for r in found if r.doc_id != 7}
    kept = [slot[i] for i in order if i in slot]
    assert kept == sorted(kept)
    assert mixing.schedule(make_docs([]).limit(0)).count() == 0


def _mixed_as_scheduled(docs, **options):
    """(doc_id, source) in the order of ``interleave``, and by the slots of ``schedule``."""
    found = [(r.doc_id, r.source) for r in mixing.interleave(docs, **options).collect()]
    slots = sorted(mixing.schedule(docs, **options).collect(), key=lambda r: (r.slot, r.place))
    return found, [(r.doc_id, r.source) for r in slots]


def test_whole_rows_are_shuffled_once(spark, make_docs, monkeypatch):
    """Whatever size the tables beside them have: no join but the explicit broadcasts avoids a shuffle here."""
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 16)
    docs = make_docs([(i, f"t{i}", "en", f"s{i % 3}") for i in range(500)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        mixed = mixing.interleave(docs, block_documents=4)
        plan = mixed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [node for node in plan.split("\n\n") if node.lstrip().startswith("(") and " Exchange" in node.split("\n")[0]]
    assert sum("_doc#" in node for node in shuffles) == 1


@pytest.mark.parametrize("limit", [mixing.BROADCAST_INTERVALS, 0], ids=["broadcast", "joined"])
def test_mixed_order_is_the_schedule(make_docs, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_INTERVALS", limit)
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 64)
    r = random.Random(9)
    rows = [(i, f"t{i}", "en", r.choice(["a", "a", "a", "b", None, f"rare{i % 40}"])) for i in range(1500)]
    found, want = _mixed_as_scheduled(make_docs(rows), block_documents=4)
    assert found == want and len(found) == len(rows)


def test_copies_that_a_cut_divides(make_docs):
    """Repeated rows fill several parts of a source, of several sources, and of rows without doc_id, source or text."""
    rows = [(i, f"t{i}", "en", "ab"[i % 2]) for i in range(60)]
    rows += [(7, "copy", "en", "a")] * 150 + [(8, "copy", "en", "b")] * 31 + [(None, None, "en", None)] * 90 + [(9, "other", "en", None)] * 3
    docs = make_docs(rows)
    for block in (1, 4, 32, 1000):
        found, want = _mixed_as_scheduled(docs, block_documents=block)
        assert found == want and len(found) == len(rows)
    same = make_docs([(1, "one", "en", "a")] * 300)
    assert mixing.interleave(same, block_documents=1).exceptAll(same).count() == 0 and mixing.interleave(same, block_documents=1).count() == 300


def test_order_within_a_source_ignores_the_bucket_size(make_docs, monkeypatch):
    docs = make_docs([(i, f"t{i}", "en", "ab"[i % 2]) for i in range(400)])
    found = []
    for size in (20_000, 16):
        monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", size)
        found.append(sorted((r.doc_id, r.slot, r.place) for r in mixing.schedule(docs, block_documents=4).collect()))
    assert found[0] == found[1]


def _shrunk(used):
    return min(c for c in packing.CAPACITIES if c >= used)


def _opened_by_trial(rest, capacity):
    """Cost per token of a bin of ``capacity`` that takes the first of ``rest`` and whatever fits of the others in turn."""
    fill = 0
    for n in rest:
        fill += n if fill + n <= capacity else 0
    return packing.sequence_cost(_shrunk(fill)) / fill


def test_pack_is_best_fit():
    """The rule spelled out: least room that fits, else the capacity whose trial contents cost least per token; bins shrink at the end."""
    r = random.Random(6)
    for mean in (60, 500, 1500):
        lengths = sorted((min(4096, int(r.expovariate(1 / mean)) + 1) for _ in range(400)), reverse=True)
        bins: list[list[int]] = []  # capacity, used
        want = []
        for k, n in enumerate(lengths):
            fitting = [(c - u, i) for i, (c, u) in enumerate(bins) if c - u >= n]
            if fitting:
                i = min(fitting)[1]
            else:
                able = [c for c in packing.CAPACITIES if c >= n]
                bins.append([min(able, key=lambda c: (_opened_by_trial(lengths[k:], c), -c)), 0])
                i = len(bins) - 1
            want.append((i, bins[i][1]))
            bins[i][1] += n
        found = packing.pack(lengths)
        assert [(b, at) for b, at, _, _ in found] == want
        assert all(o == bins[b][0] and c == _shrunk(bins[b][1]) for b, _, o, c in found)


def _total(lengths, capacities=packing.CAPACITIES):
    return sum(packing.sequence_cost(c) for c in {b: c for b, _, _, c in packing.pack(lengths, capacities)}.values())


def _least_total(lengths):
    """The cheapest of all ways to deal ``lengths`` into bins."""
    best = [float("inf")]

    def deal(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(packing.sequence_cost(_shrunk(u)) for u in bins))
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= max(packing.CAPACITIES):
                deal(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        deal(k + 1, [*bins, lengths[k]])

    deal(0, [])
    return best[0]


def test_capacities_compete():
    """Small sets against all ways to pack them; and any one length packs worse alone where pieces leave gaps in it."""
    r = random.Random(12)
    found = least = 0.0
    for _ in range(120):
        lengths = sorted((r.randint(1, r.choice([300, 900, 2500, 4096])) for _ in range(r.randint(1, 7))), reverse=True)
        one, best = _total(lengths), _least_total(lengths)
        assert best <= one <= 1.6 * best
        found, least = found + one, least + best
    assert found < 1.08 * least
    for lengths in ([700] * 400, [1400] * 200 + [500] * 100, [3000] * 50 + [1023] * 90 + [400] * 70):
        joint = _total(lengths)
        assert all(joint <= _total(lengths, [c]) for c in packing.CAPACITIES if c >= lengths[0])
    assert {c for _, _, c, _ in packing.pack([3500, 1800, 950, 450])} >= {4096, 2048}


def test_every_token_is_packed_once(make_docs):
    rows = [(i, " w" * n) for i, n in enumerate([0, 1, 5, 511, 512, 513, 4096, 4097, 9000])] + [(3, " w" * 511), (None, " a b"), (20, None)]
    docs = make_docs(rows).withColumn("length", F.lit("other")).withColumn("kept one", F.col("doc_id"))
    with pytest.raises(ValueError, match="length"):
        packing.token_lengths(docs, ["length"])
    kept = packing.token_lengths(docs, ["kept one"]).collect()
    assert all(r["kept one"] == r.doc_id for r in kept) and len(kept) == len(rows)
    lengths = packing.token_lengths(docs)
    for group in (20_000, 2):
        found = packing.pack_documents(lengths, group_pieces=group).collect()
        assert sum(r.length for r in found) == sum(len((t or "").split()) for _, t in rows)
        bins: dict = {}
        for r in found:
            if r.bin is not None:
                bins.setdefault((r.bin, r.capacity), []).append((r.place, r.length))
        for (_, capacity), parts in bins.items():
            at = 0
            for place, length in sorted(parts):
                assert place == at
                at += length
            assert at <= capacity
        assert sorted((r.piece, r.start, r.length) for r in found if r.doc_id == 8) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 808)]
        assert sum(r.bin is None for r in found) == 2
    assert packing.pack_documents(packing.token_lengths(make_docs([]).limit(0))).count() == 0


def _order(fluid, segments):
    return [(s, b, t) for task in segments for sent in fluid.order(*task) for s, b, t in zip(*sent, strict=True)]


@pytest.mark.parametrize(
    "weights", [[0.5, 0.3, 0.15, 0.05], [1.0] * 20, [1 / (i + 1) for i in range(200)], [3.0, *[0.01] * 600]], ids=["four", "equal", "many", "rare"]
)
def test_deviation_from_the_given_weights_stays_under_one_block(weights):
    w = np.array(weights) / sum(weights)
    blocks = np.ceil(w * 6000).astype(np.int64) + 1
    fluid = mixing.Fluid(np.array(weights), blocks)
    order = _order(fluid, fluid.segments(500))
    assert [t for _, _, t in order] == list(range(int(blocks.sum())))
    sent = np.zeros(len(w), np.int64)
    for source, block, slot in order:
        assert block == sent[source]
        sent[source] += 1
        if slot < 6000:  # all sources have blocks left
            assert np.abs(sent - w * (slot + 1)).max() < 1 + 1e-6
    assert (sent == blocks).all()


def test_segments_give_what_one_run_gives():
    r = random.Random(3)
    for n in (1, 2, 7, 40):
        fluid = mixing.Fluid(np.array([r.random() + 0.05 for _ in range(n)]), np.array([r.randint(1, 3000) for _ in range(n)]))
        segments = fluid.segments(200)
        assert _order(fluid, segments) == _order(fluid, [(0, 0, fluid.total)])
        assert len(segments) > 1


def test_more_sources_than_a_period_has_slots(make_docs):
    rows = [(i, f"t{i}", "en", f"host{i % 1100}") for i in range(2300)] + [(None, None, None, None)]
    found = mixing.schedule(make_docs(rows), block_documents=1).collect()
    assert sorted(r.slot for r in found) == list(range(len(rows)))
    weights = {f"host{i}": 3.0 if i < 100 else 2.0 for i in range(1100)} | {None: 2.0}
    assert {r.source: round(r.share * 2302) for r in mixing.schedule(make_docs(rows), weights=weights).collect()} == weights


def test_packing_follows_the_mix(spark, make_docs, tmp_path, monkeypatch):
    """Equal weights for sources of unequal size: while both last, every group of sequences has as much of one as of the other."""
    monkeypatch.setattr(packing.pack_documents, "__defaults__", (packing.CAPACITIES, packing.sequence_cost, 200, ()))
    rows = [(i, "w " * (1 + i % 7), "en", "small" if i % 4 == 0 else "big") for i in range(2400)]
    docs = make_docs(rows)
    mixed = mixing.interleave(docs, weights={"big": 1.0, "small": 1.0}).cache()
    mixed.write.parquet(str(tmp_path / "mixed"))
    place = {r.doc_id: (r.slot, r.place) for r in mixing.schedule(docs, weights={"big": 1.0, "small": 1.0}).collect()}
    for given in (spark.read.parquet(str(tmp_path / "mixed")), mixed):
        found = dict(corpus_pipeline.STAGES)["packing"](spark, given, "").collect()
        assert sorted(r.doc_id for r in found) == list(range(2400))
        groups: dict = {}
        for r in found:
            groups.setdefault(r.bin >> 32, []).append(r.doc_id)
        assert list(groups) == list(range(12)) and all(len(g) == 200 for g in groups.values())
        for k in range(11):
            assert max(place[i] for i in groups[k]) < min(place[i] for i in groups[k + 1])
        for k in range(5):
            assert abs(sum(i % 4 == 0 for i in groups[k]) - 100) <= 32


@pytest.mark.parametrize("names", [["in_part", "in_file", "in_row"], ["_metadata"], ["position", "group", "piece", "length", "slot"]])
def test_packing_stage_with_clashing_columns(spark, make_docs, tmp_path, names):
    docs = make_docs([(i, f"text number {i} " * 30) for i in range(20)])
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    wide.coalesce(1).write.parquet(str(tmp_path / "wide"))
    docs.coalesce(1).write.parquet(str(tmp_path / "plain"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    packed = [sorted(map(str, corpus_pipeline.pack_sequences(spark, d, "").collect())) for d in (read("wide"), read("plain"))]
    assert packed[0] == packed[1] and len(packed[0]) == 20
    rows = corpus_pipeline.in_order(read("wide")).orderBy(*corpus_pipeline.ORDER).collect()
    assert [r.doc_id for r in rows] == list(range(20)) and {r.in_part for r in rows} == {0} and rows[0].in_file.endswith(".parquet")
    assert corpus_pipeline.pack_sequences(spark, wide, "").count() == 20  # not a written table
