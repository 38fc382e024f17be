"""Near-duplicate documents by one-permutation MinHash.

One hash of each five-word shingle fills all bins of a signature: its leading bits choose the bin, the least value stays.
Empty bins borrow from a bin that a universal hash of (bin, attempt) chooses, the same for every document (optimal
densification). Bands of bins key buckets. Candidate pairs are stars: in each bucket one centre meets the other members,
never all pairs, and a pair is met only in the least bucket that holds both of its nodes, so once in all rounds. Each pair is
confirmed on the full shingle sets. A bucket whose members still lie in different components
after a round gives up its centres and goes into the next round with new ones, so no link that a bucket shows is lost. Most
buckets end after one round because their members are connected, or because a member has too many shingles of its own to be
linked with anything; this bound is exact and keeps large families of loosely similar texts from being compared pair by pair.

With ``BANDS`` bands of ``ROWS`` bins, a pair of similarity 0.85 shares no bucket with a probability below 1e-8.

Defined results: a NULL, empty or blank text has no shingles, is its own component and kept. Equal sets (exact copies and
repeated rows) are one node. Rows that share a doc_id are versions of one document and share a component. A row without a
doc_id is linked only with rows of the same set; without such a row its component is NULL and it is kept. An empty table
gives an empty result; extra columns are ignored by ``near_duplicates`` and passed through by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.llm.graph import components
from shoptrace.llm.shared import U, blocks, distinct_per_document, id_and_text, mix, shingle_hashes
from shoptrace.sources.tables import materialise

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 85
BINS = 256
ROWS = 6
BANDS = 42

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def signatures(value: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """One-permutation signature of each document; ``value`` is sorted within each document, so a bin's first is its least."""
    bins = (value >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    cell = owner * BINS + bins
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out, full = np.zeros(docs * BINS, U), np.zeros(docs * BINS, bool)
    out[cell[first]] = value[first]
    full[cell[first]] = True
    has = np.zeros(docs, bool)
    has[owner] = True
    empty = np.flatnonzero(~full & np.repeat(has, BINS))
    attempt = 0
    while len(empty):
        attempt += 1
        lender = (mix((empty % BINS).astype(U) * U(0x9E3779B97F4A7C15) + U(attempt)) % U(BINS)).astype(np.int64)
        place = empty - empty % BINS + lender
        found = full[place]
        out[empty[found]] = out[place[found]]
        empty = empty[~found]
    return out.reshape(docs, BINS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.tile(_SEEDS, (len(signature), 1))
    for k in range(ROWS):
        key = mix(key * U(0xD1342543DE82EF95) + parts[:, :, k])
    return key.view(np.int64)


def _sketch(batches):
    for batch in batches:
        for first, last, data, at in blocks(batch.column("text")):
            docs = last - first
            value, owner = distinct_per_document(*shingle_hashes(data, at, SHINGLE_WORDS))
            count = np.bincount(owner, minlength=docs)
            sums = []
            for seed in (0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB):
                total = np.zeros(docs, U)
                if len(value):
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    total[owner[starts]] = np.add.reduceat(mix(value ^ U(seed)), starts)
                sums.append(mix(total + U(seed)).view(np.int64))
            keys = band_keys(signatures(value, owner, docs))
            flat = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))]), pa.int32()),
                pa.array(keys[count > 0].ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[first:last], pa.array(count), pa.array(sums[0]), pa.array(sums[1]), flat],
                names=["doc_id", "n_shingles", "set1", "set2", "bands"],
            )


def _shingle_sets(batches):
    for batch in batches:
        for first, last, data, at in blocks(batch.column("text")):
            value, owner = distinct_per_document(*shingle_hashes(data, at, SHINGLE_WORDS))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=last - first))])
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node")[first:last], sets], names=["node", "shingles"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return both.select("a", "b", shared.alias("shared"), union.alias("union")).filter(
        100 * F.col("shared") >= SIMILAR_PERCENT * F.col("union")
    )


def star_pairs(buckets: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs (a, b): each centre of a bucket with every later member of another component that could be linked.

    ``able`` counts a node's shingles that any other candidate has at all; no pair shares more than the lesser of two such
    counts, which bounds its similarity. ``mine`` holds all buckets of a node (``BANDS`` at most): only the least common one
    gives the pair. A bucket leaves the rounds only when its members are connected or cannot be linked, so the pair's turn
    in that bucket comes unless it is not needed.
    """
    c = centres.select("bucket", *(F.col(x).alias(f"{x}_a") for x in ("node", "n_shingles", "able", "component", "mine")))
    m = buckets.alias("m")
    shared = F.least("m.able", "able_a")
    possible = 100 * shared >= SIMILAR_PERCENT * (F.col("m.n_shingles") + F.col("n_shingles_a") - shared)
    apart = (F.col("node_a") < F.col("m.node")) & (F.col("component_a") != F.col("m.component"))
    least = F.col("m.bucket") == F.array_min(F.array_intersect("m.mine", "mine_a"))
    pairs = m.join(c.alias("c"), (F.col("m.bucket") == F.col("c.bucket")) & apart & possible & least)
    return pairs.select(F.col("node_a").alias("a"), F.col("m.node").alias("b"))


def unresolved(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    split = buckets.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return buckets.join(split.filter("low < high").select("bucket"), "bucket")


def linkable(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """``buckets`` with ``able`` counted anew among the nodes still in it, without nodes that cannot reach any other.

    A shingle that only one of these nodes has can be in no intersection.
    """
    inside = sets.join(buckets.select("node").distinct(), "node")
    each = inside.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle")
    able = each.join(common, "shingle").groupBy("node", "size").agg(F.count("*").alias("able"))
    enough = able.filter(100 * F.col("able") >= SIMILAR_PERCENT * F.col("size")).select("node", "able")
    return buckets.drop("able").join(materialise(enough, "able"), "node")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Components (node, component) under confirmed links; ``nodes(node, n_shingles, bands)``, ``texts(node, text)``.

    A round takes the least nodes of each unresolved bucket as centres: one at first, then sixteen times as many as before. Tables
    that ``unresolved`` reads twice are written first, so that each round computes them once.
    """
    members = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    shared = materialise(shared.select("bucket"), "shared")  # written, so that the join below can split hot buckets
    held = members.join(shared, "bucket").groupBy("node", "n_shingles").agg(F.collect_set("bucket").alias("mine"))
    columns = ["bucket", "node", "n_shingles", "able", "component", "mine"]
    buckets = held.withColumn("able", F.col("n_shingles")).withColumn("component", F.col("node"))
    buckets = materialise(buckets.withColumn("bucket", F.explode("mine")).select(columns), "buckets")
    # written, so that the join below knows its size before the texts are shuffled for it
    involved = materialise(buckets.select("node").distinct(), "involved")
    schema = "node long, shingles array<long>"
    sets = materialise(texts.join(involved, "node", "left_semi").mapInArrow(_shingle_sets, schema), "shingle_sets")
    found = labels = None
    width = 1
    while True:
        order = Window.partitionBy("bucket").orderBy("node")
        centres = buckets.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= width).drop("_place")
        pairs = materialise(star_pairs(buckets, centres), "star_pairs")
        new = materialise(confirmed(pairs, sets).select("a", "b"), "links")
        if labels is None or new.limit(1).count():
            found = new if found is None else found.union(new)
            labels = components(found)
        rest = buckets.drop("component").join(centres.select("bucket", "node"), ["bucket", "node"], "left_anti")
        rest = rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rest = materialise(rest.select(columns), "rest")
        rest = materialise(unresolved(rest).select(columns), "unresolved")
        rest = materialise(linkable(rest, sets).select(columns), "linkable")
        buckets = materialise(unresolved(rest).select(columns), "buckets")
        width *= 16
        if buckets.limit(1).count() == 0:
            return labels


def _different_texts(texts: DataFrame, sketched: DataFrame) -> DataFrame:
    """(node, text) without repeats, so that a pair of ids is compared once however often their rows repeat."""
    ids = sketched.groupBy(F.col("doc_id").alias("node")).agg(F.count("*").alias("n")).filter("n > 1 AND node IS NOT NULL")
    repeated = materialise(ids.select("node"), "repeated")
    again = texts.join(repeated, "node", "left_semi").dropDuplicates(["node", "text"])
    return texts.join(repeated, "node", "left_anti").unionByName(again)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    narrow = id_and_text(docs)
    schema = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"
    sketched = materialise(narrow.mapInArrow(_sketch, schema), "sketches")
    full = sketched.filter("n_shingles > 0")
    groups = materialise(
        full.groupBy("set1", "set2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles")), "set_groups"
    )
    named = groups.filter("node IS NOT NULL")
    first = full.select("set1", "set2", "bands", F.col("doc_id").alias("node"))
    nodes = first.join(named, ["set1", "set2", "node"]).select("node", "n_shingles", "bands")
    versions = full.filter("doc_id IS NOT NULL").join(named.select("set1", "set2", "node"), ["set1", "set2"])
    labels = links(nodes, _different_texts(narrow.select(F.col("doc_id").alias("node"), "text"), full))
    # a document's versions stand in one component even when their sets differ
    same = versions.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    ties = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same).filter("a <> b")
    final = components(ties)
    of_group = groups.select("set1", "set2", "node").join(final, "node", "left").select(
        "set1", "set2", F.coalesce("component", "node").alias("component_id")
    )
    joined = sketched.drop("bands").join(of_group, ["set1", "set2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group. Repeats of a kept row go too; rows without a doc_id stay."""
    verdict = materialise(near_duplicates(docs), "near_duplicates").filter("doc_id IS NOT NULL")
    dropped = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    left = docs.join(dropped, docs["doc_id"] == dropped["_id"], "left_anti")
    repeated = verdict.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id"))
    if repeated.limit(1).count() == 0:
        return left
    single = left.join(repeated, left["doc_id"] == repeated["_id"], "left_anti")
    return single.unionByName(left.join(repeated, left["doc_id"] == repeated["_id"], "left_semi").dropDuplicates(["doc_id", "text"]))
