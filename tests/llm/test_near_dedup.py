"""Near-duplicate groups against all pairs compared."""

from __future__ import annotations

import random
import tracemalloc
from functools import partial

import pyarrow as pa
import pytest

from shoptrace.llm import near_dedup, shared


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * len(sets[i] | sets[j]):
                    a, b = sorted((top(i), top(j)))
                    group[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def corpus(seed):
    r = random.Random(seed)

    def words(n):
        return ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n)]

    rows = [" ".join(words(r.randint(0, 120))) for _ in range(40)]
    base = words(150)
    for _ in range(60):  # a family of looser and closer copies, copies of copies among them
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            copy[r.randrange(len(copy))] = r.choice(["x", "yy", "zzz"]) + str(r.random())
        rows.append(" ".join(copy))
        if r.random() < 0.3:
            base = copy
    rows += [rows[50].upper(), rows[50] + "\n", "", None, " \t ", "a b", "A  B", "a b c", "x " * 300, "x " * 90, "one two three four five"]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(make_docs, seed):
    rows = corpus(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(make_docs(rows)).collect()}
    assert found == brute(rows)


def test_edge_rows(make_docs):
    rows = near_dedup.near_duplicates(make_docs([(1, "a b c"), (1, "a b c"), (None, "A b c"), (None, "z"), (None, None), (3, "q r")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (3, 3, True),
    ]
    assert near_dedup.near_duplicates(make_docs([]).limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(make_docs):
    docs = make_docs([(1, "a b c d e f"), (2, "A b c d e f"), (1, "a b c d e f"), (4, ""), (5, None)])
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]


def test_repeated_rows_are_compared_once(make_docs, monkeypatch):
    """A thousand rows each of two near texts are one pair."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    one = [r.choice(words) for _ in range(200)]
    other = one[:190] + ["changed"] + one[191:]
    rows = [(1, " ".join(one))] * 1000 + [(2, " ".join(other))] * 1000 + [(3, " ".join(r.choice(words) for _ in range(200)))]
    counted, confirm = [], near_dedup.confirmed

    def seen(pairs, sets):
        counted.append((pairs.join(sets.withColumnRenamed("node", "b"), "b").count(), sets.count()))
        return confirm(pairs, sets)

    monkeypatch.setattr(near_dedup, "confirmed", seen)
    found = {(x.doc_id, x.component_id) for x in near_dedup.near_duplicates(make_docs(rows)).collect()}
    assert found == {(1, 1), (2, 1), (3, 3)}
    assert all(joined <= 2 and sets <= 3 for joined, sets in counted) and counted
    assert near_dedup.deduplicate(make_docs(rows)).count() == 2


def test_sketches_take_little_memory_and_ignore_the_block_size(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(str(r.randrange(9999)) for _ in range(400)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(shared, "_powers", {})
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in near_dedup._sketch([batch])) == 3000
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    whole = pa.Table.from_batches(near_dedup._sketch([batch])).combine_chunks()
    monkeypatch.setattr(near_dedup, "blocks", partial(shared.blocks, limit=1 << 14))
    assert pa.Table.from_batches(near_dedup._sketch([batch])).combine_chunks().equals(whole)
