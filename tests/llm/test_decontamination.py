"""Benchmark decontamination against a word-by-word search."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shoptrace.llm import decontamination as dc

BENCHMARK = "item_id long, text string, items string"


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "x") for i, t in rows], BENCHMARK)


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def searched(text, items, length=10, coverage=1.0):
    """(n_words, hit word numbers, item names) by comparing every run of an item with every place."""
    have, hit, names = words(text), set(), set()
    for item, t in items:
        own = words(t)
        if not own:
            continue
        n = min(length, math.ceil(len(own) * coverage))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(have) - n + 1):
            if tuple(have[i : i + n]) in runs:
                hit |= set(range(i, i + n))
                names.add("" if item is None else str(item))
    return len(have), hit, names


def made_up(seed, n_items=25, n_docs=60, vocabulary=6):
    r = random.Random(seed)
    letters = ["a", "B", "été", "x9", "中文", "the", "of", "Zz"][:vocabulary]
    say = lambda n: "".join(r.choice(letters) + r.choice([" ", ", ", "\n", "_", "\u0000"]) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 5, 9, 10, 11, 14, 30]))) for i in range(n_items) if i != 4] + [(4, None), (5, "..."), (None, say(12)), (7, say(13))]
    docs = [say(r.randint(0, 80)) for _ in range(n_docs)]
    docs += [say(5) + items[k][1] + say(5) for k in (6, 8, 9)] + [None, "", " .\n", "_" * 50] + docs[:2]
    return items, docs


@pytest.mark.parametrize("seed, length, coverage, block", [(1, 10, 1.0, 10**6), (2, 10, 1.0, 60), (3, 4, 0.5, 10**6), (4, 6, 0.34, 40)])
def test_report_equals_a_search_word_by_word(make_docs, make_items, seed, length, coverage, block):
    items, docs = made_up(seed)
    settings = {"length": length, "coverage": coverage, "block_words": block}
    got = {}
    for r in dc.contamination_report(make_docs(docs), make_items(items), **settings).collect():
        got[r.doc_id] = tuple(r)[1:]
    for i, text in enumerate(docs):
        n, hit, names = searched(text, items, length, coverage)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert got[i] == (n, len(hit), len(names), sha, bool(hit)), text
    assert len(got) == len(docs)


def test_spans_are_words_and_bytes_and_longest_is_the_longest(make_docs, make_items):
    items = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "été, HIVER!")]
    text = "Ça. " + "ONE two, three four five six seven eight nine ten eleven" + " été;;hiver et twelve. " + "six seven eight"
    (r,) = dc.find(make_docs([text]), make_items(items)).collect()
    raw = text.encode()
    assert [raw[s.first_byte : s.end_byte].decode() for s in r.spans] == ["ONE two, three four five six seven eight nine ten eleven été;;hiver"]
    assert [(s.first_word, s.end_word) for s in r.spans] == [(1, 14)]
    assert r.longest == 11 and r.n_hit == 13 and r["items"] == ["1", "2"]


def test_removal_cuts_spans_and_drops_documents_that_are_mostly_found(make_docs, make_items, spark):
    item = "one two three four five six seven eight nine ten"
    long = "Start é " + item + ", and then a lot of other words follow here, really"
    docs = spark.createDataFrame(
        [(1, long, 5, "r", "s"), (2, item + " end", 6, "r", "s"), (3, None, 7, "r", None), (4, "clean Text.", 8, None, "s"), (None, "", 9, "r", "s")],
        "doc_id long, text string, row int, spans string, _text string",
    )
    got = dc.remove(docs, make_items([(1, item)]))
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == {1, 3, 4, None}
    assert rows[1].text == "Start é  , and then a lot of other words follow here, really" and rows[1].row == 5
    assert rows[3].text is None and rows[4].text == "clean Text." and rows[4].spans is None and rows[None].text == ""


def test_empty_tables(make_docs, make_items):
    clean = dc.contamination_report(make_docs(["one two", None]), make_items([])).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in sorted(clean, key=lambda r: r.doc_id)] == [(2, 0, False), (0, 0, False)]
    assert dc.contamination_report(make_docs([]).limit(0), make_items([(1, "a b")])).count() == 0
    with pytest.raises(ValueError):
        dc.item_pieces(make_items([]), length=0)


def test_long_items_lose_no_run(make_docs, make_items):
    r = random.Random(3)
    item = [f"w{r.randint(0, 10**6)}" for _ in range(10_000)]
    at = [0, 4_080, 4_087, 4_090, 8_174, 9_990]
    docs = [" ".join(["x", *item[i : i + 10], "y"]) for i in at] + [" ".join(item[5:14]), " ".join(item)]
    got = {x.doc_id: (x.n_hit, x.longest) for x in dc.find(make_docs(docs), make_items([(1, " ".join(item))])).collect()}
    assert [got[i][0] for i in range(len(docs))] == [10] * len(at) + [0, 10_000]


def streamed(text, automaton, size):
    data = np.frombuffer(text.encode(), np.uint8)
    reader = dc.Reader(automaton)
    for offset, part in dc.segments(data, size):
        dc.read_block(part, np.array([0, len(part)]), automaton, [reader], offset, cut=True)
    return reader


@pytest.mark.parametrize("size", [1, 7, 16, 64])
def test_segments_of_a_long_text_change_nothing(size):
    items, docs = made_up(11, n_items=30)
    pieces = [(str(i), min(10, len(words(t))), [w.encode() for w in words(t)]) for i, t in items if words(t)]
    automaton = dc.Automaton(pieces)
    for text in [d for d in docs if d] + [" ".join(items[0][1] + " " + t for _, t in items if t)]:
        (_, _, (whole,)), = dc.matches(pa.array([text]), automaton)
        cut = streamed(text, automaton, size)
        assert (cut.n_words, cut.spans, cut.items(), cut.longest) == (whole.n_words, whole.spans, whole.items(), whole.longest)


def test_very_long_texts(make_docs, make_items):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = ["a" * 9_000_000 + " " + item, " " * 5_000_000 + item, (item + " ") * 100_000, "0" * 5_000_000, ". " * 2_500_000]
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.spans)) for r in dc.find(make_docs(docs), make_items([(1, item)])).collect()}
    assert got == {0: (11, 10, 1), 1: (10, 10, 1), 2: (1_000_000, 1_000_000, 1), 3: (1, 0, 0), 4: (0, 0, 0)}
