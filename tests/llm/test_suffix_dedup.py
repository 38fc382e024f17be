"""Repeated 200-byte strings against a brute-force count of every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from shoptrace.llm.suffix_dedup import SAMPLE, SPAN_SCHEMA, WIDTH, bands, refined, repeated_strings


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(5)

    def words(n):
        return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))

    passage, line = words(90), words(12)
    rows = [words(r.randint(1, 150)) for _ in range(20)]
    rows += [words(r.randint(0, 60)) + passage + words(r.randint(0, 60)) for _ in range(12)]
    rows += [words(40) + passage[r.randint(0, 60) : r.randint(250, 400)] + words(40) for _ in range(12)]
    rows += [words(30) + line + words(30) + line for _ in range(8)]
    rows += [rows[0], rows[0], rows[25], "ab " * 200, "De " * 90, "x" * 199, "x" * 200, "x" * 201, "", None, words(3000), passage[:200], passage[1:200]]
    return rows


@pytest.mark.parametrize("class_spans", [20_000, 3, 1], ids=["at once", "recurring", "to single windows"])
def test_equals_brute_force(make_docs, class_spans):
    rows = texts()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(make_docs(rows), class_spans).collect()}
    assert [found[i] for i in range(len(rows))] == brute(rows)


def test_repeated_rows_nulls_and_empty_tables(make_docs):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(315))
    rows = repeated_strings(make_docs([(1, long), (1, long), (None, "a"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (0, 0), (1, 315), (1, 315)]
    assert repeated_strings(make_docs([]).limit(0)).count() == 0
    other = make_docs([(1, long), (1, long[::-1]), (2, "x" + long)])
    assert sorted(r.n_removed for r in repeated_strings(other).collect()) == [0, 315, 315]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_key_are_told_apart_by_the_whole_hash(make_docs, doc_id):
    r = random.Random(11)
    passage, own, other = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (260, 700, 300))

    def low(text):
        return xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFF

    first = "1" + passage + other
    second = next(t for t in (f"{own}{i}" for i in range(2_000_000)) if low(t) == low(first))  # the same last 16 bits
    found = repeated_strings(make_docs([(doc_id, first), (doc_id, second), (8, passage)])).collect()
    assert sorted((x.n_bytes, x.n_removed, x.kept_sha256) for x in found) == sorted(
        (n, gone, sha) for n, gone, _, sha in brute([first, second, passage])
    )


def test_a_passage_that_all_share_recurs(make_docs):
    """Its edges are classes with as many spans as documents; some tails agree for a while."""
    r = random.Random(13)

    def letters(n):
        return "".join(r.choice("abcdefgh ") for _ in range(n))

    passage, tails = letters(320), [letters(120) for _ in range(6)]
    rows = [letters(r.randint(0, 90)) + passage + r.choice(tails)[: r.randint(0, 120)] + letters(r.randint(0, 90)) for _ in range(150)]
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeated_strings(make_docs(rows), 10).collect()}
    assert [found[i] for i in range(len(rows))] == brute(rows)


@pytest.mark.parametrize("bits", [6, 4, 2, 0])
def test_bands_hold_every_window_once_and_equal_windows_meet(bits):
    r = random.Random(17)
    shared = bytes(r.randrange(256) for _ in range(2 * WIDTH))
    top = WIDTH - SAMPLE
    spans = []
    for _ in range(12):  # a span from `most` to `least` bytes before the sample at 200
        most = r.randint(0, top)
        least = r.randint(0, most)
        whole = bytearray(shared)
        whole[r.randrange(0, 400)] ^= 1
        spans.append((most, least, bytes(whole[200 : 400 - least]), bytes(whole[200 - most : 200][::-1])))
    classes = {}
    for k, (most, least, behind, before) in enumerate(spans):
        met = []
        for name, _, place, right, left in bands(5, 1000, most, least, behind, before, bits):
            far, near = place >> 8 & 255, place & 255
            assert (place >> 16, len(right), len(left)) == (1000, WIDTH - near, far)
            for d in range(near, far + 1):
                met.append(d)
                classes.setdefault((d, left[:d][::-1] + right[: WIDTH - d]), set()).add(name)
        assert sorted(met) == list(range(least, most + 1)), k
    assert all(len(names) == 1 for names in classes.values())


def test_no_class_of_the_queue_is_too_large(spark):
    r = random.Random(19)
    common = bytes(r.randrange(256) for _ in range(SAMPLE + 60))
    rows = []
    for i in range(200):
        behind = (common + bytes(r.randrange(2) for _ in range(WIDTH)))[:WIDTH]
        rows.append((1, i, 0, 1000 << 16 | 150 << 8, bytearray(behind), bytearray(150)))
    small, _ = refined(spark.createDataFrame(rows, SPAN_SCHEMA), 20)
    sizes = Counter(x.sample for table in small for x in table.collect())
    assert sizes and max(sizes.values()) <= 20
