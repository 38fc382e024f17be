"""Base spans against Python's patterns; disclosing terms on a planted corpus."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import product

import regex
from pyspark.sql import functions as F

from shoptrace.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def spans(text):
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) < 256 for x in m[0].split(".")),
                    "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]
            if good():
                yield f"{kind}:{m.start()}:{m.end()}"


def test_base_spans_equal_python(make_docs):
    r = random.Random(2)
    rows = ["".join(r.choice("ab1234567890@@..+- ()_\né😀") for _ in range(r.randint(0, 200))) for _ in range(150)]
    rows += ["a@b.c_d@e.f x@y@z.w", "1.2.3.4.5.6.7.8 1.2..3.4.5.6 300.1.1.1 001.02.3.255", "4111 1111-1111 1111 é4111111111111111",
             "+1 (234) 567-89.01- +12345678", "", None, "a" * 20_000, "1 " * 9_000, "a@" + "b." * 5_000 + "c"]
    for row in pii.find_spans(make_docs(rows)).collect():
        mine = list(spans(rows[row.doc_id] or ""))
        assert row.base_sha256 == hashlib.sha256(",".join(mine).encode()).hexdigest(), rows[row.doc_id]
        assert row.spans.startswith(",".join(mine))
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in mine) for k, _ in PATTERNS]


def planted():
    r = random.Random(1)
    common = ["north", "south", "river", "stone", "winter", "garden", "window", "market"]
    line = lambda: " ".join(r.choice(common) for _ in range(12))
    rows = [line() for _ in range(200)]
    rows += [f"{line()} Zorblat wrote to kim@mail.example {line()}" for _ in range(4)]
    return rows


def test_terms_that_give_an_entity_away(make_docs):
    rows = planted()
    found = {r.doc_id: r for r in pii.find_spans(make_docs(rows)).collect()}
    assert all(found[i].n_terms == 0 for i in range(200))
    for i in range(200, 204):
        at = rows[i].index("Zorblat")
        assert f"remove:{at}:{at + 7}" in found[i].spans
    clean = {r.doc_id: r for r in pii.sanitise(make_docs(rows)).collect()}
    for i in range(200, 204):
        assert "Zorblat" not in clean[i].text and "[EMAIL]" in clean[i].text and clean[i].n_chars == len(clean[i].text)
    assert all(clean[i].text == rows[i] for i in range(200))


def test_copies_are_no_evidence(make_docs):
    text = planted()[-1]
    assert all(r.n_terms == 0 for r in pii.find_spans(make_docs([text] * 6 + planted()[:150])).collect())


def test_edge_rows(make_docs):
    docs = make_docs([(1, "x a@b.cc"), (1, "x a@b.cc"), (None, "a@b.cc"), (2, None)])
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.find_spans(docs).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0)]
    assert sorted((r.doc_id or 0, r.text or "") for r in pii.sanitise(docs).collect()) == [(0, "[EMAIL]"), (1, "x [EMAIL]"), (1, "x [EMAIL]"), (2, "")]
    assert pii.find_spans(make_docs([]).limit(0)).count() == 0
    overlap = pii.sanitise(make_docs(["call +4111 1111 1111 111 now"])).collect()[0].text
    assert "1111" not in overlap


def plain_lines(text):
    return [x for x in (text or "").split("\n") if x.strip(" ")]


def plain_terms(line):
    """Different runs of letters, marks and digits outside the base spans."""
    spans_ = sorted(tuple(map(int, s.split(":")[1:])) for s in spans(line))
    for start, end in reversed(spans_):
        line = line[:start] + " " * (end - start) + line[end:]
    return set(regex.findall(r"[\p{L}\p{M}\p{N}]+", line.lower()))


def disclosing(rows):
    """(entity value, term) -> action, from counts of lines."""
    every = [x for t in rows for x in plain_lines(t)]
    terms, entities, joint, contexts = Counter(), Counter(), Counter(), {}
    for line in every:
        terms.update(plain_terms(line))
        held = {line[int(a) : int(b)].lower() for _, a, b in (s.split(":") for s in spans(line))}
        entities.update(held)
        for pair in product(held, plain_terms(line)):
            joint[pair] += 1
            contexts.setdefault(pair, set()).add(line)
    out = {}
    for (e, t), n in joint.items():
        if len(contexts[(e, t)]) >= pii.SUPPORT:
            d = math.log2(n * len(every) / (entities[e] * terms[t])) / math.log2(len(every) / entities[e])
            if d >= pii.GENERALISE:
                out[(e, t)] = "remove" if d >= pii.REMOVE else "generalise"
    return out


def test_disclosure_equals_counts_by_hand(make_docs):
    r = random.Random(6)
    names = {"kim@x.org": ["Kim", "Lee", "90210", "李"], "bob@y.net": ["Bob", "unique0", "B2B"], "10.1.2.3": ["router", "é"]}
    rows = []
    for i in range(120):
        entity, own = r.choice(list(names.items()))
        line = [r.choice(own) if r.random() < 0.8 else "the", "mail", entity if r.random() < 0.8 else "nobody", r.choice(["the", "a", "x1"]), str(r.randint(0, 9))]
        rows.append(" ".join(line) + ("\nplain line the a " + str(i) if i % 2 else ""))
    rows += ["some other line of the text", "Bob and Kim", "Leeway 902101"]
    want = disclosing(rows)
    assert {"90210", "kim", "b2b"} <= {t for _, t in want} and set(want.values()) == {"generalise", "remove"}
    found = {x.doc_id: x.spans for x in pii.find_spans(make_docs(rows)).collect()}
    for i, text in enumerate(rows):
        flagged = {t for x in plain_lines(text) for t in plain_terms(x) for e in {x[int(a) : int(b)].lower() for _, a, b in (s.split(":") for s in spans(x))} if (e, t) in want}
        got = {text[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in found[i].split(",") if s) if k in ("remove", "generalise")}
        assert got == flagged, text


def test_short_terms_and_digits_are_judged_as_whole_runs(make_docs):
    rows = [f"Kim Lee 90210 mail kim@x.org unique{i}" for i in range(10)] + [f"other line number {i} of a longer text" for i in range(200)]
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows)).collect()}
    assert all(not {"Kim", "Lee", "90210"} & set(clean[i].split()) and f"unique{i}" in clean[i] for i in range(10))
    assert all(clean[i] == rows[i] for i in range(10, 210))


def test_long_lines_are_cut_so_pairs_stay_few(make_docs, spark):
    rows = [" ".join(f"u{i}@mail.example" for i in range(600)), "z" * 50_000 + " a@b.cc", "word " * 100_000 + "a@b.cc"]
    docs = make_docs(rows)
    marked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", pii.base_spans(F.col("text")).alias("base"))
    _, places = pii.disclosures(docs.select("doc_id", "text"), marked)
    assert places.count() < 40_000  # 360,000 pairs in the first line alone
    assert all(r.n_email in (600, 1) for r in pii.find_spans(docs).collect())
