"""Sharding, classifier, fingerprints, token counts, pipeline and registration."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoptrace.llm import fingerprints, near_dedup, quality_classifier, sharding, token_counts
from shoptrace.llm.queries import ORACLE, QUERIES


def shard_of(rows, limit):
    codes = {}
    for i, t in rows:
        hexes = hashlib.md5(str(i).encode()).hexdigest() + hashlib.md5((t or "").encode()).hexdigest()
        codes[(i, t)] = bin(int(hexes, 16))[2:].zfill(256)
    out = {}
    for row, code in codes.items():
        for depth in range(257):
            inside = [r for r in rows if codes[r][:depth] == code[:depth]]
            if sum(len((t or "").encode()) for _, t in inside) <= limit or len(set(inside)) == 1:
                out[row] = code[:depth]
                break
    return out


def test_shards_equal_bit_by_bit_splitting(make_docs):
    r = random.Random(8)
    rows = [(i, "é" * r.randint(0, 60)) for i in range(120)] + [(500, "x" * 400), (7, "other"), (8, None)]
    rows += [(600, "y" * 90 + str(k)) for k in range(6)]  # one hot key
    want = shard_of(rows, 150)
    found = sharding.assign(make_docs(rows), 150).collect()
    got = sorted((r.doc_id, r.n_bytes, r.shard) for r in found)
    assert got == sorted((i, len((t or "").encode()), s) for (i, t), s in want.items())
    assert {r.doc_id for r in found if not r.fits} == {500}
    assert sharding.assign(make_docs([]).limit(0)).count() == 0
    twice = sharding.assign(make_docs([(1, "z" * 99), (1, "z" * 99), (None, "q")]), 150).collect()
    assert len(twice) == 3 and sum(not r.fits for r in twice) == 2


def test_written_shards_hold_every_row_once(make_docs, tmp_path):
    """Rows of a hot or NULL doc_id lie in the shards of their own texts."""
    rows = [(doc_id, f"{i:04d}" * 10) for doc_id in (5, None) for i in range(40)] + [(i, "x" * 30) for i in range(10, 20)] + [(5, None), (5, "z" * 20), (5, "z" * 20)]
    docs = make_docs(rows)
    sharding.write_shards(docs, str(tmp_path / "shards"), 150)
    folders = sorted((tmp_path / "shards").glob("shard=*"))
    assert len(folders) > 20
    parts = [docs.sparkSession.read.schema(docs.schema).parquet(str(f)) for f in folders]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in whole.collect()), key=key) == sorted(rows, key=key)
    wanted = sorted(r.shard_bytes for r in sharding.assign(docs, 150).select("shard", "shard_bytes").distinct().collect())
    assert sorted(sum(len(r.text or "") for r in part.collect()) for part in parts) == wanted and max(wanted) <= 150


def test_classifier_on_held_out_documents(spark, make_docs):
    r = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(80)]
        low, toxic = r.random() < 0.3, r.random() < 0.2
        if low:
            words = [w + "%%%" if r.random() < 0.3 else w for w in words]
        if toxic:
            words[r.randrange(80)] = r.choice(["vile", "scum"])
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
        labels.append((i, int(not low), int(toxic)))
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    rows += [(None, None, None, None), (3, "", "en", "s1")]
    found = {x.doc_id: x for x in quality_classifier.classify(make_docs(rows[:-2]), known).collect()}
    held = [(i, q, t) for i, q, t in labels if i % 3 == 0]
    assert sum((found[i].p_low > 0.5) == (q == 0) for i, q, _ in held) / len(held) > 0.97
    assert sum((found[i].p_toxic > 0.5) == (t == 1) for i, _, t in held) / len(held) > 0.97
    assert quality_classifier.classify(make_docs(rows), known).count() == len(rows)
    none = quality_classifier.classify(make_docs(rows[:5]), known.limit(0)).collect()
    assert len(none) == 5 and all(x.kept for x in none)
    assert quality_classifier.classify(make_docs([]).limit(0), known).count() == 0


def test_sparse_sites_lean_on_their_parents(spark, make_docs):
    rows = [(i, "bad%% thing" if i % 10 < 8 else "fine thing", "en", "low") for i in range(100)]
    rows += [(100 + i, "fine thing", "en", "good") for i in range(100)] + [(300, "thing", "fr", "low"), (301, "thing", "fr", "good")]
    known = spark.createDataFrame([(i, int("%" not in t), 0) for i, t, *_ in rows[:200]], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in quality_classifier.classify(make_docs(rows), known).collect()}
    assert found[300].low_path > found[301].low_path


def test_fingerprints(make_docs):
    r = random.Random(7)
    rows = [(i, "\n".join("".join(r.choice("abc .😀") for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 30)))) for i in range(0, 120, 2)]
    rows += [(200, ""), (201, None), (202, "a. b\nc"), (203, "c\na. b"), (204, "x" * 50_000)]
    rows += [(205, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(900)))]
    rows += [(206, "".join("".join(chr(0x4E00 + r.randrange(3000)) for _ in range(r.randint(3, 30))) + "。" for _ in range(60)))]
    found = {x.doc_id: x for x in fingerprints.fingerprints(make_docs(rows)).collect()}
    assert len(found) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [found[i].fingerprint, found[i].edited_fingerprint] == fingerprints.fingerprint_texts([t, edited])
        a, b = fingerprints.parse(found[i].fingerprint), fingerprints.parse(found[i].edited_fingerprint)
        assert found[i].near_edited == fingerprints.likeness(a, b)[0]
    assert found[202].fingerprint == found[203].fingerprint and found[202].near_next == 1.0
    assert found[205].near_edited > 0.3 and found[206].near_edited > 0.3  # no stop, only full-width stops
    one = fingerprints.fingerprints(make_docs([(None, "abcd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    assert fingerprints.fingerprints(make_docs([(1, "a"), (1, "a"), (1, "b")])).count() == 3
    assert fingerprints.fingerprints(make_docs([]).limit(0)).count() == 0


def test_likeness_follows_shared_units():
    units = [f"sentence number {i}." for i in range(4000)]
    prints = fingerprints.Sums([units, units[:3000] + ["other"], units[:40], units[:30]])
    near = fingerprints.likeness(prints.rows(0, 3), prints.rows(1, 4))
    assert near[0] > 0.3 and near[1] < 0.2 and near[2] > 0.4
    moved = prints.rows(0, 1).changed(fingerprints.Sums([units[3000:]]), fingerprints.Sums([["other"]]))
    assert moved.strings() == prints.rows(1, 2).strings()


def test_likeness_estimates_the_share_of_equal_units():
    r = random.Random(11)
    for n in (3, 40, 700, 300_000):
        for share in (0.0, 0.5, 0.95, 1.0):
            both = int(n * share)
            a = [f"unit {r.random()}" for _ in range(n)]
            b = a[:both] + [f"other {r.random()}" for _ in range(n - both)]
            prints = fingerprints.Sums([a, b])
            found = fingerprints.likeness(prints.rows(0, 1), prints.rows(1, 2))[0]
            assert abs(found - both / (2 * n - both)) < 0.25 and (found == 1) == (share == 1)


def test_an_edit_changes_one_piece_of_a_text_without_stops():
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(5000))
    before, after = fingerprints.units(text), fingerprints.units(text[:2500] + "#" + text[2500:])
    assert "".join(before) == text and 60 < len(before) < 400
    assert len(set(after) - set(before)) <= 2
    shouting = "WORD!! " * 300
    assert len(fingerprints.units(shouting)) < 200
    steps = fingerprints.STEP
    try:
        fingerprints.STEP = 64
        assert fingerprints.units(text) == before
    finally:
        fingerprints.STEP = steps
    assert fingerprints.units("") == [] == fingerprints.units("\n" * 200)
    assert all(fingerprints.units("z" * n) for n in (1, 7, 8, 64, 65, 200_000))


def test_ranges_cut_a_hot_key(make_docs):
    bounds = fingerprints.range_bounds([-(2.0**63), -(2.0**63), 3.0, float(2**63)])
    assert bounds == sorted(bounds) and bounds[:3] == [(-(1 << 63), -(1 << 63)), (-(1 << 63), 0), (3, -(1 << 63))]
    assert bounds[-1][0] == (1 << 63) - 1
    rows = [(None, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(200)] + [(7, "same")] * 50
    docs = make_docs(rows)
    keys = [(r.doc_id, r.text) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy(F.asc_nulls_first("doc_id"), "h").collect()]
    want = []
    for (i, t), (_, after) in zip(keys, keys[1:] + keys[:1]):
        n = len(t) // 4
        want.append((i or -1, hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    got = fingerprints.fingerprints(docs)
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got.collect()) == sorted(want)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 300


def test_token_histogram(make_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_LENGTHS", 4)
    r = random.Random(2)
    texts = ["", None, "<|endoftext|>"] + ["word " * r.randint(0, 90) for _ in range(80)]
    encoder = token_counts.encoding(token_counts.vocabulary_folder(), token_counts.VOCABULARY)
    lengths = [len(encoder.encode_ordinary(t or "")) for t in texts]
    histogram = token_counts.length_histogram(make_docs(texts))
    for row in histogram.collect():
        at = [n for n in lengths if n >= row.n_tokens]
        assert (row.n_docs, row.docs_at_least, row.tokens_at_least) == (lengths.count(row.n_tokens), len(at), sum(at))
        assert row.docs_below == len(lengths) - len(at) and row.tokens_cut == sum(min(n, row.n_tokens) for n in lengths)
    for row in token_counts.truncated_totals(histogram, [0, 10, 1000]).collect():
        kept = sum(min(n, row.context_limit) for n in lengths)
        assert (row.n_docs, row.tokens_kept, row.tokens_lost) == (len(lengths), kept, sum(lengths) - kept)
        assert row.docs_cut == sum(n > row.context_limit for n in lengths)
    for row in token_counts.quantiles(histogram, [0.0, 0.5, 1.0]).collect():
        ranked = sorted(lengths)
        assert row.n_tokens == ranked[max(0, -(-int(row.share * len(ranked) * 100) // 100) - 1)]
    assert token_counts.length_histogram(make_docs([]).limit(0)).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, folder).cache()
        assert left.columns == columns and left.count() <= before.count(), name
        if name == "near_dedup":
            assert near_dedup.near_duplicates(left).filter("NOT kept").count() == 0
        if name == "mixing":
            assert left.count() == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, left, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    from checks.compare import connect, differences

    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(QUERIES[name](spark, folder).toPandas(), connect(folder).execute(ORACLE[name]).df()) is None


def test_extra_columns_do_not_matter(make_docs):
    names = ["key", "tag", "part", "node", "bands", "bin", "block", "slot", "_hash", "base", "n_words", "entry"]
    docs = make_docs([(i, f"text number {i} " * 30) for i in range(6)])
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    from shoptrace.llm import mixing, packing, pii, quality_rules, suffix_dedup

    for run in (sharding.assign, quality_rules.judge, near_dedup.near_duplicates, pii.find_spans, fingerprints.fingerprints,
                suffix_dedup.repeated_strings, token_counts.length_histogram, mixing.schedule, lambda d: packing.pack_documents(packing.token_lengths(d))):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(docs).collect()))
    for run in (quality_rules.filter_documents, near_dedup.deduplicate, pii.sanitise, mixing.interleave):
        assert run(wide).columns == wide.columns


def test_shards_beside_columns_of_their_name(make_docs, tmp_path):
    rows = [(i, "x" * 30) for i in range(40)]
    for names, limit in ((["shard"], 150), (["SHARD", "_shard", "code", "doc"], 150), ([], 10**9)):
        docs = make_docs(rows).select("*", *(F.lit(f"v{i}").alias(n) for i, n in enumerate(names)))
        path = str(tmp_path / f"shards{len(names)}")
        column = sharding.write_shards(docs, path, limit)
        back = docs.sparkSession.read.parquet(path)
        assert column.lower() not in {n.lower() for n in names} and set(back.columns) == {*docs.columns, column}
        got = back.select("doc_id", column, *names).collect()
        assert sorted(r.doc_id for r in got) == list(range(40)) and all(list(r)[2:] == [f"v{i}" for i in range(len(names))] for r in got)
        wanted = {r.doc_id: "b" + r.shard for r in sharding.assign(docs, limit).collect()}
        assert {r.doc_id: r[column] for r in got} == wanted and (limit < 10**9 or set(wanted.values()) == {"b"})


def test_long_blanks_are_counted_as_the_encoder_would(make_docs):
    place = token_counts.vocabulary_folder()
    pieces, whole = (token_counts.encoding(place, token_counts.VOCABULARY, p) for p in (token_counts.BYTE_PATTERN, token_counts.WHOLE))
    r = random.Random(3)
    blanks = [" " * 9_000, "\n" * 5_000, " \t\n\r" * 2_000, "\u3000 " * 3_000, " " * 8_999 + "\n", "\xa0" * 4_096, "\x1c" * 6_000]
    for _ in range(60):
        text = "".join(r.choice(["word", "7", "?!", " end", "'s", "漢", *blanks]) for _ in range(r.randint(1, 6)))
        assert token_counts.token_count(text, pieces, whole) == len(pieces.encode_ordinary(text))
    million = [" " * 2_000_000, "\n" * 2_000_000 + "x", "a " + " " * 2_000_000, "7" * 300_000, "word " * 400_000]
    found = token_counts.length_histogram(make_docs(million)).collect()
    assert sum(x.n_docs for x in found) == len(million) and max(x.n_tokens for x in found) >= 400_000


def test_classifier_takes_one_row_per_labelled_document(spark, make_docs):
    rows = [(1, f"text {i}") for i in range(500)] + [(2, "other")] * 3 + [(3, None), (9, "unlabelled")]
    known = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    sample = quality_classifier.labelled_sample(make_docs(rows), known).collect()
    assert len(sample) == 3 and {"other", ""} < {r.text for r in sample}
    assert len(quality_classifier.labelled_sample(make_docs(rows), known, 2).collect()) == 2


def test_posterior_equals_grouped_sums_by_hand(spark, make_docs):
    r = random.Random(12)
    rows = []
    for i in range(400):
        source, lang = r.choice(["big", "big", "big", "mid", None, f"rare{i % 9}"]), r.choice(["en", "de", None])
        words = [f"w{r.randint(0, 60)}" for _ in range(40)] + (["awful%%"] * 3 if r.random() < (0.7 if source == "mid" else 0.2) else [])
        rows.append((i, " ".join(words), lang, source))
    known = spark.createDataFrame([(i, int("awful" not in t), int(i % 5 == 0)) for i, t, *_ in rows[:300]], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in quality_classifier.classify(make_docs(rows), known).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))

    def weight(sites):
        """sites: (sum, n); the pseudo-count by the method of moments."""
        n = sum(x[1] for x in sites)
        mean = sum(x[0] for x in sites) / n
        spread = sum(c * (s / c) ** 2 for s, c in sites) / n - mean**2
        noise = mean * (1 - mean) * len(sites) / n
        return min(max(mean * (1 - mean) / max(spread - noise, 1e-6) - 1, 2.0), 1e4)

    for t in ("low", "toxic"):
        hosts, paths = {}, {}
        for i, _, lang, source in rows:
            p = sigmoid(found[i][f"{t}_score"])
            for table, at in ((hosts, source), (paths, (source, lang))):
                s, n = table.get(at, (0.0, 0))
                table[at] = (s + p, n + 1)
        whole = sum(s for s, _ in hosts.values()) / len(rows)
        of_hosts, of_paths = weight(list(hosts.values())), weight(list(paths.values()))
        host = {at: (s + of_hosts * whole) / (n + of_hosts) for at, (s, n) in hosts.items()}
        path = {at: (s + of_paths * host[at[0]]) / (n + of_paths) for at, (s, n) in paths.items()}
        for i, _, lang, source in rows:
            assert found[i][f"{t}_host"] == pytest.approx(host[source], rel=1e-9)
            assert found[i][f"{t}_path"] == pytest.approx(path[(source, lang)], rel=1e-9)
            want = sigmoid(found[i][f"{t}_score"] + logit(path[(source, lang)]) - logit(whole))
            assert found[i][f"p_{t}"] == pytest.approx(want, rel=1e-9)
    assert all(x.kept == (x.p_low <= 0.5 and x.p_toxic <= 0.5) for x in found.values())
