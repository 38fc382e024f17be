from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shoptrace.operators import audit, audit_store
from shoptrace.sources.events import has_column, list_files, read_events, union_logs, write_result

T1 = "2019-10-01 10:00:00 UTC"


def log(make_raw):
    return make_raw(
        [
            (T1, " view", "1", "tv", "acme", "10.00", "1", "s1", "a.csv"),
            ("2019-10-02", "view ", "2", " ", None, "0", "1", "\t", "a.csv"),
            (" ", "VIEW", "3", "tv", "acme", "-5", "2", "s2", "a.csv"),
            ("2019-11-01", "cart", "4", "tv", "acme", "20000", "2", "s1", "b.csv"),
            ("2019-11-02", None, "5", "tv", "acme", None, "3", "s3", "b.csv"),
        ]
    )


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_overview(make_raw):
    got = rows(audit.audit_overview(log(make_raw)), "src")
    assert got["a.csv"]["row_count"] == 3
    assert (got["a.csv"]["min_event_time"], got["a.csv"]["max_event_time"]) == (T1, "2019-10-02")
    assert (got["a.csv"]["distinct_users"], got["a.csv"]["distinct_sessions"]) == (2, 2)
    whole = audit.audit_combined(log(make_raw)).first()
    assert (whole["files"], whole["row_count"], whole["max_event_time"]) == (2, 5, "2019-11-02")
    assert (whole["distinct_users"], whole["distinct_sessions"]) == (3, 3)
    assert (whole["zero_price"], whole["negative_price"], whole["high_price"]) == (1, 1, 1)


def test_event_mix_is_stripped_but_keeps_case(make_raw):
    got = {(r["src"], r["event_type"]): (r["events"], r["share_pct"]) for r in audit.audit_event_mix(log(make_raw)).collect()}
    assert got[("a.csv", "view")] == (2, 66.67) and got[("a.csv", "VIEW")] == (1, 33.33) and got[("b.csv", "")] == (1, 50.0)
    assert sum(r["events"] for r in audit.audit_event_mix(log(make_raw), ()).collect()) == 5


def test_missing(make_raw):
    got = rows(audit.audit_missing(log(make_raw), ()), "column_name")
    assert {k: v["missing"] for k, v in got.items() if v["missing"]} == {
        "event_time": 1, "event_type": 1, "category_code": 1, "brand": 1, "price": 1, "user_session": 1,
    }
    assert got["user_id"]["missing_pct"] == 0.0


def test_top_prices(make_raw):
    raw = make_raw([(T1, "view", str(i), "tv", "", str(i % 9), "1", "s", f"{i % 3}.csv") for i in range(90)])
    top = audit.audit_top_prices(raw)
    per_file = {}
    for r in top.collect():
        per_file.setdefault(r["src"], []).append(r["price"])
        assert r["brand"] == "<missing>"
    assert {k: sorted(v) for k, v in per_file.items()} == {"0.csv": [6.0] * 5, "1.csv": [7.0] * 5, "2.csv": [8.0] * 5}
    assert [r["price"] for r in audit.audit_top_prices_combined(top).collect()] == [8.0] * 5 + [7.0] * 5
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_kmv_is_exact_below_k_and_close_above(spark):
    users = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("user_id"))
    assert audit.kmv_distinct(users, "user_id", 5001).first()["distinct_estimate"] == 5000
    estimate = audit.kmv_distinct(users, "user_id", 256).first()
    assert estimate["hashes_kept"] == 256
    assert abs(estimate["distinct_estimate"] / 5000 - 1) < 4 / math.sqrt(254)
    assert audit.kmv_distinct(users.where(F.lit(False)), "user_id", 16).first()["distinct_estimate"] == 0


def test_merged_sketches_equal_the_sketch_of_the_union(spark):
    halves = spark.range(30_000).select(
        (F.col("id") % 9000).cast("string").alias("user_id"), (F.col("id") % 2).cast("string").alias("src")
    )
    merged = audit.approx_distinct_merge(halves, ["user_id"]).first()["distinct_estimate"]
    whole = audit.approx_distinct_merge(halves.withColumn("src", F.lit("x")), ["user_id"]).first()["distinct_estimate"]
    assert merged == whole == 9000  # fewer than a sketch keeps


def test_sketches_stay_within_their_error_and_do_not_depend_on_layout(spark):
    users = spark.range(1_200_000).select(
        (F.col("id") % 400_000).cast("string").alias("user_id"), (F.col("id") % 3).cast("string").alias("src")
    )
    found = set()
    for frame in (users, users.coalesce(1), users.repartition(13)):
        files = audit.distinct_sketches(frame, ["user_id"])
        sizes = [r[0] for r in files.select(F.octet_length("user_id_sketch")).collect()]
        assert max(sizes) < 8 * 2 ** audit.SKETCH_LG + 100
        found.add(audit.merged_estimates(files, ["user_id"]).first()["distinct_estimate"])
    assert len(found) == 1 and abs(found.pop() / 400_000 - 1) < 4 / math.sqrt(2**audit.SKETCH_LG)
    none = audit.merged_estimates(audit.distinct_sketches(users.where("false"), ["user_id"]), ["user_id"])
    assert none.first()["distinct_estimate"] == 0


def test_whole_profile_is_one_pass_over_the_log(spark, make_raw, tmp_path):
    write_result(log(make_raw).drop("src"), str(tmp_path / "log"))
    raw = read_events(spark, [str(tmp_path / "log")])
    for table in (audit.audit_overview(raw), audit.audit_combined(raw), audit.approx_distinct_merge(raw), audit.profile(audit.file_records(raw))):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan csv") == 1 and "SortAggregate" not in plan


def test_profile_of_files_and_of_all(make_raw):
    raw = log(make_raw)
    records = audit.file_records(raw)
    profile = audit.profile(records)
    by = {r["src"]: r for r in profile.collect()}
    assert {k: (r["scope"], r["files"], r["row_count"]) for k, r in by.items()} == {
        "a.csv": ("file", 1, 3), "b.csv": ("file", 1, 2), None: ("all", 2, 5),
    }
    for scope, by_ in (("file", ("src",)), ("all", ())):
        as_rows = lambda df: sorted(map(str, df.collect()))
        assert as_rows(audit.profile_missing(profile, scope)) == as_rows(audit.audit_missing(raw, by_))
        assert as_rows(audit.profile_event_mix(records, by_)) == as_rows(audit.audit_event_mix(raw, by_))
    assert audit.combined(records).first() == audit.audit_combined(raw).first()
    empty = audit.file_records(raw.where("false"))
    assert audit.profile(empty).count() == 0
    assert [(r["files"], r["row_count"], r["distinct_users"]) for r in audit.combined(empty).collect()] == [(0, 0, 0)]


def csv(folder, name, lines):
    folder.mkdir(exist_ok=True)
    header = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


def test_later_audits_read_only_files_not_seen(spark, tmp_path):
    store, oct_, nov = str(tmp_path / "store"), tmp_path / "oct", tmp_path / "nov"
    line = lambda day, price, user: f"{day},view,1,2,tv,acme,{price},{user},s{user}"
    csv(oct_, "a.csv", [line("2019-10-01", 5, u) for u in range(40)])
    csv(oct_, "b.csv", [line("2019-10-02", 0, u) for u in range(30, 60)])
    csv(nov, "c.csv", [line("2019-11-01", -1, u) for u in range(50, 70)])
    whole = lambda paths: audit.audit_combined(read_events(spark, paths)).first()
    assert audit_store.incremental_audit(spark, [str(oct_)], store).first() == whole([str(oct_)])
    both = [str(oct_), str(nov)]
    assert [r.src.rsplit("/")[-1] for r in audit_store.unseen_files(spark, both, store).collect()] == ["c.csv"]
    assert audit_store.refresh(spark, both, store) == 1 and audit_store.refresh(spark, both, store) == 0
    records, top = audit_store.stored(spark, both, store)
    assert audit.combined(records).first() == whole(both)
    assert sorted(map(str, top.collect())) == sorted(map(str, audit.audit_top_prices(read_events(spark, both)).select(top.columns).collect()))

    # a file written anew is read again, its old record no longer counts; one without rows is known; a lost one no longer counts
    csv(nov, "c.csv", [line("2019-11-03", 7, u) for u in range(5)])
    csv(nov, "empty.csv", [])
    assert audit_store.refresh(spark, both, store) == 2 and audit_store.refresh(spark, both, store) == 0
    after = audit.combined(audit_store.stored(spark, both, store)[0]).first()
    assert (after["files"], after["row_count"], after["max_event_time"], after["negative_price"]) == (4, 75, "2019-11-03", 0)
    assert audit.combined(audit_store.stored(spark, [str(nov)], store)[0]).first()["row_count"] == 5
    # a run that failed after its first write is repeated, and another price limit has its own records
    spark.read.parquet(f"{store}/top_prices").where("src LIKE '%c.csv'").write.mode("append").parquet(f"{store}/top_prices")
    assert audit_store.stored(spark, both, store)[1].count() == 15
    assert audit_store.refresh(spark, both, store, high=4) == 4
    assert audit.combined(audit_store.stored(spark, both, store, high=4)[0]).first()["high_price"] == 45


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    (tmp_path / "log.csv").write_text('event_type,brand,price\nview,"a ""b""\nc",1\ncart,d,2\n')
    got = read_events(spark, [str(tmp_path)], multi_line=True).select("event_type", "brand", "price").collect()
    assert sorted(map(tuple, got)) == [("cart", "d", "2"), ("view", 'a "b"\nc', "1")]
    assert read_events(spark, [[str(tmp_path / "log.csv")]]).count() == 3  # line by line, as documented
    (file,) = list_files(spark, [str(tmp_path)]).collect()
    assert file.delivery == 0 and file.src.endswith("log.csv") and file.file_size == len((tmp_path / "log.csv").read_bytes())


def test_csv_deliveries_are_joined_by_name(spark, make_raw, tmp_path):
    first = log(make_raw).where("src = 'a.csv'").drop("src")
    second = log(make_raw).where("src = 'b.csv'").select("price", "user_id", "event_type")
    write_result(first, str(tmp_path / "one"))
    write_result(second, str(tmp_path / "two"))
    got = read_events(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert has_column(got, "brand") and not has_column(got, "country")
    assert got.count() == 5 and got.where("src IS NULL").count() == 0
    assert {r["price"] for r in got.where("event_time IS NULL AND event_type IS NOT NULL AND product_id IS NULL").collect()} == {"20000"}
    assert got.where("event_type = 'view '").count() == 1
    with pytest.raises(ValueError):
        read_events(spark, [])


def test_union_keeps_copies(make_raw):
    assert union_logs([log(make_raw), log(make_raw)]).count() == 10


def test_unknown_result_format(make_raw, tmp_path):
    with pytest.raises(ValueError):
        write_result(log(make_raw), str(tmp_path / "x"), "xml")
