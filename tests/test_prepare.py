from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shoptrace.functions.rules import cents
from shoptrace.operators import audit, cart, funnel, prepare, rfm
from shoptrace.operators.prepare import clean_events, funnel_events, session_product_funnel
from shoptrace.sources.events import read_events, write_result
from shoptrace.sources import tables
from shoptrace.sources.tables import materialise

T1, T2, NOV = "2019-10-01 10:00:00 UTC", "2019-10-02 10:00:00 UTC", "2019-11-03 00:00:00 UTC"


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_cleaning(make_raw):
    rows = prepare.clean_events(
        make_raw(
            [
                (T1, " Cart ", "1", "  ", "", "9.99", "5", " s1 "),
                (None, "PURCHASE", None, " tv ", " acme", None, None, "  "),
                (T1, "view", "2", None, None, "-1", "7", ""),
            ]
        )
    ).collect()
    first, second, third = rows
    assert first["event_ts"] == datetime(2019, 10, 1, 10)
    assert (first["event_type"], first["category_code"], first["brand"], first["user_session"]) == ("cart", None, None, "s1")
    assert (second["event_type"], second["category_code"], second["brand"]) == ("purchase", "tv", "acme")
    assert (second["event_ts"], second["price"], second["user_id"], second["user_session"]) == (None,) * 4
    assert third["price"] == -1.0 and third["user_session"] is None


def test_malformed_values_raise(make_raw):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        prepare.clean_events(make_raw([(T1, "view", "x1", "c", "b", "1", "1", "s")])).collect()


def test_purchases_need_every_key_and_a_positive_price(make_raw):
    good = (T1, "Purchase ", "1", "", None, "10.5", "5", "s")
    bad = [
        (None, "purchase", "1", "c", "b", "1", "5", "s"),
        (T1, "purchase", "1", "c", "b", "0", "5", "s"),
        (T1, "purchase", "1", "c", "b", "-1", "5", "s"),
        (T1, "purchase", "1", "c", "b", None, "5", "s"),
        (T1, "purchase", "1", "c", "b", "1", None, "s"),
        (T1, "purchase", "1", "c", "b", "1", "5", "  "),
        (T1, "cart", "1", "c", "b", "1", "5", "s"),
    ]
    (row,) = prepare.purchases(prepare.clean_events(make_raw([good, *bad]))).collect()
    assert (row["category_code"], row["brand"]) == ("Unknown", "Unknown")
    assert (row["month_date"], row["event_date"]) == (date(2019, 10, 1), date(2019, 10, 1))


def pair_events(make_raw):
    cases = {
        "view only": [("view", "5")],
        "cart only": [("cart", "5")],
        "purchase only": [("purchase", "5")],
        "purchase then cart": [("purchase", "5"), ("cart", "5")],
        "all": [("view", "5"), ("cart", "5"), ("purchase", "5")],
        "free purchase": [("purchase", "0")],
        "unpriced cart": [("cart", None), ("view", "-3")],
        "two purchases": [("purchase", "5.25"), ("purchase", "6.10")],
    }
    rows = [
        (T1 if i == 0 else T2, kind, "1", "tv", "acme", price, "9", session)
        for session, events in cases.items()
        for i, (kind, price) in enumerate(events)
    ]
    rows.append((T1, "signup", "1", "tv", "acme", "5", "9", "ignored"))
    rows.append((T1, "view", None, "tv", "acme", "5", "9", "no product"))
    return prepare.funnel_events(prepare.clean_events(make_raw(rows)))


def test_funnel_flags(make_raw):
    got = by_key(prepare.session_product_funnel(pair_events(make_raw)), "user_session")
    flags = {k[0]: (r["reached_view"], r["reached_cart"], r["reached_purchase"], r["revenue_proxy"]) for k, r in got.items()}
    assert flags == {
        "view only": (1, 0, 0, 0.0),
        "cart only": (1, 1, 0, 0.0),
        "purchase only": (1, 1, 1, 5.0),
        "purchase then cart": (1, 1, 1, 5.0),
        "all": (1, 1, 1, 5.0),
        "free purchase": (0, 0, 0, 0.0),
        "unpriced cart": (1, 1, 0, 0.0),
        "two purchases": (1, 1, 1, 11.35),
    }


def test_generic_funnel_agrees(make_raw):
    got = by_key(prepare.funnel(pair_events(make_raw), ["user_session"]), "user_session")
    full = by_key(prepare.session_product_funnel(pair_events(make_raw)), "user_session")
    for key, row in got.items():
        assert row.items() <= full[key].items()


def test_cart_pairs(make_raw):
    got = by_key(prepare.cart_pairs(pair_events(make_raw)), "user_session")
    assert {k[0] for k in got} == {"cart only", "purchase then cart", "all", "unpriced cart"}
    assert {k[0]: r["cart_abandoned"] for k, r in got.items()} == {
        "cart only": 1, "purchase then cart": 0, "all": 0, "unpriced cart": 1,
    }
    unpriced = got[("unpriced cart",)]
    assert unpriced["product_price"] is None and unpriced["price_band"] == "1000+"
    named = by_key(prepare.cart_pairs(pair_events(make_raw), null_band="Unknown"), "user_session")
    assert named[("unpriced cart",)]["price_band"] == "Unknown" and named[("unpriced cart",)]["band_order"] == 7


def test_price_bands(make_raw):
    edges = {
        "49.99": "Under 50", "50": "50-149", "149.99": "50-149", "150": "150-299", "299.99": "150-299", "300": "300-599",
        "599.99": "300-599", "600": "600-999", "999.99": "600-999", "1000": "1000+",
    }
    raw = make_raw([(T1, "cart", "1", "c", "b", price, "1", price) for price in edges])
    got = prepare.cart_pairs(prepare.funnel_events(prepare.clean_events(raw), require_ts=True)).collect()
    assert {r["user_session"]: r["price_band"] for r in got} == edges


def test_cart_month_is_that_of_the_first_event(make_raw):
    raw = make_raw([(T1, "view", "1", "c", "b", "5", "1", "s"), (NOV, "cart", "1", "c", "b", "5", "1", "s")])
    events = prepare.funnel_events(prepare.clean_events(raw), require_ts=True)
    assert prepare.cart_pairs(events).first()["first_month"] == date(2019, 10, 1)
    assert [r["view_interactions"] for r in funnel.category_monthly_funnel(events).collect()] == [1, 1]


def test_carts_ignore_events_without_a_time_and_the_funnel_does_not(make_raw):
    raw = make_raw([(T1, "view", "1", "c", "b", "5", "1", "s"), (None, "cart", "1", "c", "b", "5", "1", "s")])
    events = prepare.funnel_events(prepare.clean_events(raw))
    assert prepare.cart_pairs(events).count() == 0
    assert prepare.session_product_funnel(events).first()["reached_cart"] == 1


def test_journey(spark):
    day = lambda s: date.fromisoformat(s)
    rows = [
        (1, "a", day("2019-10-01"), 10.0),
        (2, "b", day("2019-10-05"), 1.0), (2, "a", day("2019-10-05"), 2.0), (2, "c", day("2019-11-01"), 3.0),
        (3, "x", day("2019-10-01"), 5.0), (3, "y", day("2019-10-08"), 5.5),
        (4, "x", day("2019-10-01"), 5.0), (4, "y", day("2019-10-31"), 5.5), (4, "z", day("2019-10-31"), 1.0),
    ]
    sessions = spark.createDataFrame(rows, "user_id bigint, user_session string, session_date date, session_value double")
    got = by_key(prepare.journey(sessions), "user_id")
    assert got[(1,)]["second_purchase_date"] is None and got[(1,)]["is_repeat_customer"] == 0
    assert got[(1,)]["days_observed_since_first_purchase"] == 31
    assert got[(2,)]["days_to_second_purchase"] == 0 and got[(2,)]["purchase_sessions"] == 3
    assert got[(2,)]["customer_revenue_proxy"] == 6.0 and got[(2,)]["cohort_month"] == day("2019-10-01")
    assert got[(3,)]["days_to_second_purchase"] == 7
    assert got[(4,)]["days_to_second_purchase"] == 30 and got[(4,)]["last_purchase_date"] == day("2019-10-31")


def test_stages_only_shrink_and_carts_add_up(make_raw):
    import random

    rng = random.Random(5)
    raw = make_raw(
        [
            (T1, rng.choice(["view", "cart", "purchase"]), str(rng.randint(1, 4)), rng.choice(["tv", ""]), "b",
             rng.choice(["0", "5", "70", None]), "1", f"s{rng.randint(1, 60)}")
            for _ in range(600)
        ]
    )
    events = prepare.funnel_events(prepare.clean_events(raw))
    for r in funnel.category_funnel(prepare.session_product_funnel(events)).collect():
        assert r["purchase_interactions"] <= r["cart_interactions"] <= r["view_interactions"]
    pairs = prepare.cart_pairs(events)
    total = cart.cart_overview(pairs).first()
    assert total["purchased_after_cart"] + total["abandoned_after_cart"] == total["cart_session_products"]
    spread = prepare.session_product_funnel(events.repartition(13)).orderBy("user_session", "product_id").collect()
    assert spread == prepare.session_product_funnel(events).orderBy("user_session", "product_id").collect()


def test_stored_log_is_pruned_to_purchases(spark, make_raw, tmp_path):
    from shoptrace.sources.events import write_events

    raw = make_raw([(T1, "view", "1", "c", "b", "5", "1", "s"), (T1, "purchase", "1", "c", "b", "5", "1", "s")])
    write_events(prepare.clean_events(raw), str(tmp_path / "log"))
    buys = prepare.purchases(spark.read.parquet(str(tmp_path / "log"))).select("price")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = buys._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "event_type" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThan(price,0.0)" in plan.split("PushedFilters: [")[1]
    assert "brand" not in plan.split("ReadSchema")[1]
    assert [r["price"] for r in buys.collect()] == [5.0]


def test_quoted_fields_and_equal_file_names(spark, tmp_path):
    text = 'event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n'
    for folder, brand in (("oct", '"a ""b"", c"'), ("nov", "plain")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0.csv").write_text(text + f"2019-10-01 00:00:00,view,1,1,x.y,{brand},1.50,7,s\n")
    rows = read_events(spark, [str(tmp_path / "oct"), str(tmp_path / "nov")]).select("brand", "src").collect()
    assert sorted(r.brand for r in rows) == ['a "b", c', "plain"]
    assert len({r.src for r in rows}) == 2


def test_a_fraction_of_a_cent_is_refused(spark):
    df = spark.createDataFrame([(2.345,)], "price double")
    with pytest.raises(Exception, match="fraction of a cent"):
        df.select(cents("price")).collect()
    assert spark.createDataFrame([(2.34,), (None,)], "price double").select(cents("price").alias("c")).collect()[0].c == 234


def test_the_log_is_folded_by_hashing(spark, make_raw):
    events = funnel_events(clean_events(make_raw([])))
    plan = session_product_funnel(events)._jdf.queryExecution().executedPlan().toString()
    lowest = plan[plan.rindex("Aggregate") - 12 :]
    assert lowest.lstrip("( ").split("Aggregate")[0].endswith("Hash")


def test_malformed_values_are_kept_aside(make_raw):
    rows = [
        ("2019-10-01 10:00:00 UTC", "view", "1", "tv", "a", "1.5", "7", "s", "x"),
        ("2019-10-01", "view", "2", "tv", "a", "n/a", "7", "s", "x"),
        ("soon", "view", "3", "tv", "a", "2", "u7", "s", "x"),
        ("2019-10-02", "view", "4", "tv", "a", "  ", None, "s", "x"),
        ("2019-10-02", "view", "99999999999999999999", "tv", "a", "3", "8", "s", "x"),
    ]
    raw = make_raw(rows)
    sound, rejects = prepare.split_events(raw)
    assert sorted((r["product_id"], r["price"], r["user_id"]) for r in sound.collect()) == [(1, 1.5, 7), (4, None, None)]
    found = {r["product_id"]: r["reject_reason"] for r in rejects.collect()}
    assert found == {"2": "price", "3": "event_time,user_id", "99999999999999999999": "product_id"}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        prepare.clean_events(raw).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        audit.audit_price_checks(raw).collect()
    counts = {r["column_name"]: r["malformed"] for r in audit.audit_rejects(raw).collect()}
    assert counts == {"event_time": 1, "product_id": 1, "category_id": 0, "price": 1, "user_id": 1}
    lenient = audit.audit_combined(raw, strict=False).first()
    assert (lenient["row_count"], lenient["zero_price"], lenient["high_price"]) == (5, 0, 0)
    assert audit.combined(audit.file_records(raw, strict=False)).first() == lenient
    assert prepare.split_events(raw.where("false"))[1].count() == 0


def test_lines_that_do_not_fit_the_header(spark, tmp_path):
    (tmp_path / "log.csv").write_text("event_type,price,brand\nview,1,a\ncart,2\nview,3,b,c\n")
    raw = read_events(spark, [str(tmp_path)], keep_corrupt=True)
    rejects = prepare.split_events(raw)[1].select("_corrupt_record", "reject_reason").collect()
    assert sorted(map(tuple, rejects)) == [("cart,2", "line"), ("view,3,b,c", "line")]
    assert {r["column_name"]: r["malformed"] for r in audit.audit_rejects(raw).collect()}["line"] == 2


def test_states_of_parts_merge_to_the_full_run(spark, make_raw):
    rng = random.Random(4)
    rows = [
        (f"2019-{rng.choice([10, 11])}-{rng.randint(1, 28):02d}", "purchase", str(rng.randint(1, 5)), "tv", "a", f"{rng.randint(1, 900) / 100}",
         str(u), f"{u}-{rng.randint(1, 3)}", "x")
        for u in [rng.choice([1, 1, rng.randint(2, 30)]) for _ in range(400)]
    ]
    buys = materialise(prepare.purchases(prepare.clean_events(make_raw(rows))))
    months = [prepare.session_state(buys.where(F.month("event_date") == m)) for m in (10, 11)]
    merged = materialise(prepare.merged_sessions(months[0].unionByName(months[1])))
    assert sum(m.count() for m in months) > merged.count()  # sessions with events in both
    sessions = materialise(prepare.purchase_sessions(buys))
    same = lambda a, b: sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    assert same(prepare.sessions_from_state(merged), sessions)
    assert same(rfm.rfm_from_state(merged), rfm.rfm(buys))
    thrice = prepare.merged_sessions(prepare.merged_sessions(months[0]).unionByName(months[1]))
    assert same(thrice, merged)


def test_only_rewritten_parts_of_a_result_change(spark, tmp_path):
    rows = [(m, i) for m in ("2019-10", "2019-11", "2019-12") for i in range(20)]
    df = spark.createDataFrame(rows, "month string, v int")
    for fmt in ("parquet", "csv"):
        path = tmp_path / fmt
        write_result(df, str(path), fmt, "month")
        bytes_of = lambda: {p.relative_to(path): p.read_bytes() for p in path.rglob("part-*")}
        before = bytes_of()
        again = df.where("month = '2019-11'").withColumn("v", F.col("v") + 100)
        for _ in range(2):  # repeatable
            write_result(again, str(path), fmt, "month")
        after = bytes_of()
        kept = {p for p in before if "2019-11" not in str(p)}
        assert {p: after[p] for p in kept} == {p: before[p] for p in kept}
        assert sum("2019-11" in str(p) for p in after) >= 1
        reader = spark.read.option("header", True).option("inferSchema", True)
        read = getattr(reader, fmt)(str(path))
        assert read.count() == 60 and read.where("v >= 100").count() == 20


def test_stored_folds_need_no_shuffle_of_the_log(make_raw):
    rng = random.Random(8)
    rows = [
        (f"2019-{rng.choice([10, 11])}-{rng.randint(1, 28):02d}" if i % 9 else None, rng.choice(["view", "cart", "purchase"]), str(rng.randint(1, 6)),
         rng.choice(["tv", "tv", "", "shoes"]), "a", f"{rng.randint(-5, 900) / 100}", str(i % 40), "hot" if i % 3 else f"s{i % 50}", "x")
        for i in range(1500)
    ]
    events = funnel_events(clean_events(make_raw(rows)))
    folds = tables.written_bucketed(prepare.pair_months(events), "pair-months", prepare.PAIR, 4)[0]
    facts = prepare.facts_from_folds(folds)
    monthly = funnel.category_monthly_funnel_from_folds(folds)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(facts, prepare.session_product_facts(events)) and same(monthly, funnel.category_monthly_funnel(events))
    # counts per month and category are shuffled and sorted, pairs are not
    for table, exchanges in ((prepare.funnel_from_facts(facts), 0), (prepare.cart_pairs_from_facts(facts), 0), (monthly, 2)):
        plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange ") == exchanges and "Bucketed: true" in plan
