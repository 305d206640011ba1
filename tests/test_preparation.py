"""Late views, rejected rows, hierarchies, redeliveries and validity, against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy as hi
from ledgerloom.operators import late_views, redelivery, rejects, valid_at
from ledgerloom.plans import preparation
from ledgerloom.streaming import live

DAY = late_views.DAY_US


# ---- late events
def _log(spark, rows):
    return spark.createDataFrame(rows, "k string, event_us long, known_us long, amount long")


def test_routes_at_the_edges(spark):
    end = 5 * DAY
    rows = [("a", end - 1, end + 2 * DAY, 1), ("b", end - 1, end + 2 * DAY + 1, 1), ("c", end - DAY, end + 30 * DAY, 1), ("d", end - 1, end + 30 * DAY + 1, 1), ("e", None, 1, 1), ("f", 1, None, 1), ("g", -1, 0, 1)]
    got = {r["k"]: r["route"] for r in late_views.route(_log(spark, rows)).collect()}
    assert got == {"a": "on_time", "b": "late", "c": "late", "d": "too_late", "e": None, "f": None, "g": "on_time"}
    assert late_views.route(_log(spark, rows).limit(0)).count() == 0


def test_views_come_out_right_whatever_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), (t := rng.randrange(0, 40) * DAY + rng.randrange(DAY)), t + rng.randrange(0, 60 * DAY), rng.randrange(100)) for _ in range(400)]
    log = late_views.route(_log(spark, rows)).cache()
    fast, frozen, last = None, None, -1
    for now in (20 * DAY, 45 * DAY, 70 * DAY, 120 * DAY):
        batch = log.where((F.col("known_us") > last) & (F.col("known_us") <= now))
        fast = late_views.fast_increment(fast, batch, ["k"], "amount").cache()
        frozen = late_views.batch_recompute(log, frozen, now, ["k"], "amount").cache()
        last = now
    want = Counter()
    for k, t, known, amount in rows:
        if known <= (t // DAY + 31) * DAY:
            want[k, t // DAY * DAY] += amount
    for view in (fast, frozen, late_views.serve(frozen, None, ["k"])):
        assert {(r["k"], r["period_us"]): int(r["amount"]) for r in view.collect()} == want
    assert frozen.where("not is_frozen").count() == 0
    assert late_views.missed(log).where("route = 'too_late'").count() == sum(1 for _, t, known, _ in rows if known > (t // DAY + 31) * DAY)


def test_first_and_last_figures_of_a_schedule(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), (t := rng.randrange(0, 40) * DAY + rng.randrange(DAY)), t + rng.randrange(0, 60 * DAY) // rng.choice([1, 30]), rng.randrange(100)) for _ in range(300)]
    log = late_views.route(_log(spark, rows)).cache()
    first, last = Counter(), Counter()
    for k, t, known, amount in rows:
        lag = known - (t // DAY + 1) * DAY
        first[k, t // DAY * DAY] += amount * (lag <= 2 * DAY)
        last[k, t // DAY * DAY] += amount * (lag <= 30 * DAY)
    for times in ([120 * DAY], [15 * DAY, 44 * DAY, 120 * DAY]):
        for view, want in zip(late_views.scheduled(log, times, ["k"], "amount"), (first, last), strict=True):
            assert {x: n for r in view.collect() if (n := int(r["amount"])) and (x := (r["k"], r["period_us"]))} == {x: n for x, n in want.items() if n}


def test_corrections_are_what_the_runs_changed_and_refused(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), (t := rng.randrange(0, 40) * DAY + rng.randrange(DAY)), t + rng.randrange(0, 60 * DAY) // rng.choice([1, 30]), i) for i in range(300)]
    log = late_views.route(_log(spark, rows)).cache()
    want = {r["amount"]: r["route"] for r in late_views.missed(log).collect()}
    for times in ([120 * DAY], [15 * DAY, 44 * DAY, 120 * DAY]):
        found = late_views.corrections(log, *late_views.layers(log, times, ["k"], "amount"), ["k"]).collect()
        assert {r["amount"]: r["late_kind"] for r in found} == want and len(found) == len(want)
    empty = log.limit(0)
    assert late_views.corrections(empty, *late_views.layers(empty, [1], ["k"], "amount"), ["k"]).count() == 0


def test_daily_views_hold_allocations_and_run_the_batches(spark, monkeypatch):
    calls = Counter()
    for name in ("fast_increment", "batch_recompute"):
        f = getattr(late_views, name)
        monkeypatch.setattr(late_views, name, lambda *a, f=f, name=name, **k: (calls.update([name]), f(*a, **k))[1])
    d = "/root/testdata/sf0.001"
    views = [r.asDict() for r in preparation.p2_views(spark, d).collect()]
    runs = calls["batch_recompute"]
    assert runs > 1 and calls["fast_increment"] == runs and all(r["is_frozen"] for r in views)
    log = late_views.route(preparation._p2_log(spark, d).distinct()).where("period_us is not null").collect()
    assert {r["record_kind"] for r in views} == {"event", "allocation"}
    for kind in ("event", "allocation"):
        mine, own = [r for r in log if r["record_kind"] == kind], [r for r in views if r["record_kind"] == kind]
        for route, n, amount in ((("on_time",), "n_first", "amount_first"), (("on_time", "late"), "n", "amount"), (("too_late",), "n_too_late", "amount_too_late")):
            assert sum(r[n] for r in own) == sum(r["route"] in route for r in mine)
            assert sum(int(r[amount] or 0) for r in own) == sum(r["amount"] or 0 for r in mine if r["route"] in route)
    daily = {r["day"]: (r["n_on_time"], r["n_late"], r["n_too_late"]) for r in preparation.p2_daily(spark, d).collect()}
    assert calls["batch_recompute"] > runs
    assert daily == {r["day"]: (r["n_first"], r["n"] - r["n_first"], r["n_too_late"]) for r in views if r["record_kind"] == "event"}


# ---- rejected rows
ALLOCATION = "A1,P1,B1,100,USD,2024-01-01T00:00:00Z,ref"


def test_records(spark):
    cases = {
        ALLOCATION: ([], None),
        ALLOCATION + "\r": ([], None),
        ALLOCATION + "\r\r": (["quoting"], "source_ref"),
        'A1,P1,B1,"100",USD,2024-01-01T00:00:00Z,"a ""b"", c\nd"': ([], None),
        'A1,P1,B1,100,USD,t,"open': (["quoting"], "source_ref"),
        'A1,P"1,B1,100,USD,t,r': (["quoting"], "payment_event_id"),
        'A1,"P1"x,B1,100,USD,t,r': (["quoting"], "payment_event_id"),
        "A1,P1,B1,100,USD,t": (["column_count"], "source_ref"),
        ALLOCATION + ",more": (["column_count"], ""),
        "": (["column_count"], "payment_event_id"),
        None: (["column_count"], "payment_event_id"),
        "A1,P1,B1,0,USD,t,r": (["bad_amount"], "allocated_amount_minor"),
        "A1,P1,B1,0000000000000000001,USD,t,r": (["bad_amount"], "allocated_amount_minor"),
        "A1,P1,B1,000000000000000001,EUR,t,r": ([], None),
        "A1,P1,B1,１００,USD,t,r": (["bad_amount"], "allocated_amount_minor"),
        "A1,P1,B1,100,USD,t," + "x" * 300_000: ([], None),
        'A1,P1,B1,100,USD,t,"' + 'x""' * 100_000 + '"': ([], None),
    }
    rows = spark.createDataFrame([(i, "allocations", raw, "own") for i, raw in enumerate(cases)], "i int, feed string, raw string, broken_field string")
    got = {r["i"]: (r["reasons"], r["broken_field"]) for r in rejects.check_records(rows).collect()}
    assert [(str(raw)[:60], got[i], want) for i, (raw, want) in enumerate(cases.items()) if got[i] != want and not (want[1] is not None and got[i][0] == want[0] == ["column_count"])] == []
    assert got[7][0] == got[9][0] == ["column_count"]


def test_every_value_reason_and_loading(spark):
    bill = "R1,CPL,CPL-LIS,BN,v1,,AET,S,{},{},2024-01-01T00:00:00Z,2024-01-01T00:00:00Z,ref"
    rows = spark.createDataFrame([(1, "bills", bill.format("x", "EUR")), (2, "bills", bill.format("5", "USD")), (3, "events", "x"), (4, None, "x"), (5, "other", "x")], "i int, feed string, raw string")
    checked = rejects.check_records(rows)
    got = {r["i"]: r["reasons"] for r in checked.collect()}
    assert got == {1: ["bad_amount", "bad_currency"], 2: [], 3: ["column_count"], 4: ["unknown_feed"], 5: ["unknown_feed"]}
    loaded = rejects.load_records(checked, "bills").collect()
    assert len(loaded) == 1 and loaded[0]["record_id"] == "R1" and loaded[0]["previous_record_id"] is None and loaded[0]["billed_amount_minor"] == "5"
    good, bad = rejects.split_rows(checked)
    assert (good.count(), bad.count()) == (1, 4)
    assert rejects.check_records(rows.limit(0)).count() == 0


def test_columns(spark):
    rows = spark.createDataFrame([("5", "USD"), (None, "USD"), ("5", None), ("5\n", "usd")], "billed_amount_minor string, currency string")
    got = [r["reasons"] for r in rejects.check_columns(rows, rejects.BILLS.rules).collect()]
    assert got == [[], ["bad_amount"], ["bad_currency"], ["bad_amount", "bad_currency"]]


# ---- hierarchies
def test_hierarchy_against_walks(spark):
    rng = random.Random(3)
    parent = {f"n{i}": (f"n{rng.randrange(0, 60)}" if rng.random() < 0.7 else rng.choice([None, "", " ", "gone"])) for i in range(60)}
    parent |= {f"c{i}": f" c{i - 1}\t" for i in range(1, 41)} | {"c0": None, "self": "self"}
    rows = [(k, v, "x") for k, v in parent.items()] * 2 + [(None, "n1", "x"), ("", "n1", "x")]
    got = {r["node"]: r for r in hi.hierarchy(spark.createDataFrame(rows, "id string, up string, depth string"), "id", "up").collect()}
    assert set(got) == set(parent)
    for node in parent:
        path, at = [node], node
        while (up := (parent[at] or "").strip()) in parent and up not in path:
            path.append(at := up)
        cyclic = up in parent
        assert (got[node]["root"], got[node]["depth"], got[node]["is_cyclic"]) == (("", -1, True) if cyclic else (path[-1], len(path) - 1, False))
        assert got[node]["path"] == ([] if cyclic else path[::-1])
    tree = spark.createDataFrame(list(got.values()))
    assert hi.descendants(tree).count() == sum(max(r["depth"], 0) for r in got.values())
    assert hi.hierarchy(spark.createDataFrame([], "id string, up string"), "id", "up").count() == 0


# ---- redeliveries
def test_one_copy_of_each(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("b", 1, "x"), (None, 1, "x"), (None, 1, "x"), ("", 3, "x"), ("c", 1, "x"), ("c", 1, "x")] + [("hot", i, "h") for i in range(500)]
    df = spark.createDataFrame(rows, "id string, n int, _ll_many string")
    kept, dropped = redelivery.rank_copies(df, "id", ["n"])
    assert kept.columns == df.columns
    assert Counter((r["id"], r["n"]) for r in kept.collect()) == Counter({("a", 1): 1, ("b", 1): 1, (None, 1): 2, ("", 3): 1, ("c", 1): 1, ("hot", 0): 1})
    assert kept.count() + dropped.count() == len(rows)
    assert redelivery.rank_copies(df.limit(0), "id", ["n"])[0].count() == 0
    stored, new = spark.createDataFrame([("a", 9)], "id string, n int"), spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int")
    assert sorted(map(tuple, redelivery.keep_one(stored, new, "id", ["n"]).collect())) == [("a", 9), ("b", 1)]
    assert redelivery.keep_one(stored, None, "id", ["n"]).count() == 1


def test_a_stream_keeps_first_deliveries_however_late(spark, tmp_path):
    schema, day = "id string, n long, at timestamp", "timestamp'2024-01-01'"
    batches = [[("a", 1, 0), ("a", 0, 0), ("b", 2, 90), ("", 3, 0), (None, 4, 0)], [("a", 5, 95), ("c", 6, 1), ("", 7, 95), ("b", 8, 400)], [("c", 9, 500), ("d", 10, 0)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "id string, n long, days int").selectExpr("id", "n", f"{day} + make_interval(0, 0, 0, days) AS at")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        live.start_once(stream, "id", ["n"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    got = sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [0, 2, 3, 4, 6, 7, 10]


# ---- validity
def test_best_known_against_scan(spark):
    rng = random.Random(5)
    span = 400 * DAY
    versions = [(rng.choice(["p", "q", None]), rng.randrange(span), rng.randrange(20), f"r{i:03d}") for i in range(150)] + [("p", None, 99, "never")]
    versions += versions[:10]
    points = [(i, rng.choice(["p", "q", None, "unknown"]), rng.choice([None, *([rng.randrange(-DAY, span + DAY)] * 9)])) for i in range(300)]
    points += [(1000 + i, k, at) for i, (k, at, _, _) in enumerate(versions) if at is not None]
    vs = spark.createDataFrame(versions, "k string, at long, n int, id string")
    rank = F.struct((-F.col("n")).alias("minus"), F.col("id").alias("id"))
    for levels, low, high in ((10, 0, span), (4, 100 * DAY, 200 * DAY)):
        cells = valid_at.time_cells(valid_at.best_intervals(vs, ["k"], "at", rank), ["k"], low, high, levels)
        masks = valid_at.level_masks(cells, ["k"]).withColumnRenamed("k", "mk")
        ps = spark.createDataFrame(points, "i int, k string, t long")
        ps = ps.join(masks, F.col("k").eqNullSafe(F.col("mk")), "left").drop("mk")
        got = {r["i"]: r["best"] for r in valid_at.as_known(ps, "t", "mask", cells, ["k"], low, high, levels).collect()}
        assert len(got) == len(points)
        for i, k, t in points:
            known = [(-n, v) for e, at, n, v in versions if e == k and at is not None and t is not None and at <= t]
            assert (tuple(got[i]) if got[i] else None) == (min(known) if known else None)


def test_dyadic_nodes_cover_exactly(spark):
    pairs = [(a, b) for a in range(16) for b in range(a, 16)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", valid_at.dyadic_nodes(F.col("a"), F.col("b"), 4).alias("nodes")).collect()
    for a, b, nodes in rows:
        units = Counter(u for n in nodes for u in range(n["idx"] << n["level"], (n["idx"] + 1) << n["level"]))
        assert units == Counter(range(a, b + 1)) and len(nodes) <= 8
