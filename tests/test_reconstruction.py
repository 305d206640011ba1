"""Reference scenarios with exact answers."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import agreement, landmarks, lineages, linkage, money, normalize, risk
from ledgerloom.sources import files, generator

DAY = landmarks.DAY_US
EVENT = "event_id string, bill_record_id string, event_type string, amount long, currency string, reverses_event_id string, available_us long"


def settle(spark, owners, payments, allocations, reversals):
    events = [(p, own, "PAYMENT_POSTED", a, "USD", "", 1) for p, own, a in payments] + [(f"R{i}", "", "PAYMENT_REVERSED", a, "USD", p, 2 + i) for i, (p, a) in enumerate(reversals)]
    es = spark.createDataFrame(events, EVENT)
    als = spark.createDataFrame([(f"A{i}", p, b, a, "USD", i) for i, (p, b, a) in enumerate(allocations)], "allocation_id string, payment_event_id string, bill_record_id string, amount long, currency string, available_us long")
    owner_of = spark.createDataFrame(list(owners.items()), "record_id string, owner string")
    pays = money.payments_of(es)
    parts = money.parts_of(pays, money.allocations_of(als), owner_of).cache()
    back = money.reversed_by_owner(parts, money.capped(money.reversals_of(es)[0], pays))
    return {r["owner"]: (r["gross"], r["reversed"], r["net"], r["unallocated"]) for r in money.amounts(parts, back).collect()}


CASES = {
    "C01": (({"B2": "L1"}, [("P1", "", 500)], [("P1", "B2", 500)], []), {"L1": (500, 0, 500, 0)}),
    "C02": (({"B2": "L1"}, [("P1", "", 1000)], [("P1", "B2", 600)], []), {"L1": (1000, 0, 1000, 400)}),
    "C03": (({"B2": "L1"}, [("P1", "B2", 1000)], [], [("P1", 700), ("P1", 700)]), {"L1": (1000, 1000, 0, 1000)}),
    "C11": (({"B1": "L1"}, [("P1", "B1", 100), ("P2", "B1", 100)], [], [("P1", 100), ("P2", 100)]), {"L1": (200, 200, 0, 200)}),
    "C12": (({"B1": "L1", "B2": "L2"}, [("P1", "", 1000)], [("P1", "B1", 600), ("P1", "B2", 200)], [("P1", 400)]), {"L1": (600, 240, 360, 0), "L2": (200, 80, 120, 0), "UNLINKED": (200, 80, 120, 200)}),
    "C13": (({"A": "LA", "B": "LB"}, [("P1", "", 100)], [("P1", "A", 50), ("P1", "B", 50)], [("P1", 1), ("P1", 99)]), {"LA": (50, 50, 0, 0), "LB": (50, 50, 0, 0)}),
    "C14": (({"A": "LA"}, [("P1", "", 100)], [("P1", "A", 40)], [("P1", 100)]), {"LA": (100, 100, 0, 60)}),
    "X01": (({f"B{i}": f"L{i}" for i in range(1, 6)}, [("P1", "", 5)], [("P1", f"B{i}", 1) for i in range(1, 6)], [("P1", 4)]), {f"L{i}": (1, int(i != 4), int(i == 4), 0) for i in range(1, 6)}),
    "T07": (({"B1": "L1"}, [("P1", "", 10000)], [("P1", "B1", 7000), ("P1", "B1", 6000)], []), {}),
    "F13": (({"B1": "L1"}, [("P1", "B1", 10000)], [], [("P1", 4000), ("gone", 5)]), {"L1": (10000, 4000, 6000, 10000)}),
    "none": (({"B1": "L1"}, [], [], []), {}),
}


@pytest.mark.parametrize("name", CASES)
def test_money(spark, name):
    given, want = CASES[name]
    assert settle(spark, *given) == want


T0 = 19_600 * DAY


def snaps(spark, events, allocations=(), coverage=10**18):
    es = spark.createDataFrame([(e, b, k, a, T0 + at) for e, b, k, a, at in events], "event_id string, bill_record_id string, event_type string, amount long, available_us long")
    als = spark.createDataFrame([(p, b, T0 + at) for p, b, at in allocations], "payment_event_id string, bill_record_id string, available_us long")
    owner_of = spark.createDataFrame([("B1", "L1"), ("B2", "L1"), ("B3", "L2")], "record_id string, owner string")
    owners = spark.createDataFrame([("L1", "complete", coverage), ("L2", "complete", coverage)], "owner string, coverage_status string, coverage_end_us long")
    return {r["owner"]: (r["outcome"], r["outcome_interval"]) for r in landmarks.snapshots(landmarks.effective_times(es, als, owner_of), owners).collect()}


def test_landmarks(spark):
    s1, s3 = ("S1", "B1", "SUBMITTED", None, 0), ("S3", "B3", "SUBMITTED", None, 0)
    assert snaps(spark, [s1, s3, ("P1", "", "PAYMENT_POSTED", 900, 19 * DAY)], [("P1", "B2", 19 * DAY), ("P1", "B3", 19 * DAY)]) == {"L1": ("payment", 2), "L2": ("payment", 2)}
    assert snaps(spark, [s1, ("P1", "", "PAYMENT_POSTED", 9, 9 * DAY)], [("P1", "B1", 24 * DAY)]) == {"L1": ("payment", 3)}
    assert snaps(spark, [s1, ("P1", "B1", "PAYMENT_POSTED", 9, 37 * DAY)]) == {"L1": ("still_open", None)}
    assert snaps(spark, [s1, ("P1", "B1", "PAYMENT_POSTED", 9, 2 * DAY)]) == {}
    tie = [("C1", "B1", "CLOSED_NO_PAYMENT", None, 10 * DAY), ("P1", "B1", "PAYMENT_POSTED", 9, 10 * DAY)]
    assert snaps(spark, [s1, *tie]) == snaps(spark, [s1, *tie[::-1]]) == {"L1": ("payment", 0)}
    assert snaps(spark, [s1], coverage=T0) == {"L1": ("censored", None)}
    assert snaps(spark, []) == {}


def test_intervals_and_split(spark):
    rows = spark.createDataFrame([("a", 1, "close_no_payment", 1), ("b", 2, "still_open", None), ("c", 3, "censored", None)], "owner string, t_us long, outcome string, outcome_interval int")
    got = sorted((r["owner"], r["interval"], r["label"]) for r in landmarks.interval_rows(rows).collect())
    assert got == [("a", 0, "none"), ("a", 1, "close_no_payment")] + [("b", i, "none") for i in range(6)]
    many = spark.range(10).select(F.col("id").cast("string").alias("owner"), (F.col("id") * DAY * 2).alias("t_us"))
    parts = {r["owner"]: r["part"] for r in landmarks.temporal_split(many).collect()}
    assert [parts[str(i)] for i in range(10)] == ["train"] * 6 + ["middle"] * 2 + ["test"] * 2


def test_curves(spark):
    row = "array(named_struct('p_payment', 0.2D, 'p_close', 0.1D, 'p_none', 0.7D), named_struct('p_payment', 0.3D, 'p_close', 0.1D, 'p_none', 0.6D))"
    got = spark.range(1).select(risk.cumulative(F.expr(row)).alias("c")).first()["c"]
    assert [round(x["f_payment"], 9) for x in got] == [0.2, 0.41] and round(got[1]["s"], 9) == 0.42
    with pytest.raises(Exception, match="add up"):
        spark.range(1).select(risk.cumulative(F.expr(row.replace("0.2D", "-0.2D")))).collect()


BILL = "record_id string, org_token string, source_system string, bill_id string, version_id string, previous_record_id string, payer_token string, service_token string, amount long, currency string, submitted_us long, available_us long, source_ref string"


def bill(record, bill_id, version, previous="", org="CPL", amount=100, at=1, payer="AET", service="S1", system="LIS"):
    return (record, org, system, bill_id, version, previous, payer, service, amount, "USD", at, at, "ref")


def test_links(spark):
    bills = spark.createDataFrame([
        bill("a", "1", "9", at=1), bill("b", "1", "10", "a", at=2), bill("c", "2", "1", "gone", at=3, service="S2"), bill("d", "3", "1", "e", org="TRI", at=4), bill("e", "4", "1", at=5, service="S3"),
        bill("f", "5", "1", "g", at=6, service="S4"), bill("g", "6", "1", "f", at=7, service="S5"), bill("h", "7", "1", at=8, service=""), bill("i", "7", "1", at=9, service="", amount=5),
    ], BILL)
    chain, ambiguous = linkage.version_links(bills)
    assert [tuple(r)[:2] for r in chain.collect()] == [("a", "b")]
    assert sorted(r["record_id"] for r in ambiguous.collect()) == ["h", "i"]
    proposals = linkage.by_priority(linkage.native_links(bills), chain)
    got = {(r["left_id"], r["right_id"]): (r["rule"], r["verdict"]) for r in linkage.check_links(proposals, bills).collect()}
    assert got == {("a", "b"): (linkage.R1, "accepted"), ("gone", "c"): (linkage.R1, "DANGLING_REFERENCE"), ("e", "d"): (linkage.R1, "CROSS_ORG_REFERENCE"), ("g", "f"): (linkage.R1, "CYCLE_REFERENCE"), ("f", "g"): (linkage.R1, "CYCLE_REFERENCE")}


def test_weak_links_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [bill(f"r{i}", str(i), "1", amount=rng.randrange(0, 300), at=rng.randrange(40) * DAY // 2, payer=rng.choice(["AET", ""]), system=rng.choice("xy")) for i in range(120)]
    want = {(x[0], y[0]) for x in rows for y in rows if (x[11], x[0]) < (y[11], y[0]) and x[2] == y[2] and x[6] and y[6] and min(x[8], y[8]) > 0 and abs(x[8] - y[8]) * 100 <= 8 * max(x[8], y[8]) and abs(x[10] - y[10]) <= 7 * DAY}
    found = linkage.weak_links(spark.createDataFrame(rows, BILL)).collect()
    assert {(r["left_id"], r["right_id"]) for r in found} == want and len(found) == len(want)


def test_roots_with_cycles(spark):
    links = spark.createDataFrame([("a", "b", "R1"), ("b", "c", "R1"), ("y", "x", "R1"), ("x", "y", "R1"), ("y", "t", "R1"), ("t", "u", "R1"), ("a", "m", "R1"), ("b", "m", "R3")], "left_id string, right_id string, rule string")
    records = spark.createDataFrame([(x,) for x in "abcxytumz"], "record_id string")
    got = {r["record_id"]: r["root_id"] for r in lineages.roots(records, links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "m": "a", "x": "x", "y": "y", "t": "y", "u": "y", "z": "z"}


def test_duplicates(spark):
    rows = [bill("a", "1", "1"), bill("a2", "1", "1"), bill("a3", "1", "1", amount=7), bill("a", "1", "1")]
    got = sorted((r["record_id"], r["verdict"]) for r in linkage.judge_bills(spark.createDataFrame(rows, BILL)).collect())
    assert got == [("a", "DUPLICATE_IMPORT"), ("a", "first"), ("a2", "DUPLICATE_IMPORT"), ("a3", "CONFLICTING_DUPLICATE_KEY")]


def test_agreement(spark):
    schema = "left_id string, right_id string"
    a, b = spark.createDataFrame([("1", "2"), ("1", "2"), ("3", "4")], schema), spark.createDataFrame([("1", "2")], schema)
    assert tuple(agreement.agreement(a, b).first()) == (2, 1, 1, 500_000, 1_000_000)
    assert tuple(agreement.agreement(a.limit(0), b).first()) == (0, 1, 0, None, 0)


def test_generated_tables_normalise(spark, tmp_path):
    tables = generator.generate(spark, 60, 7)
    good, bad = normalize.split(normalize.bills(tables["bills"]))
    assert good.count() > 50 and good.count() + bad.count() == tables["bills"].count()
    naive = tables["bills"].limit(1).withColumn("submitted_at", F.lit("2023-01-01T09:00:00"))
    assert normalize.bills(naive).first()["is_valid"] is False
    assert normalize.findings(naive, "bills", "record_id").where("problem = 'not ISO-8601 with offset'").count() == 1
    files.write_csv(tables["bills"].coalesce(1), str(tmp_path / "bills.csv"))
    again = files.read_table(spark, str(tmp_path), "bills")
    assert again.count() == tables["bills"].count()
    numbers = [r["row_no"] for r in files.with_row_numbers(again.repartition(3)).select("row_no").collect()]
    assert sorted(numbers) == list(range(2, 2 + again.count()))
    assert files.read_table(spark, str(tmp_path), "observation_windows").count() == 0
    assert len(files.digests(spark, str(tmp_path / "bills.csv" / "*.csv")).first()["sha256"]) == 64


def test_model_abstains_and_predicts(spark):
    rows = spark.createDataFrame([(float(i % 7), "payment" if i % 3 == 0 else "none") for i in range(30)], "x double, label string")
    assert risk.fit_multinomial(rows, ["x"]) is None
    more = rows.union(spark.createDataFrame([(9.0, "close_no_payment")] * 6, "x double, label string"))
    predicted = risk.fit_multinomial(more, ["x"])(more)
    assert predicted.where("abs(p_none + p_payment + p_close - 1) > 1e-9 or least(p_none, p_payment, p_close) < 0").count() == 0
    thin = risk.with_rates(more, risk.rates(more.limit(3), "x"), "x")
    assert thin.where("p_none is not null").count() == 0


def test_ancestors_below_and_on_cycles(spark):
    """A tail into a cycle, a chain, and a record that is its own parent, against plain walks."""
    from ledgerloom.operators import ancestry

    up = {"t2": "t1", "t1": "c1", "c1": "c2", "c2": "c3", "c3": "c1", "s": "s"} | {f"n{i}": f"n{i - 1}" for i in range(1, 9)}

    def walk(x):
        out = [x]
        while out[-1] in up and up[out[-1]] not in out:
            out.append(up[out[-1]])
        return out

    tree = ancestry.forest(spark.createDataFrame(list(up.items()), "node string, parent string")).cache()
    got = {r["node"]: (r["root"], r["depth"], r["cycle"]) for r in tree.collect()}
    assert got == {"t2": ("c1", 2, None), "t1": ("c1", 1, None), "c1": ("c1", 0, "c1"), "c2": ("c2", 0, "c1"), "c3": ("c3", 0, "c1"), "s": ("s", 0, "s")} | {f"n{i}": ("n0", i, None) for i in range(1, 9)}
    ids = sorted(set(up) | set(up.values()) | {"alone"})
    pairs = [(a, b) for a in ids for b in ids]
    found = ancestry.reaches(spark.createDataFrame(pairs, "l string, r string"), tree, "l", "r").collect()
    assert {tuple(r) for r in found} == {(a, b) for a, b in pairs if b in walk(a)}
    assert ancestry.forest(tree.select("node", "parent").limit(0)).count() == 0


def test_a_proposal_below_a_cycle_ends(spark):
    rows = [bill("a", "1", "1", "b", at=1), bill("b", "2", "1", "a", at=2), bill("t", "3", "1", "a", at=3), bill("z", "4", "1", at=4)]
    proposals = spark.createDataFrame([("t", "z", linkage.R2), ("t", "b", linkage.R2), ("z", "t", linkage.R2)], "left_id string, right_id string, rule string")
    got = {(r["left_id"], r["right_id"]): r["verdict"] for r in linkage.check_links(proposals, spark.createDataFrame(rows, BILL)).collect()}
    assert got == {("t", "z"): "accepted", ("t", "b"): "CYCLE_REFERENCE", ("z", "t"): "accepted"}
