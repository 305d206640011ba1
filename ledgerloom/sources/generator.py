"""Small synthetic contract tables with known dirt, for examples and tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.files import COLUMNS, text_schema

START = datetime(2023, 1, 2, 9, tzinfo=timezone.utc)


def lag(rng: random.Random) -> timedelta:
    """Time until a record is known: often the same day, else log-normal days up to 21, at times a month or three."""
    u = rng.random()
    if u < 0.45:
        return timedelta(hours=rng.uniform(0.1, 10))
    if u < 0.98:
        return timedelta(days=min(21.0, rng.lognormvariate(0.8, 0.8)))
    return timedelta(days=rng.uniform(30, 90))


def generate(spark: SparkSession, n: int = 100, seed: int = 42) -> dict[str, DataFrame]:
    """bills, events, allocations, observation_windows; the same for the same seed. A driver-side list of about 6 n rows."""
    rng, bills, events, allocations = random.Random(seed), [], [], []
    stamp = lambda t: t.isoformat(timespec="seconds")
    for i in range(n):
        org = rng.choice(("CPL", "TRI", "NDX"))
        system, bill, amount = f"{org}-LIS", f"BN-{i:06d}", rng.randrange(500, 90_000)
        t, previous = START + timedelta(hours=rng.randrange(0, 9000)), ""
        for version in range(1, 2 + (rng.random() < 0.1)):
            record = f"{org}-B{i:06d}{version}"
            text = "-1" if rng.random() < 0.003 else str(amount)
            when = stamp(t) if rng.random() >= 0.004 else stamp(t)[:19]
            bills.append((record, org, system, bill, str(version), previous, rng.choice(("AET", "MCR", "SELF", "")), f"S{i % 40}", text, "EUR" if rng.random() < 0.002 else "USD", when, stamp(t + lag(rng)), f"gen/{i}"))
            events.append((f"{record}-S", org, system, record, "SUBMITTED" if version == 1 else "CORRECTED", stamp(t), stamp(t + lag(rng)), text, "USD", "", "false", ""))
            previous, t = record, t + timedelta(days=rng.randrange(1, 9))
        u = rng.random()
        if u < 0.06:
            events.append((f"{record}-C", org, system, record, "CLOSED_NO_PAYMENT", stamp(t), stamp(t + lag(rng)), "", "", "", "true", ""))
        elif u < 0.9:
            part = amount if u < 0.7 else amount // 2
            events.append((f"{record}-P", org, system, "", "PAYMENT_POSTED", stamp(t), stamp(t + lag(rng)), str(part), "USD", "", "false", ""))
            allocations.append((f"{record}-A", f"{record}-P", record, str(part), "USD", stamp(t + lag(rng)), ""))
            if rng.random() < 0.025:
                events.append((f"{record}-R", org, system, "", "PAYMENT_REVERSED", stamp(t), stamp(t + lag(rng)), str(part // 2), "USD", f"{record}-P", "false", ""))
    events += [(f"{e[0]}-2", *e[1:]) for e in events if rng.random() < 0.01]
    ends = stamp(START + timedelta(days=500))
    windows = [(f"W{o}{k}", o, f"{o}-LIS", stamp(START), ends, ends, status, "") for o in ("CPL", "TRI", "NDX") for k, status in enumerate(("complete", "partial"))]
    rows = {"bills": bills, "events": events, "allocations": allocations, "observation_windows": windows}
    return {name: spark.createDataFrame(data, text_schema(COLUMNS[name])) for name, data in rows.items()}
