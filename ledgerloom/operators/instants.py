"""Mixed timestamp formats and zones to one UTC instant.

Zone rules become offset intervals on the local time line, exploded to the local years that they touch. A parsed wall clock is
joined as-of to the intervals of its zone and year: two matching intervals mean an ambiguous time, none a time that was skipped,
one gives the offset directly. The interval table is bounded by the zone database: at most about 600 zones x 270 years. Stamps in the
contract's own form carry their offset and are read by the engine's cast.
"""

from __future__ import annotations

import functools
import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import timestamps as ts
from ledgerloom.session import fresh

#: Years for which offset changes are worked out: from before the first change of any zone; outside of them the nearest offset holds.
FIRST_YEAR, LAST_YEAR = 1830, 2100
_FAR = 1 << 62
INTERVALS = T.StructType([
    T.StructField("zone", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("utc_start", T.LongType()), T.StructField("local_start", T.LongType()),
        T.StructField("local_end", T.LongType()), T.StructField("offset", T.LongType())]))),
])


def _offset_at(zone: zoneinfo.ZoneInfo, second: int) -> int:
    return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())


def _recorded_changes(name: str) -> list[int]:
    """UTC seconds at which the zone's compiled file (RFC 8536) records a change."""
    folder = next((f for f in zoneinfo.TZPATH if Path(f, name).is_file()), None)
    data = Path(folder, name).read_bytes() if folder else resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    header = struct.Struct(">4sc15x6l")
    _, version, n_ut, n_std, n_leap, n_time, n_type, n_char = header.unpack_from(data)
    at = header.size
    if version >= b"2":  # the first block has 32-bit times, the second all of them
        at += n_time * 5 + n_type * 6 + n_char + n_leap * 8 + n_std + n_ut
        n_time = header.unpack_from(data, at)[5]
        at += header.size
    return list(struct.unpack_from(f">{n_time}{'q' if version >= b'2' else 'l'}", data, at))


@functools.cache
def offset_intervals(name: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> tuple[tuple[int, int], ...]:
    """(UTC second from which it holds, offset) of a zone: the recorded changes, and behind the last one those found by bisecting half days."""
    zone = zoneinfo.ZoneInfo(name)
    begin, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first_year, last_year + 1))
    recorded = [t for t in _recorded_changes(name) if begin < t < end]
    found, at, offset = [(-_FAR, _offset_at(zone, begin))], begin, _offset_at(zone, begin)
    for then in [*recorded, *range(max([begin, *recorded]) + 43200, end, 43200), end]:
        if (changed := _offset_at(zone, then)) != offset:
            low, high = at, then
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _offset_at(zone, mid) == offset else (low, mid)
            found.append((high, changed))
            offset = changed
        at = then
    return tuple(found)


def _known_zone(name: str) -> Column:
    names = ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))
    return F.expr(f"`{name}` in ({names})")


def interval_table(spark: SparkSession, zones: list[str], first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """One row per zone and local year with the offset intervals that touch that year, in order of time. Unknown zones have no rows."""
    known, rows = zoneinfo.available_timezones(), []
    for zone in sorted({z for z in zones if z in known}):
        starts = offset_intervals(zone, first_year, last_year)
        spans = []
        for (start, offset), (end, _) in zip(starts, [*starts[1:], (_FAR, 0)], strict=True):
            local = [x if abs(x) == _FAR else (x + offset) * 1_000_000 for x in (start, end)]
            spans.append((start, *local, offset))
        for year in range(first_year - 1, last_year + 2):
            low, high = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000 for y in (year, year + 1))
            # a day more on either side: the span before a skipped time may end just before the year
            rows.append((zone, year, [s for s in spans if s[1] < high + 86_400_000_000 and s[2] > low - 86_400_000_000]))
    return spark.createDataFrame(rows, INTERVALS)


def source_zones(systems: DataFrame) -> list[str]:
    """Distinct zones of the source table: no more than the zone database has names (about 600)."""
    return [r[0] for r in systems.select("tz_name").where(_known_zone("tz_name")).distinct().collect()]


def written_zones(stamps: DataFrame, stamp: str) -> list[str]:
    """Distinct zones that stamps name in brackets, as in [Europe/Berlin]: no more than the zone database has names."""
    named = stamps.where(F.col(stamp).contains("[")).select(ts.bracketed_zone(F.col(stamp)).alias("zone"))
    return [r[0] for r in named.where(_known_zone("zone")).distinct().collect()]


def resolve_local(df: DataFrame, intervals: DataFrame, local: str, zone: str) -> DataFrame:
    """Adds offset_s and local_kind ('unique', 'ambiguous', 'skipped', null without zone) to wall clocks `local` (microseconds).

    An ambiguous time gets the first of its two instants, a skipped one the offset before the change.
    """
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(local) / F.lit(86_400_000_000)).cast("int")))
    bounded = F.least(F.greatest(year, F.lit(FIRST_YEAR - 1)), F.lit(LAST_YEAR + 1))
    side = F.broadcast(intervals.select(F.col("zone").alias("_ll_iz"), F.col("year").alias("_ll_iy"), F.col("spans").alias("_ll_spans")))
    joined = df.withColumn("_ll_at", bounded).join(side, (F.col(zone) == F.col("_ll_iz")) & (F.col("_ll_at") == F.col("_ll_iy")), "left")
    matching = F.filter("_ll_spans", lambda s: (s["local_start"] <= F.col(local)) & (F.col(local) < s["local_end"]))
    before = F.filter("_ll_spans", lambda s: s["local_end"] <= F.col(local))
    joined = joined.withColumn("_ll_match", matching)
    n = F.size("_ll_match")
    offset = F.when(n >= 1, F.get("_ll_match", F.lit(0))["offset"]).when(n == 0, F.element_at(before, -1)["offset"])
    kind = F.when(n == 1, "unique").when(n > 1, "ambiguous").when(n == 0, "skipped")
    return joined.withColumn("offset_s", offset).withColumn("local_kind", kind).drop("_ll_at", "_ll_iz", "_ll_iy", "_ll_spans", "_ll_match")


def to_instants(df: DataFrame, stamp: str, systems: DataFrame, system: str = "source_system", intervals: DataFrame | None = None) -> DataFrame:
    """df with utc_micros (long, null if the stamp names no instant) and local_kind.

    systems has source_system, tz_name and date_order; it is small by contract (one row per source system). Null, empty or
    unreadable stamps, dates that don't exist, unknown abbreviations, and local times whose source system or zone is unknown
    give null. Repeated rows stay repeated. Columns of df that clash with the two results are replaced.
    """
    spark = df.sparkSession
    intervals = intervals if intervals is not None else interval_table(spark, [*source_zones(systems), *written_zones(df, stamp)])
    keep = [c for c in df.columns if c not in ("utc_micros", "local_kind")]
    names = {n: fresh(df, f"_ll_{n}") for n in ("s", "f", "zone", "order", "local", "own", "sys", "direct")}
    per_system = systems.groupBy("source_system").agg(F.min("tz_name").alias(names["zone"]), F.min("date_order").alias(names["order"]))
    per_system = per_system.withColumnRenamed("source_system", names["sys"])
    direct = ts.contract_micros(F.col(stamp))
    other = F.when(~ts.conforms(F.col(stamp)), ts.stripped(F.col(stamp)))
    out = df.select(*keep, direct.alias(names["direct"]), other.alias(names["s"]))
    out = out.join(F.broadcast(per_system), F.col(system) == F.col(names["sys"]), "left")
    out = out.withColumn(names["f"], ts.canonical_fields(F.col(names["s"])))
    fields = F.col(names["f"])
    out = out.withColumn(names["local"], ts.local_micros(fields, F.col(names["order"]))).withColumn(names["own"], ts.written_offset(fields))
    bracket = F.get(fields, 9)
    zone = F.when(~ts.names_zone(fields), F.when(bracket != "", bracket).otherwise(F.col(names["zone"])))
    out = resolve_local(out.withColumn(names["zone"], zone), intervals, names["local"], names["zone"])
    micros = F.when(ts.names_zone(fields), F.col(names["local"]) - F.col(names["own"]) * 1_000_000).otherwise(F.col(names["local"]) - F.col("offset_s") * 1_000_000)
    utc = F.coalesce(names["direct"], ts.epoch_micros(F.col(names["s"])), micros)
    return out.select(*keep, utc.alias("utc_micros"), "local_kind")


def nonconforming(stamp: str) -> Column:
    """Stamps that aren't written in the contract's form."""
    return F.col(stamp).isNotNull() & ~ts.conforms(F.col(stamp))
