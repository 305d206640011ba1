"""Filling containers of fixed capacity with whole texts, at a controlled mixture of sources.

Texts are measured in tokens of a public tokenizer. Each partition holds one queue per source and fills windows of several
containers by deficit round-robin: round by round every source earns its target share of one container as credit and spends it on
texts; what it can't spend is carried on. Within a window texts go into the fullest container that still holds them, largest first
and the sources in turn. When a window ends, only its full containers are shipped; what lies in others goes back to the head of its
queue, and so does its credit, so what is shipped keeps to the mixture. The credit that a partition begins with is what
the partitions before it left over, which follows from their totals alone. What a partition has left at its end is put
together with the rests of others in a second, much smaller pass of the same kind.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut, cut_counted

CAPACITY, WINDOW = 2048, 64
ROWS_PER_PARTITION = 50_000
#: A container this full counts as closed at the end of a partition.
CLOSED_FROM = 0.97


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, tokenizer: str, name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text; null and '' have none. Batches pass through Arrow, one encoder a worker."""
    kept: dict[str, object] = {}

    @F.pandas_udf("long")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = kept.get(tokenizer) or kept.setdefault(tokenizer, _encoder(tokenizer))
        for batch in texts:
            yield batch.map(lambda t: len(encoder.encode_ordinary(t)) if t else 0)

    return df.withColumn(name, measure(F.col(text)))


class Bins:
    """Open containers, by room left; best fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.filled = capacity, [], {}
        self.made = 0

    def put(self, size: int) -> int:
        i = bisect.bisect_left(self.rooms, (size, -1))
        if i == len(self.rooms):
            room, which, self.made = self.capacity, self.made, self.made + 1
        else:
            room, which = self.rooms.pop(i)
        if room - size > 0:
            bisect.insort(self.rooms, (room - size, which))
        return which


def fill(queues: dict[str, list[tuple]], credit: dict[str, float], share: dict[str, float], capacity: int, window: int, closed_from: float = CLOSED_FROM) -> list[tuple]:
    """(key, piece_no, size, container, window, shipped) of all items (key, piece_no, size) in the sources' queues.

    A window takes texts until it has as many tokens as its containers hold, or no text is left. Containers filled from
    closed_from on are shipped; if none is, all are, so every window makes progress. What the last window doesn't ship comes out
    with shipped false.
    """
    waiting = {s: deque(items) for s, items in sorted(queues.items())}
    credit, placed, made, number = defaultdict(float, credit), [], 0, 0
    while any(waiting.values()):
        taken, held = [], 0
        while held < capacity * window and any(waiting.values()):
            live = [s for s, q in waiting.items() if q]
            whole = sum(share[s] for s in live) or 1.0
            before = held
            for s in live:
                credit[s] += capacity * (share[s] / whole if whole else 1 / len(live))
                while waiting[s] and waiting[s][0][2] <= credit[s] and held < capacity * window:
                    item = waiting[s].popleft()
                    credit[s] -= item[2]
                    held += item[2]
                    taken.append((s, item))
            if held == before:  # nobody can pay yet: the text nearest to its credit goes on
                s = max(live, key=lambda s: (credit[s] - waiting[s][0][2], s))
                item = waiting[s].popleft()
                credit[s] -= item[2]
                held += item[2]
                taken.append((s, item))
        bins, lots = Bins(capacity), defaultdict(list)
        for n in sorted(range(len(taken)), key=lambda n: (-taken[n][1][2], n)):
            lots[bins.put(taken[n][1][2])].append(n)
        full = {b for b, lot in lots.items() if sum(taken[n][1][2] for n in lot) >= closed_from * capacity}
        last = not any(waiting.values())
        ship = full if full or last else set(lots)
        back = []
        for b, lot in sorted(lots.items()):
            if b in ship or last:
                placed += [(*taken[n][1], made, number, b in ship) for n in lot]
                made += 1
            else:
                back += lot
        for n in sorted(back, reverse=True):
            s, item = taken[n]
            waiting[s].appendleft(item)
            credit[s] += item[2]
        number += 1
    return placed


def _shares(n: int, rows_per_partition: int) -> int:
    return max(1, -(-n // rows_per_partition))


PLACED = "key {key}, piece_no int, token_start long, n_tokens int, source string, container string, window string, closed boolean"


def _credits(items: DataFrame, targets: Mapping[str, float] | None) -> DataFrame:
    """at (partition), queue (source), share, and the credit that the partitions before it leave: a short row per partition and source.

    With given targets a partition ships in proportion until a source runs out; what it lacks from then on can't be repaid by the
    next, which begins even.
    """
    totals = items.groupBy("part", "source").agg(F.sum("n_tokens").alias("tokens"))
    whole = totals.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per partition
    whole = whole.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("all_before"))
    grand = totals.groupBy("source").agg(F.sum("tokens").alias("of_source"))
    if targets is None:
        sums = grand.agg(F.sum("of_source").alias("of_all")).first()["of_all"] or 1
        grand = grand.select("source", (F.col("of_source") / F.lit(sums)).alias("share"))
    else:
        asked = F.create_map(*[F.lit(x) for s, weight in targets.items() for x in (s, float(weight))]) if targets else F.create_map().cast("map<string,double>")
        grand = grand.select("source", (F.coalesce(F.try_element_at(asked, "source"), F.lit(0.0)) / F.lit(sum(targets.values()) or 1.0)).alias("share"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spent = totals.withColumn("spent", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).join(whole, "part").join(grand, "source")
    credit = F.col("share") * F.col("all_before") - F.col("spent") if targets is None else F.lit(0.0)
    return spent.select(F.col("part").alias("at"), F.col("source").alias("queue"), "share", credit.alias("credit"))


def pack(df: DataFrame, key: str, source: str, size: str, capacity: int = CAPACITY, window: int = WINDOW, rows_per_partition: int = ROWS_PER_PARTITION, targets: Mapping[str, float] | None = None) -> DataFrame:
    """One row per piece: key, piece_no, token_start, n_tokens, source, container, window.

    Only texts longer than capacity are split, into full pieces and a rest; a full piece is a container by itself and counts in
    the mixture like any other. Texts of no tokens, and null sizes, fill nothing and have no row. Null and '' sources count as one.
    targets: weights of the sources in every window; None stands for their shares of all tokens. A source whose texts have run out
    leaves its share to the others, one without a target follows when nothing else is left: no text is dropped. Rows with
    equal keys are separate items. A task holds about rows_per_partition small rows at a time.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(source, F.lit("")).alias("source"), F.col(size).cast("long").alias("size")).where("size > 0")
    rows = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))))
    start = F.col("piece_no").cast("long") * capacity
    items, n = cut_counted(rows.select("key", "piece_no", start.alias("token_start"), F.least(F.col("size") - start, F.lit(capacity)).cast("int").alias("n_tokens"), "source"))
    schema = PLACED.format(key=items.schema["key"].dataType.simpleString())

    def spread(rows: DataFrame, n: int) -> DataFrame:
        parts = _shares(n, rows_per_partition)
        return rows.withColumn("part", F.pmod(F.xxhash64("key", "piece_no", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))

    def filled(prefix: str, closed_from: float):
        def run(items: pd.DataFrame, credits: pd.DataFrame) -> pd.DataFrame:
            part = int(credits["at"].iloc[0])
            items = items.sort_values(["source", "key", "piece_no"]).reset_index(drop=True)
            queues: dict[str, list[tuple]] = {}
            for i, (s, n) in enumerate(zip(items["source"], items["n_tokens"], strict=True)):
                queues.setdefault(s, []).append((i, 0, n))
            placed = fill(queues, dict(zip(credits["queue"], credits["credit"], strict=True)), dict(zip(credits["queue"], credits["share"], strict=True)), capacity, window, closed_from)
            out = items.iloc[[p[0] for p in placed]][["key", "piece_no", "token_start", "n_tokens", "source"]].reset_index(drop=True)
            out["container"] = [f"{prefix}{part}-{p[3]}" for p in placed]
            out["window"] = [f"{prefix}{part}-{p[4]}" for p in placed]
            out["closed"] = [p[5] for p in placed]
            return out

        return run

    items = cut(spread(items, n))
    first = cut(items.groupBy("part").cogroup(_credits(items, targets).groupBy("at")).applyInPandas(filled("w", CLOSED_FROM), schema))
    left, n_left = cut_counted(first.where("not closed").select("key", "piece_no", "token_start", "n_tokens", "source"))
    left = cut(spread(left, n_left))
    rest = left.groupBy("part").cogroup(_credits(left, targets).groupBy("at")).applyInPandas(filled("r", 0.0), schema)
    return first.where("closed").drop("closed").unionByName(rest.drop("closed"))


def unused(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of room left."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * capacity))
