"""Temporal rules: leases, coalesced transfers, latency quantiles, hedging, failure streaks, budgets."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carry_last, previous, running_sum

#: Microseconds whose rows are sorted together.
CELL_US = 600_000_000
#: Latencies kept, fewest usable, delay bounds in ms, tokens an eligible fetch earns.
RING, FEWEST, DELAY_MS, RATIO = 256, 16, (5.0, 2000.0), 0.05


def lease_sessions(joins: DataFrame, by: list[str], ts: str, ttl_us: int) -> DataFrame:
    """``(*by, start_us, end_us, joins)``: the union of ``[t, t + ttl)``; a renewal at the very end still extends.

    A join begins a session where the one before is over; others belong to the last that began one.
    """
    t = joins.select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    cell = max(CELL_US, 16 * ttl_us)
    begins = F.when(F.coalesce(F.col("_t") - F.col("_previous") > ttl_us, F.lit(True)), F.col("_t"))
    of = carry_last(previous(t, F.col("_t"), by, "_t", [], cell), begins, by, "_t", [], cell)
    return of.groupBy(*by, F.col("_carried").alias("start_us")).agg((F.max("_t") + ttl_us).alias("end_us"), F.count(F.lit(1)).alias("joins"))


def coalesced_flights(calls: DataFrame, by: list[str], ts: str, tie: str, flight_us: int) -> DataFrame:
    """``(*by, leader, start_us, calls)``: transfers of ``flight_us``; calls of the same key join the one in flight."""
    return flight_calls(calls, by, ts, tie, flight_us).groupBy(*by, "leader", "start_us").agg(F.count(F.lit(1)).alias("calls"))


def flight_calls(calls: DataFrame, by: list[str], ts: str, tie: str, flight_us: int) -> DataFrame:
    """``(*by, _t, call, leader, start_us)``: the transfer that each call leads or joins; a call is known by its ``tie``.

    A call with no other in the ``flight_us`` before it leads for sure; only the stretches between such calls
    are folded in order, batch by batch. Calls are sorted within cells of time, so a busy key is cut wherever it rests.
    """
    kinds = dict(calls.dtypes)
    cell = 64 * flight_us
    t = calls.select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), tie)
    leads = F.when(F.coalesce(F.col("_t") - F.col("_previous") >= flight_us, F.lit(True)), F.struct("_t", tie))
    stretch = carry_last(previous(t, F.col("_t"), by, "_t", [tie], cell), leads, by, "_t", [tie], cell)
    rows = stretch.repartition(*by, "_carried").sortWithinPartitions(*by, "_carried", "_t", tie).select(*by, "_carried", "_t", tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, leader = None, 0, 0
        for b in batches:
            out = []
            stretches = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in b["_carried"]]
            for own, s, at, call in zip(zip(*[b[c] for c in by], strict=True), stretches, b["_t"], b[tie], strict=True):
                if (own, s) != key or at >= start + flight_us:
                    key, start, leader = (own, s), at, call
                out.append((*own, at, call, leader, start))
            yield pd.DataFrame(out, columns=[*by, "_t", "call", "leader", "start_us"])

    spec = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    return rows.mapInPandas(run, f"{spec}, _t bigint, call {kinds[tie]}, leader {kinds[tie]}, start_us bigint")


def ring_quantile(samples: DataFrame, by: list[str], order: list[str], value: str, q: float, ring: int = RING, fewest: int = FEWEST) -> DataFrame:
    """Adds ``quantile``: of the ``ring`` values before each row, the one at index floor(q * n) in order; null below ``fewest``.

    ``order``: the time, and what tells rows of one time apart. Rows are numbered and dealt into blocks of sixteen rings, with the last ring
    of the block before, so no task sorts all rows of a key.
    """
    block = 16 * ring
    timed = samples.withColumn("_t", F.unix_micros(F.col(order[0]).cast("timestamp")))
    placed = running_sum(timed, F.lit(1), by, "_t", order[1:], CELL_US).withColumn("_p", F.col("_sum") - 1)
    home = F.floor(F.col("_p") / block)
    dealt = placed.withColumn("_b", F.explode(F.when(F.col("_p") % block >= block - ring, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy(*by, "_b").orderBy("_p").rowsBetween(-ring, -1)
    kept = dealt.withColumn("_v", F.sort_array(F.collect_list(value).over(w))).where(F.col("_b") == home)
    n = F.size("_v")
    index = F.least(F.floor(F.lit(q) * n), n - 1).cast("int")
    return kept.withColumn("quantile", F.when(n >= fewest, F.get("_v", index))).drop("_v", "_p", "_b", "_t", "_sum")


def hedge_delay(quantile: Column, bounds: tuple[float, float] = DELAY_MS) -> Column:
    return F.when(quantile.isNotNull(), F.least(F.greatest(quantile, F.lit(bounds[0])), F.lit(bounds[1])))


def hedge_limiter(fetches: DataFrame, by: list[str], order: list[str], eligible: str, ratio: float = RATIO) -> DataFrame:
    """Adds ``may_hedge``: every ceil(1 / ratio)-th eligible fetch of a node has a token to spend."""
    every = -int(-1 // ratio)
    timed = fetches.withColumn("_t", F.unix_micros(F.col(order[0]).cast("timestamp")))
    counted = running_sum(timed, F.col(eligible).cast("bigint"), by, "_t", order[1:], CELL_US)
    return counted.withColumn("may_hedge", F.col(eligible) & (F.col("_sum") % every == 0)).drop("_t", "_sum")


def race(t_primary: Column, t_backup: Column, primary: Column, backup: Column, delay: Column, may_hedge: Column) -> Column:
    """Struct ``(winner, hedged, failover, at)`` of a fetch and its backup, whose results are held, failed, refused or buffer.

    The backup starts when the delay is over, if allowed, or at once when the primary fails before that; times
    are durations of each fetch. The first that holds the block wins. A refusal ends the race. A lack of local buffer starts
    no backup, as another source wouldn't help, but one under way may still win. A null ``t_backup``: there is no backup.
    """
    usable = t_backup.isNotNull()
    hedged = usable & may_hedge & (t_primary > delay)
    failover = usable & ~hedged & (primary == "failed")
    backup_at = F.when(hedged, delay).when(failover, t_primary) + t_backup
    backup_first = F.coalesce(backup_at < t_primary, F.lit(False))
    decides = lambda outcome: outcome.isin("held", "refused")
    one, two = F.when(backup_first, backup).otherwise(primary), F.when(backup_first, primary).otherwise(backup)
    first_wins = decides(one)
    second_wins = ~first_wins & backup_at.isNotNull() & decides(two)
    by_backup = (first_wins & backup_first) | (second_wins & ~backup_first)
    outcome = F.when(first_wins, one).when(second_wins, two)
    winner = F.when(outcome == "refused", "refused").when(outcome == "held", F.when(by_backup, "backup").otherwise("primary")).otherwise("none")
    at = F.when(first_wins, F.least(t_primary, backup_at)).otherwise(F.greatest(t_primary, backup_at))
    return F.struct(winner.alias("winner"), hedged.alias("hedged"), failover.alias("failover"), at.alias("at"))


def failure_streaks(outcomes: DataFrame, by: list[str], order: list[str], failed: str) -> DataFrame:
    """Adds ``streak``: failures in a row up to and with each row: its number less that of the last row that didn't fail."""
    timed = outcomes.withColumn("_t", F.unix_micros(F.col(order[0]).cast("timestamp")))
    placed = running_sum(timed, F.lit(1), by, "_t", order[1:], CELL_US).withColumn("_p", F.col("_sum"))
    last = carry_last(placed, F.when(~F.col(failed), F.col("_p")), by, "_t", order[1:], CELL_US)
    return last.withColumn("streak", F.col("_p") - F.coalesce("_carried", F.lit(0))).drop("_t", "_sum", "_p", "_carried")


def refresh_backoff(lease_ms: Column, first_ms: int = 50, steps: int = 12) -> Column:
    """Array of waits between refreshes: doubling from ``first_ms``, the cap of half a lease once the last wait reaches half of it."""
    cap = F.call_function("div", lease_ms, F.lit(2))

    def follow(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.when(last >= F.call_function("div", cap, F.lit(2)), cap).otherwise(F.least(last * 2, cap))))

    return F.aggregate(F.sequence(F.lit(2), F.lit(steps)), F.array(F.least(F.lit(first_ms).cast("bigint"), cap)), follow)


def flight_grace(max_flight_ms: Column) -> Column:
    """An eighth of the longest flight, from 25 ms to 30 s; a flight of zero or less is 10 minutes."""
    f = F.when(max_flight_ms > 0, max_flight_ms).otherwise(F.lit(600_000))
    return F.least(F.greatest(F.call_function("div", f, F.lit(8)), F.lit(25)), F.lit(30_000))


def token_valid(now: Column, expires: Column, margin_s: int = 30) -> Column:
    return F.unix_micros(now) + margin_s * 1_000_000 < F.unix_micros(expires)


def flight_results(called: DataFrame, calls: DataFrame, by: list[str], call: str, refused: str) -> DataFrame:
    """``(*by, call, transfer, coalesced)`` from ``flight_calls`` and which of the ``calls`` an origin refuses.

    The results of a transfer go to all who joined it. Where the leader is refused, the others' credentials may do: each of them
    transfers alone. One of those that share a transfer accounts for its bytes, the others are coalesced.
    """
    leaders = calls.select(*by, F.col(call).alias("leader"), F.col(refused).alias("_no"))
    own = F.when((F.col("call") != F.col("leader")) & F.col("_no"), F.col("call")).otherwise(F.col("leader"))
    return called.join(leaders, [*by, "leader"]).select(*by, "call", own.alias("transfer"), (F.col("call") != own).alias("coalesced"))


def lease_flights(calls: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, call, leader, started, shared)``: who loads for each of ``calls(*by, at, call, load_us, leaves_at)``.

    A call joins the load under way of its key, or leads one that takes its ``load_us``. A leader that leaves before (``leaves_at``,
    null for never) ends it: of those who wait the first then leads a load of its own for the others. Whoever leaves while
    waiting has no leader. Times in microseconds; a task holds one key's load and those who wait for it.
    """
    kinds = dict(calls.dtypes)
    rows = calls.select(*by, "at", "call", "load_us", F.coalesce("leaves_at", F.lit(2**62)).alias("leaves_at")).repartition(*by).sortWithinPartitions(*by, "at", "call")

    def settle(waiting: list[tuple], start: int, until: int) -> Iterator[tuple]:
        """Results of loads that are over by ``until``; the first of the waiting leads, from ``start`` on. Returns when the load under way began."""
        while waiting:
            _, leader, load, leaves = waiting[0]
            end = min(start + load, leaves)
            if end > until:
                break
            done = end == start + load
            for w in list(waiting):
                stays = w[3] > end or w[1] == leader
                if done:
                    yield (w[0], w[1], leader if stays else None, start if stays else None, stays and w[1] != leader)
                elif w[3] <= end:
                    yield (w[0], w[1], None, None, False)
            waiting[:] = [] if done else [w for w in waiting if w[3] > end]
            start = end
        return start

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, start = object(), [], 0

        def over(until: int, out: list) -> None:
            nonlocal start
            gen = settle(waiting, start, until)
            while True:
                try:
                    out.append(next(gen))
                except StopIteration as e:
                    start = e.value
                    return

        names = [*by, "call", "leader", "started", "shared"]
        frame = lambda out: pd.DataFrame([(*o[0], *o[1:]) for o in out], columns=names).astype({"leader": "Int64", "started": "Int64"})
        for b in batches:
            out: list = []
            for *own, at, call, load, leaves in b.itertuples(index=False, name=None):
                if tuple(own) != key:
                    over(2**62, out)
                    key = tuple(own)
                over(at, out)
                start = start if waiting else at
                waiting.append((key, call, load, leaves))
            if out:
                yield frame(out)
        out = []
        over(2**62, out)
        if out:
            yield frame(out)

    spec = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    return rows.mapInPandas(run, f"{spec}, call bigint, leader bigint, started bigint, shared boolean")


def receive_budget(transfers: DataFrame, by: list[str], start: str, end: str, size: str) -> DataFrame:
    """``(*by, peak_bytes, peak_loads)``: the most bytes and loads under way at once, ends before starts at equal times; times in microseconds."""
    starts = transfers.select(*by, F.col(start).alias("_t"), F.col(size).alias("_b"), F.lit(1).alias("_d"))
    ends = transfers.select(*by, F.col(end).alias("_t"), (-F.col(size)).alias("_b"), F.lit(-1).alias("_d"))
    both = running_sum(starts.unionByName(ends), F.col("_b"), by, "_t", ["_d", "_b"], CELL_US).withColumnRenamed("_sum", "_bytes")
    running = running_sum(both, F.col("_d"), by, "_t", ["_d", "_b"], CELL_US)
    return running.groupBy(*by).agg(F.max("_bytes").alias("peak_bytes"), F.max("_sum").cast("bigint").alias("peak_loads"))


def admissions(loads: DataFrame, by: list[str], max_bytes: int, max_loads: int, reserve_bytes: int = 0, wait_us: int = 0) -> DataFrame:
    """``(*by, load, admitted, waited_us, bytes, loads)`` for each of ``loads(*by, at, load, bytes, takes_us, speculative)``.

    A load is admitted while fewer than ``max_loads`` are under way and its bytes fit into ``max_bytes``; a speculative one has to
    leave room for another load of ``reserve_bytes`` (0: no room is kept) and is never made to wait. Others wait up to ``wait_us``;
    whenever a load ends, those who wait are tried in the order they came. ``bytes, loads``: under way with it, or when it was turned away.
    """
    kinds = dict(loads.dtypes)
    rows = loads.select(*by, "at", "load", "bytes", "takes_us", "speculative").repartition(*by).sortWithinPartitions(*by, "at", "load")

    class Budget:
        def __init__(self) -> None:
            self.ends: list[tuple[int, int]] = []  # heap of (end, bytes)
            self.waiting: deque[tuple] = deque()
            self.held = 0

        def fits(self, size: int, spare_bytes: int = 0, spare_loads: int = 0) -> bool:
            return len(self.ends) < max_loads - spare_loads and size <= max_bytes - spare_bytes - self.held

        def take(self, now: int, size: int, takes: int) -> None:
            heapq.heappush(self.ends, (now + takes, size))
            self.held += size

        def until(self, now: int) -> Iterator[tuple]:
            """Let loads end up to a time, and those who wait come in or give up."""
            while self.ends and self.ends[0][0] <= now:
                end, size = heapq.heappop(self.ends)
                self.held -= size
                yield from self.gave_up(end)
                for w in [*self.waiting]:
                    if self.fits(w[3]):
                        self.waiting.remove(w)
                        self.take(end, *w[3:])
                        yield (*w[0], w[2], True, end - w[1], self.held, len(self.ends))
            yield from self.gave_up(now)

        def gave_up(self, now: int) -> Iterator[tuple]:
            while self.waiting and self.waiting[0][1] + wait_us < now:
                key, _, load, _, _ = self.waiting.popleft()
                yield (*key, load, False, wait_us, self.held, len(self.ends))

        def ask(self, key: tuple, now: int, load: int, size: int, takes: int, speculative: bool) -> Iterator[tuple]:
            yield from self.until(now)
            spare = (reserve_bytes, 1) if speculative and reserve_bytes else (0, 0)
            if self.fits(size, *spare):
                self.take(now, size, takes)
                yield (*key, load, True, 0, self.held, len(self.ends))
            elif speculative or not wait_us:
                yield (*key, load, False, 0, self.held, len(self.ends))
            else:
                self.waiting.append((key, now, load, size, takes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, budget = object(), Budget()
        names = [*by, "load", "admitted", "waited_us", "bytes", "loads"]
        for b in batches:
            out: list = []
            for *own, at, load, size, takes, speculative in b.itertuples(index=False, name=None):
                if tuple(own) != key:
                    out.extend(budget.until(2**62))
                    key, budget = tuple(own), Budget()
                out.extend(budget.ask(key, at, load, size, takes, speculative))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(budget.until(2**62)), columns=names)

    spec = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    return rows.mapInPandas(run, f"{spec}, load bigint, admitted boolean, waited_us bigint, bytes bigint, loads bigint")


def prefetch_lead(blocks: DataFrame, by: list[str], block: str, window: int = 2) -> DataFrame:
    """Adds ``window_end``: the last block of the request that may be in flight while this one is delivered."""
    w = Window.partitionBy(*by).orderBy(block).rowsBetween(0, window - 1)
    return blocks.withColumn("window_end", F.max(block).over(w))
