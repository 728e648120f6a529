"""Analyses over a fetch log: host, ts, event id, status_code, response_time.

Hosts are skewed, so totals are plain aggregates (combined on the map side) and
everything ordered goes through ``ordered``, which cuts large hosts into slices.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions.outcomes import is_success, rate, retryable_status
from trawlframe.operators.ordered import Rule, ordered_fold, running

# Adaptive retry and breaker defaults.
BASE_RETRIES, BASE_DELAY, MAX_DELAY = 3, 1.0, 60.0
MIN_SAMPLES, RATE_THRESHOLD = 10, 0.8
FAILURE_THRESHOLD, RECOVERY_SECONDS = 5, 60


def usable_pages(log: DataFrame, task_id: Column, crawl_time: Column) -> DataFrame:
    """Only fetches with status 200, with the crawl metadata attached."""
    return log.where(is_success(F.col("status_code"))).withColumns(
        {"task_id": task_id, "crawl_time": crawl_time})


def download_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, successes, failures, success rate, mean response time."""
    ok = is_success(F.col("status_code"))
    return log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.count_if(~ok).alias("failed_requests"),
        rate(F.count_if(ok), F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("average_response_time"))


def daily_stats(log: DataFrame, task: str) -> DataFrame:
    """Per task and day: requests, successes, failures, total response time."""
    ok = is_success(F.col("status_code"))
    return log.groupBy(task, F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("requests_count"), F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failed_count"), F.sum("response_time").alias("total_response_time"))


def adapted_retries(success_rate: Column, requests: Column, retries: int = BASE_RETRIES) -> Column:
    low, high = min(retries + 2, 10), max(retries - 1, 1)
    return F.when(requests < MIN_SAMPLES, retries).when(success_rate < RATE_THRESHOLD, low).otherwise(high)


def adapted_delay(success_rate: Column, requests: Column, delay: float = BASE_DELAY) -> Column:
    low, high = min(delay * 1.5, 10.0), max(delay * 0.8, 0.5)
    return (F.when(requests < MIN_SAMPLES, F.lit(float(delay)))
            .when(success_rate < RATE_THRESHOLD, F.lit(low)).otherwise(F.lit(high)))


def retry_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals with the retry setting the success rate recommends."""
    totals = download_stats(log, by)
    args = (F.col("success_rate"), F.col("total_requests"))
    return totals.select(
        *(by or []), "total_requests", F.col("successful_requests").alias("success_count"),
        F.col("failed_requests").alias("failure_count"), "success_rate",
        adapted_retries(*args).alias("max_retries"), adapted_delay(*args).alias("base_delay"))


def adaptive_retry(log: DataFrame, host: str = "host", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Recommendation after each request of a host, from its running rate."""
    slim = log.select(host, *order, "status_code")
    run = running(slim, [host], list(order), count="requests",
                  sums={"successes": is_success(F.col("status_code")).cast("long")})
    share = F.col("successes") / F.col("requests")
    return run.withColumns({
        "success_rate": share,
        "max_retries": adapted_retries(share, F.col("requests")),
        "base_delay": adapted_delay(share, F.col("requests"))})


def failure_streaks(log: DataFrame, host: str = "host", order: tuple[str, ...] = ("ts", "event_id"),
                    alarm: int = 5) -> DataFrame:
    """Longest and current run of failures per host, alarm from ``alarm`` on.

    Failures with the same number of successes before them are one run."""
    ok = is_success(F.col("status_code"))
    run = running(log.select(host, *order, "status_code"), [host], list(order), sums={"_run": ok.cast("long")})
    runs = run.groupBy(host, "_run").agg(F.count_if(~ok).alias("n"))
    return runs.groupBy(host).agg(
        F.max("n").alias("longest_streak"), F.max_by("n", "_run").alias("current_streak"),
        (F.max("n") >= alarm).alias("alarm"))


def retry_plan(log: DataFrame, max_retries: int = BASE_RETRIES, base: float = BASE_DELAY,
               factor: float = 2.0, max_delay: float = MAX_DELAY) -> DataFrame:
    """One row per attempt a failed, retryable request would get. Jitter is a
    random factor of 0.5 to 1.5 before the cap, so its bounds are given."""
    failed = log.where(retryable_status(F.col("status_code")))
    attempt = F.explode(F.sequence(F.lit(0), F.lit(max_retries - 1))).alias("attempt")
    raw = F.lit(float(base)) * F.pow(F.lit(float(factor)), F.col("attempt"))
    cap = F.lit(float(max_delay))
    return failed.select("*", attempt).withColumns({
        "delay": F.least(raw, cap), "delay_low": F.least(raw * 0.5, cap), "delay_high": F.least(raw * 1.5, cap)})


def breaker_fold(threshold: int, recovery_seconds: float):
    """Circuit breaker over one host's ordered calls (columns _us, _ok).

    Works from state change to state change: while closed, the next change is
    where a run of failures reaches the threshold; while open, it is the first
    call after the waiting time. Calls in between need no step of their own.
    """
    wait = int(recovery_seconds * 1_000_000)

    def fold(values: dict[str, np.ndarray], state: str | None):
        at, ok = values["_us"], values["_ok"].astype(bool)
        n = len(at)
        decision = np.full(n, "accepted", dtype=object)
        after = np.full(n, "closed", dtype=object)
        carried = json.loads(state) if state else {"failures": 0}
        index = np.arange(n)
        last_ok = np.maximum.accumulate(np.where(ok, index, -1))
        run = np.where(ok, 0, index - last_ok) + np.where(last_ok < 0, carried.get("failures", 0), 0) * ~ok
        openers = np.flatnonzero(run == threshold)
        i, open_until = 0, carried.get("open_until")
        while i < n:
            if open_until is None:
                nxt = int(np.searchsorted(openers, i))
                if nxt == len(openers):
                    break
                i = int(openers[nxt])
            else:
                trial = int(np.searchsorted(at, open_until))
                decision[i:trial] = "rejected"
                after[i:trial] = "open"
                i = trial
                if i == n:
                    break
                decision[i] = "trial"
                if ok[i]:
                    open_until = None
                    i += 1
                    continue
            after[i] = "open"
            open_until = int(at[i]) + wait
            i += 1
        if open_until is not None:
            left = {"open_until": open_until}
        else:
            left = {"failures": int(run[-1]) if n else carried.get("failures", 0)}
        return {"decision": decision, "state": after}, json.dumps(left)
    return fold


def _text(failures: int | None, open_until: int | None) -> str:
    return json.dumps({"failures": failures} if open_until is None else {"open_until": open_until})


def breaker_rule(threshold: int, recovery_seconds: float) -> Rule:
    """The breaker as a rule that can be composed.

    States are a number of failures, or open until a time. Within a slice the states form a forest: closed without failures before a call,
    or a trial at a call, each lead to one other or out of the slice; jumping along it gives every state's exit. An open breaker can
    enter at the calls of the slice's first waiting time only, so the summary lists no others.
    """
    wait = int(recovery_seconds * 1_000_000)

    def summary(values: dict[str, np.ndarray]) -> str:
        at, ok = values["_us"], values["_ok"].astype(bool)
        n = len(at)
        index = np.arange(n)
        next_ok = np.minimum.accumulate(np.where(ok, index, n)[::-1])[::-1]
        # Where a breaker opens that is closed without failures before call i: in the run that i stands in, or in the next long one.
        begins = np.flatnonzero(~ok & np.append(True, ok[:-1]))
        openers = begins[next_ok[begins] - begins >= threshold] + threshold - 1
        later = np.append(openers, n)[np.searchsorted(openers - threshold + 1, next_ok)]
        opens = np.append(np.where(next_ok - index >= threshold, index + threshold - 1, later), n)
        trial = np.append(np.searchsorted(at, at + wait), n)  # the first call that a breaker opened at i lets through
        tail = np.append(np.minimum(n - index, n - 1 - (int(np.flatnonzero(ok)[-1]) if ok.any() else -1)), 0)  # failures at the end, from i on
        # Nodes: closed before call 0 to n, then a trial at call 0 to n - 1; an exit leads to itself.
        to_trial = lambda opener: np.where(trial[opener] < n, n + 1 + trial[opener], -1 - opener)
        closed = np.where(opens < n, to_trial(np.minimum(opens, n)), np.arange(n + 1))
        tried = np.where(ok, index + 1, to_trial(index))
        step = np.concatenate([closed, tried])
        exits = np.where(step < 0, step, 0)  # -1 - i: open by call i
        jump = np.where(step < 0, np.arange(len(step)), step)
        while not np.array_equal(further := jump[jump], jump):
            jump = further
        leave = lambda node: _text(None, int(at[-1 - exits[node]]) + wait) if exits[node] else _text(int(tail[node]), None)
        run = int(next_ok[0])
        entered = []
        for failures in range(threshold):
            if failures and failures + run >= threshold:
                opener = threshold - failures - 1
                node = int(trial[opener])
                entered.append(leave(int(jump[n + 1 + node])) if node < n else _text(None, int(at[opener]) + wait))
            elif failures and run == n:
                entered.append(_text(failures + n, None))
            else:
                entered.append(leave(int(jump[run if failures else 0])))
        reached = int(np.searchsorted(at, at[0] + wait)) + 1
        ends = jump[n + 1:][:reached]
        kept = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))  # calls with one exit in a row are one entry
        return json.dumps({"closed": entered, "at": at[kept].tolist(), "exits": [leave(int(e)) for e in ends[kept]]})

    def through(told: str, state: str | None) -> str:
        known, held = json.loads(told), json.loads(state) if state else {"failures": 0}
        if "open_until" not in held:
            return known["closed"][held["failures"]]
        i = bisect_left(known["at"], held["open_until"])
        return known["exits"][i] if i < len(known["at"]) else state

    return Rule(breaker_fold(threshold, recovery_seconds), summary, through)


def breaker_replay(log: DataFrame, host: str = "host", ts: str = "ts", row_id: str = "event_id",
                   threshold: int = FAILURE_THRESHOLD, recovery_seconds: float = RECOVERY_SECONDS) -> DataFrame:
    """What a circuit breaker per host would have done: decision (accepted,
    rejected, trial) and the state after each call."""
    slim = log.select(
        host, ts, row_id, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
        is_success(F.col("status_code")).alias("_ok"))
    kept = [slim.schema[c] for c in (host, ts, row_id)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", decision string, state string"
    return ordered_fold(slim, host, ["_us", row_id], ["_us", "_ok"], breaker_rule(threshold, recovery_seconds), schema)
