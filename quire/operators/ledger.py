"""Ledgers: balances, idempotent spends, refunds, credits and clawbacks, as an ordered fold for each account.

The same fold runs in batch (a group per account) and in Structured Streaming (state per account).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "uid long, seq long, kind string, run string, coins long"
RESULT = "uid long, seq long, kind string, run string, applied long, balance long, outcome string"


class Account:
    """Balance, runs already charged, coins taken and given back for each run, and events already applied."""

    def __init__(self, balance: int = 0, runs: dict | None = None, events: Iterable[str] = ()):
        self.balance, self.runs, self.events = balance, dict(runs or {}), set(events)

    def apply(self, kind: str, run: str, coins: float) -> tuple[int, str]:
        """What the balance changes by, and the outcome. Only whole numbers of coins above 0 move anything. A run is charged once, and
        only if the balance covers it; what is refunded must be left of what its run took; a credit or clawback counts once by its
        event, and a clawback may leave less than nothing."""
        if coins is None or coins != coins or coins != math.floor(coins) or coins <= 0:
            return 0, "no amount"
        coins = int(coins)
        if kind == "spend":
            if run in self.runs:
                return 0, "repeated"
            if coins > self.balance:
                return 0, "refused"
            self.runs[run] = [coins, 0]
            change = -coins
        elif kind == "refund":
            taken, back = self.runs.get(run, (0, 0))
            if run not in self.runs:
                return 0, "no such run"
            if coins > taken - back:
                return 0, "more than it took"
            self.runs[run] = [taken, back + coins]
            change = coins
        else:
            if run in self.events:
                return 0, "repeated"
            self.events.add(run)
            change = {"credit": coins, "clawback": -coins}.get(kind, 0)
        self.balance += change
        return change, "applied"


def settled(events: DataFrame) -> DataFrame:
    """The outcome of every event, in order of seq within each account."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        account, out = Account(), []
        for r in rows.sort_values(["seq", "kind", "run"], kind="stable").itertuples(index=False):
            applied, outcome = account.apply(r.kind, r.run, r.coins)
            out.append((r.uid, r.seq, r.kind, r.run, applied, account.balance, outcome))
        return pd.DataFrame(out, columns=["uid", "seq", "kind", "run", "applied", "balance", "outcome"])

    return events.groupBy("uid").applyInPandas(fold, RESULT)


def settled_stream(events: DataFrame, keep: str | None = None) -> DataFrame:
    """settled() over a stream: the account is kept as state, so that a run or an event applies once however often it comes. Where
    `keep` names a duration, the runs and events of an account are forgotten that long after its last event; its balance stays."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        balance, runs, seen = state.get if state.exists else (0, "{}", "[]")
        if state.hasTimedOut:
            state.update((balance, "{}", "[]"))
            return
        account, out = Account(balance, json.loads(runs), json.loads(seen)), []
        rows = pd.concat(list(batches))
        for r in rows.sort_values(["seq", "kind", "run"], kind="stable").itertuples(index=False):
            applied, outcome = account.apply(r.kind, r.run, r.coins)
            out.append((r.uid, r.seq, r.kind, r.run, applied, account.balance, outcome))
        state.update((account.balance, json.dumps(account.runs), json.dumps(sorted(account.events))))
        if keep:
            state.setTimeoutDuration(keep)
        yield pd.DataFrame(out, columns=["uid", "seq", "kind", "run", "applied", "balance", "outcome"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep else GroupStateTimeout.NoTimeout
    return events.groupBy("uid").applyInPandasWithState(fold, RESULT, "balance long, runs string, events string", "append", timeout)


def refunded_share(coins, refunded, total):
    """Of a purchase's coins the share that its refund takes back, rounded down; all of them from the whole price on. Columns."""
    part = F.floor(coins * refunded / F.nullif(total, F.lit(0)))
    return F.when((coins <= 0) | (total <= 0) | (refunded <= 0), F.lit(0)).when(refunded >= total, coins).otherwise(part).cast("long")


def clawed_back(purchases: DataFrame) -> DataFrame:
    """purchases: uid, charge, seq, coins, total, refunded (in all so far, as each notice says). What each notice takes back: the share of all
    that was refunded less the shares that earlier notices took, so that part refunds never take twice."""
    from pyspark.sql import Window

    w = Window.partitionBy("charge").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    share = refunded_share(F.col("coins"), F.col("refunded"), F.col("total"))
    rows = purchases.withColumn("_share", share)
    return rows.withColumn("taken", F.greatest(F.lit(0), F.col("_share") - F.coalesce(F.max("_share").over(w), F.lit(0))).cast("long")).drop("_share")


def live(entries: DataFrame, seconds: int = 600) -> DataFrame:
    """M11. entries: owner, at, kind (put or take), in the order of at. A handed-over entry can be taken once, not later than `seconds` after it
    was put; a put while one is live fails. Gives what each entry did: put, failed, taken, nothing."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held, out = None, []
        for r in rows.sort_values(["at", "kind"], kind="stable").itertuples(index=False):
            if held is not None and r.at - held > seconds:
                held = None
            if r.kind == "put":
                out.append("failed" if held is not None else "put")
                held = r.at if held is None else held
            else:
                out.append("nothing" if held is None else "taken")
                held = None
        return rows.sort_values(["at", "kind"], kind="stable").assign(outcome=out)[["owner", "at", "kind", "outcome"]]

    return entries.groupBy("owner").applyInPandas(fold, "owner long, at long, kind string, outcome string")


def once(events: DataFrame, by: list[str]) -> DataFrame:
    """T3. Of events that share what makes them one (an account and a run's id), the first by seq."""
    first = F.min(F.struct("seq", *[c for c in events.columns if c not in by and c != "seq"])).alias("e")
    return events.groupBy(*by).agg(first).select(*by, "e.*")


def balances(ledger: DataFrame) -> DataFrame:
    """Credits less spends; other kinds move nothing. Works on tables and, in update or complete mode, on streams."""
    signed = F.when(F.col("kind") == "credit", F.col("coins")).when(F.col("kind") == "spend", -F.col("coins")).otherwise(0)
    return ledger.groupBy("uid").agg(F.sum(signed).cast("long").alias("balance"))
