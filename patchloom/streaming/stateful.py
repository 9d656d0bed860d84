"""Findings that keep arriving: each is told once while it keeps coming back, and again after it was gone for a while.

State is kept by repository and fingerprint, many of them together, and leaves by event time, so it is bounded by the
findings of one quiet period. What arrives later than the watermark is counted by Spark and told by :func:`late_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOLD = "repo string, fingerprint string, event string, at timestamp, first_at timestamp, times long"
_STATE = "repo array<string>, fingerprint array<string>, first array<long>, last array<long>, times array<long>"
_MICRO = 1_000_000
#: Groups that findings are dealt to. The engine's cost of a group is that of thousands of findings, so none has its own.
BUCKETS = 1024


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def told_once(findings: DataFrame, quiet_seconds: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Events of a stream of ``findings`` (repo, fingerprint, at): ``opened`` where one is met first, or first after
    ``quiet_seconds`` without it; ``closed`` where it was not met for so long, with how often it was before.

    A finding closes with the watermark or with its next opening. Rows with a null in any of the three columns are left out.
    ``buckets`` is part of a checkpoint's state and stays as it was when the checkpoint began.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        opened = {(r, f): known for r, f, *known in zip(*state.get)} if state.exists else {}

        def tell(key: tuple, event: str, at: int, first: int, times: int) -> None:
            out.append((*key, event, at, first, times))

        if not state.hasTimedOut:
            for at, *found in sorted(row for b in batches for row in zip(_micros(b["at"]), b["repo"], b["fingerprint"])):
                first, last, times = opened.get(key := tuple(found), (at, at, 0))
                if times and at - last > quiet_seconds * _MICRO:
                    tell(key, "closed", last, first, times)
                    first, times = at, 0
                if not times:
                    tell(key, "opened", at, first, 0)
                opened[key] = (first, max(last, at), times + 1)
        # A row that lies quiet_seconds behind still belongs: a finding may go only when such a row would be late.
        due = lambda last: last // 1000 + quiet_seconds * 1000 + 1
        now = state.getCurrentWatermarkMs()
        for key in [k for k, (_, last, _) in opened.items() if due(last) <= now]:
            first, last, times = opened.pop(key)
            tell(key, "closed", last, first, times)
        if opened:
            state.update(tuple(map(list, zip(*(key + tuple(known) for key, known in opened.items())))))
            state.setTimeoutTimestamp(min(due(last) for _, last, _ in opened.values()))
        elif state.exists:
            state.remove()
        if out:
            told = pd.DataFrame(out, columns=["repo", "fingerprint", "event", "at", "first_at", "times"])
            yield told.assign(**{c: pd.to_datetime(told[c], unit="us") for c in ("at", "first_at")})

    rows = findings.select("repo", "fingerprint", "at").dropna().withWatermark("at", late)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("repo", "fingerprint"), F.lit(buckets))).groupBy("bucket")
    return dealt.applyInPandasWithState(step, TOLD, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(findings: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """repo, begun, ended, findings: bursts of ``findings`` (repo, at) of a repository that ``gap`` or more without any parts.

    ``ended`` is the last finding's time and the gap. A stream tells a session once the watermark has passed it; the
    same plan runs over a table.
    """
    rows = findings.where("repo is not null and at is not null").withWatermark("at", late)
    grouped = rows.groupBy("repo", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("findings"))
    return grouped.select("repo", F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "findings")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the batches that the query still remembers."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p.get("stateOperators", []))
